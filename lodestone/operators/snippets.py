"""Snippets: the best window of hits, with runs of hits marked."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN

SPAN = 40


def best_window(weights: list[int], positions: list[int] | None = None) -> tuple[int, int]:
    """First (i, j) of greatest weight among hit ranges: at most SPAN hits, or places, apart."""
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    best, found = None, (0, 0)
    for i in range(len(weights)):
        for j in range(i, min(len(weights), i + SPAN + 1)):
            if positions and positions[j] - positions[i] > SPAN:
                break
            if best is None or sums[j + 1] - sums[i] > best:
                best, found = sums[j + 1] - sums[i], (i, j)
    return found


def bounds(i: int, j: int, n: int) -> tuple[int, int]:
    """Token range of a window widened to the left, then to the right, to SPAN + 1 tokens."""
    missing = max(SPAN - (j - i), 0)
    start = max(0, i - missing)
    return start, max(j, min(n - 1, j + missing - (i - start)))


def marked(tokens: list[str], hits: set[int], start: int, end: int) -> str:
    """Tokens joined by spaces; a run of hits opens a span that closes before the next other token."""
    parts, inside = [], False
    for k in range(start, min(end, len(tokens) - 1) + 1):
        if (k in hits) != inside:
            parts.append("</span>" if inside else "<span>")
            inside = not inside
        parts.append(tokens[k] + (" " if k != end else ""))
    return "".join(parts) + ("</span>" if inside else "")


def snippet(text: str, hits: dict[int, str], weights: dict[str, int], mode: str = "compatible") -> str:
    """``compatible`` takes the window's hit numbers as token places; ``intended`` takes the hits' places."""
    tokens = re.findall(TOKEN, text)
    if not tokens:
        return ""
    places = sorted(hits)
    own = [weights.get(hits[p], 0) for p in places]
    if mode == "compatible":
        i, j = best_window(own)
    else:
        i, j = best_window(own, places)
        i, j = (places[i], places[j]) if places else (0, 0)
    return marked(tokens, set(places), *bounds(i, j, len(tokens)))


def with_snippets(rows: DataFrame, hits: DataFrame, words: list[str], weights: dict[str, int], text: str = "body", mode: str = "compatible") -> DataFrame:
    """``rows`` (a page of results) with a ``content`` column; ``hits`` has a position array per word."""
    joined = rows.join(hits.drop("dl"), "doc_id", "left")
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("content", T.StringType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            out = []
            for r in range(batch.num_rows):
                found = {p: w for k, w in enumerate(words) for p in get[f"p{k}"][r] or []}
                out.append(snippet(get[text][r] or "", found, weights, mode))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], names=schema.names)

    return joined.mapInArrow(build, schema)


def stemmed_weights(weights: dict[str, int], words_of, mode: str = "compatible") -> dict[str, int]:
    """Weights by single word: only whole entries count when ``compatible``, else each word of an entry."""
    if mode == "compatible":
        return weights
    return {w: n for entry, n in weights.items() for w in words_of(entry)} | weights


def search(index, docs: DataFrame, text: str, accuracy: float = 0.5, limit: int = 100, params=None, modes=None, doc_id: str = "doc_id", title: str | None = None, content: str = "text", url: str | None = None) -> DataFrame:
    """Results with title, marked content, url and score."""
    from ..plans.query import Modes, parse
    from ..plans.rank import RankerParams, Scores, top

    params, modes = params or RankerParams(), modes or Modes()
    query = parse(text, modes)
    scores = Scores(index, query, params, modes)
    best = top(scores.frame(accuracy), limit, modes.order)
    ids = None
    if limit <= 1000:  # one page of results: found once, then looked up
        found = best.collect()
        ids = [r.doc_id for r in found]
        best = docs.sparkSession.createDataFrame(found, best.schema)
    head = F.col(title) if title else F.lit("")
    slim = docs.select(F.col(doc_id).alias("doc_id"), head.alias("title"), F.concat(F.coalesce(head, F.lit("")), F.coalesce(F.col(content), F.lit(""))).alias("body"), (F.col(url) if url else F.lit("")).alias("url"))
    hits = index.hits(scores.words)
    if ids is not None:
        slim, hits = slim.filter(F.col("doc_id").isin(ids)), hits.filter(F.col("doc_id").isin(ids))
    rows = slim.join(F.broadcast(best) if limit <= 10_000 else best, "doc_id")
    weights = stemmed_weights(query.weights, index.analyzer.words, modes.snippet)
    out = with_snippets(rows, hits, scores.words, weights, "body", modes.snippet)
    return out.select("doc_id", "title", "content", "url", "score")
