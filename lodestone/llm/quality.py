"""Quality rules with host-level verdicts.

Every document is measured once, the documents' rule failures are summed by
host, each host's failure rate is shrunk with a beta prior fitted to all hosts
by the method of moments, and the host's verdict is joined back.  A host is
poor if its shrunk rate lies above the prior's mean by ``host_deviations``
standard deviations of the host's posterior: by 0.6745 of them it fails more
often than the corpus with a probability of three quarters.  One soft failure
is then enough for its documents to go.

Defined results: a null text counts as empty (no words, so it fails); a null
host is a host of its own; repeated rows are measured and counted each; an
empty table gives an empty result; ``filter_documents`` carries all columns
along untouched, whatever their names; ``judge`` gives the id and the host
under their own names or, where one of them is that of a measure or verdict,
as ``id`` and ``host``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, WORD, count_blanks, cut, packed, slices, unpacked, utf8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds.  ``base`` rules reject by themselves, ``soft`` ones together or on a poor host."""

    min_words: int = 50
    max_repeat_percent: int = 50
    symbols_per_hundred_words: int = 30
    min_mean_word_chars: float = 2.0
    max_mean_word_chars: float = 15.0
    max_dup_line_percent: int = 30
    host_deviations: float = 0.6745
    soft_failures: int = 2
    #: Up to so many poor hosts are broadcast; beyond, the join is shuffled.
    broadcast_hosts: int = 20_000


def repeat_words(words: list) -> int:
    """Words that stand in a 3-word window found at least twice."""
    grams = list(zip(words, words[1:], words[2:]))
    first = dict.fromkeys(grams)
    if len(first) == len(grams):
        return 0
    seen: set = set()
    often: set = set()
    for g in grams:
        if g in seen:
            often.add(g)
        else:
            seen.add(g)
    covered, last = 0, 0
    for i, g in enumerate(grams):
        if g in often:
            covered += i + 3 - max(i, last)
            last = i + 3
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The measures of one text, in the order of MEASURES."""
    text = text or ""
    found = utf8(text).split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(found),
        len(text) - count_blanks(text),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(found),
        len(lines),
    )


def _measured(batches: Iterator[pa.RecordBatch], text: str, names: list[str], within: str | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        column = batch.column(batch.schema.get_field_index(within or text))
        rows = [measure(x) for x in (column.field(text) if within else column).to_pylist()]
        columns = list(zip(*rows)) if rows else [[]] * len(MEASURES)
        kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays(kept + [pa.array(c, pa.int64()) for c in columns], names=[*names, *MEASURES])


def with_measures(df: DataFrame, text: str = "text", within: str | None = None) -> DataFrame:
    """``df`` without its text column, with the text's measures instead; the text may be a field ``within`` a column, which stays."""
    kept = [f for f in df.schema.fields if within or f.name != text]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in MEASURES)])
    names = [f.name for f in kept]
    return df.mapInArrow(lambda it: _measured(it, text, names, within), schema)


def base_failed(r: QualityRules) -> Column:
    return (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * F.col("n_words"))


def soft_rules(r: QualityRules) -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "symbols": 100 * F.col("n_symbols") > r.symbols_per_hundred_words * n,
        "word_length": (F.col("word_chars") < r.min_mean_word_chars * n) | (F.col("word_chars") > r.max_mean_word_chars * n),
        "dup_lines": 100 * F.col("n_dup_lines") > r.max_dup_line_percent * F.col("n_lines"),
    }


def beta_prior(hosts: int, docs: float, fails: float, weighted: float) -> tuple[float, float]:
    """Beta parameters by the method of moments.

    ``weighted``: sum over hosts of documents times the squared rate.  Where the hosts differ no more than chance would make them,
    the prior is as strong as all documents of a mean host together.
    """
    if not docs:
        return 1.0, 1.0
    mean = min(max(fails / docs, 1e-6), 1 - 1e-6)
    spread = weighted / docs - (fails / docs) ** 2
    chance = mean * (1 - mean) * hosts / docs
    between = max(spread - chance, 0.0)
    most = max(docs / max(hosts, 1), 1.0)
    strength = min(mean * (1 - mean) / between - 1, most) if between > 0 else most
    strength = max(strength, 1.0)
    return mean * strength, (1 - mean) * strength


def host_rates(measured: DataFrame, rules: QualityRules) -> DataFrame:
    """A row per ``host``: documents, failing ones, their shrunk rate, and whether the host is poor.

    Only counts are shuffled, pre-aggregated by task, so a hot host costs no
    more than any other.
    """
    any_soft = None
    for c in soft_rules(rules).values():
        any_soft = c if any_soft is None else any_soft | c
    bad = (base_failed(rules) | any_soft).cast("long")
    hosts = cut(measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(bad).alias("fails")), "hosts")
    d, f = F.col("docs").cast("double"), F.col("fails").cast("double")
    s = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(d).alias("docs"), F.sum(f).alias("fails"), F.sum(f * f / d).alias("weighted")).first()
    a, b = beta_prior(s.hosts, s.docs or 0.0, s.fails or 0.0, s.weighted or 0.0)
    rate = F.col("rate")
    deviation = F.sqrt(rate * (1 - rate) / (d + (a + b + 1)))
    return hosts.withColumn("rate", (f + a) / (d + (a + b))).withColumn("poor", rate - F.lit(a / (a + b)) >= rules.host_deviations * deviation)


def verdicts(measured: DataFrame, rates: DataFrame, rules: QualityRules) -> DataFrame:
    """``measured`` with base_failed, host_poor and kept.

    A document goes if a base rule rejects it, if so many soft rules do, or if
    one does and its host is poor.  A document without any failure stays, even
    on a poor host.
    """
    poor = rates.filter("poor").select(F.col("host").alias("poor_host"), F.lit(True).alias("poor"))
    if poor.count() <= rules.broadcast_hosts:
        poor = F.broadcast(poor)
    soft = sum((c.cast("int") for c in soft_rules(rules).values()), F.lit(0))
    out = measured.join(poor, F.col("host").eqNullSafe(F.col("poor_host")), "left")
    out = out.withColumn("base_failed", base_failed(rules)).withColumn("host_poor", F.coalesce("poor", F.lit(False)))
    keep = ~F.col("base_failed") & (soft < F.when(F.col("host_poor"), 1).otherwise(rules.soft_failures))
    return out.withColumn("kept", keep).drop("poor_host", "poor")


def judge(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """Measures and verdicts of every document: its ``key`` and ``host``, no text."""
    slim = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    measured = cut(with_measures(slim), "measures")
    own = (*MEASURES, "base_failed", "host_poor", "kept")
    out = verdicts(measured, host_rates(measured, rules), rules)
    return out if key in own or host in own else out.toDF(*[{"id": key, "host": host}.get(n, n) for n in out.columns])


def filter_documents(df: DataFrame, host: str = "source", text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The kept documents with their columns.

    Texts are measured once, beside their rows in a stored table, and never shuffled.
    """
    rows = cut(with_measures(packed(df, host=F.col(f"`{host}`")), text, "row"), "measured")
    return unpacked(verdicts(rows, host_rates(rows, rules), rules).filter("kept"))


def oracle(rules: QualityRules = QualityRules()) -> str:
    """The verdicts on ``documents`` as SQL for DuckDB."""
    r = rules
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
o AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM o, (VALUES (0), (1), (2)) s(k) GROUP BY doc_id),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed,
  CAST(100 * n_symbols > {r.symbols_per_hundred_words} * n_words AS INTEGER)
  + CAST(word_chars < {r.min_mean_word_chars} * n_words OR word_chars > {r.max_mean_word_chars} * n_words AS INTEGER)
  + CAST(100 * n_dup_lines > {r.max_dup_line_percent} * n_lines AS INTEGER) AS soft FROM m),
h AS (SELECT source, count(*) AS docs, sum(CAST(base_failed OR soft > 0 AS INTEGER)) AS fails FROM f GROUP BY source),
s AS (SELECT count(*) AS hosts, sum(docs) AS docs, sum(fails) AS fails, sum(fails * fails / docs) AS weighted FROM h),
q AS (SELECT *, least(greatest(fails / docs, 1e-6), 1 - 1e-6) AS mean, greatest(docs / greatest(hosts, 1), 1.0) AS most FROM s),
b AS (SELECT *, greatest(weighted / docs - (fails / docs) ** 2 - mean * (1 - mean) * hosts / docs, 0) AS between_hosts FROM q),
e AS (SELECT mean, greatest(CASE WHEN between_hosts > 0 THEN least(mean * (1 - mean) / between_hosts - 1, most) ELSE most END, 1.0) AS strength FROM b),
u AS (SELECT source, mean, (fails + mean * strength) / (docs + strength) AS rate, docs + strength + 1 AS n FROM h, e),
v AS (SELECT source, rate - mean >= {r.host_deviations} * sqrt(rate * (1 - rate) / n) AS poor FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND soft < CASE WHEN poor THEN 1 ELSE {r.soft_failures} END AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
