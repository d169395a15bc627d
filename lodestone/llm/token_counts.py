"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces ending at each
place of the text; dynamic programming carries the best score up to there and
how many pieces it takes.  Ties are those of the exact tokenizer
(``tokenizers``' unigram model): of equal scores the piece that starts first
wins, and a character without a piece of its own may be unknown at the least
score minus 10, counting as its bytes.

Where no piece goes on after a word into the next space mark, the best path
always has a border there, and where scores are whole numbers sums are exact
in any order, so words are counted one by one and remembered.  Both are
checked on the vocabulary; otherwise whole texts are counted in one go.

Defined results: a null text counts as empty and has no tokens; repeated rows
are counted each; ids may be of any type or null; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .tokens import public

SPACE = "\u2581"
UNKNOWN_PENALTY = 10.0
_COUNTS = [T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())]


class Counter:
    """Best score and number of tokens of texts under pieces with scores."""

    def __init__(self, pieces: dict[str, float], remember: int = 1_000_000):
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), float(score)))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.by_word = SPACE in self.single and float(self.unknown).is_integer() and all(float(s).is_integer() and not inner.search(p) for p, s in pieces.items())
        lines = "" if any("\n" in p for p in pieces) else "\\n"
        self.words = re.compile(f"{SPACE}*[^{SPACE}{lines}]+|{SPACE}+" + ("|\\n+" if lines else ""))
        self.known: dict[str, tuple[int, float]] = {}
        self.remember = remember

    def path(self, text: str) -> tuple[int, float]:
        """(tokens, score) of the best path over the whole of ``text``."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        gaps = not self.single.issuperset(text)
        done = 0
        for end, (size, score) in self.automaton.iter(text):
            e = end + 1
            if gaps:
                while done < end:
                    done += 1
                    self._gap(text, done, best, count)
            s = e - size
            total = best[s] + score
            if best[e] is None or total > best[e]:
                best[e] = total
                count[e] = count[s] + 1
        if gaps:
            for e in range(done + 1, n + 1):
                self._gap(text, e, best, count)
        return count[n], best[n]

    def _gap(self, text: str, e: int, best: list, count: list) -> None:
        c = text[e - 1]
        if c not in self.single:
            total = best[e - 1] + self.unknown
            if best[e] is None or total > best[e]:
                best[e] = total
                count[e] = count[e - 1] + len(c.encode("utf-8", "surrogatepass"))

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.path(marked)
        known, total, score = self.known, 0, 0.0
        for w in self.words.findall(marked):
            found = known.get(w)
            if found is None:
                found = self.path(w)
                if len(w) <= 64:
                    if len(known) >= self.remember:
                        known.clear()
                    known[w] = found
            total += found[0]
            score += found[1]
        return total, score


def sentencepiece_vocabulary(path: str | None = None) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public("piece_bpe_32k.model"))
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


@lru_cache(maxsize=2)
def counter(path: str | None = None) -> Counter:
    return Counter(sentencepiece_vocabulary(path))


def _count(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    each = counter(path)
    for batch in slices(batches):
        found = [each.count(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["id", "n_tokens", "score"])


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, score) of every row."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), *_COUNTS])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(lambda it: _count(it, vocabulary), schema)
