"""Ranking: one frame of leaf frequencies, then column expressions.

All leaves of a query (terms and phrases) are counted in one pass over the
index; AND, OR, NOT and sums are expressions on one row per document.  Only a
division by the largest score needs an aggregate of one row.

On a stored index only documents that hold one of the query's words are rows.
All others have one and the same score, which is carried along as a number,
and they are named only where that score is asked for (by a NOT, say).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .query import And, Modes, Node, Not, Or, Phrase, Query, Term, parse


@dataclass(frozen=True)
class RankerParams:
    k1: float = 1.5
    b: float = 0.75
    phrase_boost: float = 1.35
    exact_match_weight: float = 0.6

    @property
    def term_frequency_weight(self) -> float:
        return 1 - self.exact_match_weight


def idf(n_docs: int, df: int) -> float:
    return math.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25(f: Column, dl: Column, avg_dl: float, weight: float, p: RankerParams) -> Column:
    """``weight`` is the leaf's inverse document frequency."""
    ratio = dl / F.lit(avg_dl if avg_dl else 1.0)
    return F.when(f > 0, F.lit(weight) * (f * (p.k1 + 1)) / (f + p.k1 * ((1 - p.b) + p.b * ratio))).otherwise(0.0)


def phrase_frequency(places: list[Column], mode: str = "compatible") -> Column:
    """How often words follow one another, from their position arrays.

    ``compatible`` passes over words that the document doesn't hold at all,
    except the first; ``intended`` wants all of them.
    """
    if not places:
        return F.lit(0)
    if len(places) == 1:
        return F.size(places[0])
    present = F.array(*places)
    if mode == "compatible":
        present = F.filter(present, lambda a: F.size(a) > 0)
    starts = F.transform(present, lambda a, j: F.transform(a, lambda x: x - j))
    first = F.element_at(starts, 1)
    together = F.aggregate(F.slice(starts, 2, len(places)), first, lambda acc, a: F.array_intersect(acc, a))
    return F.when(F.size(places[0]) > 0, F.size(together)).otherwise(0)


@dataclass(frozen=True)
class Score:
    """A score of each row, and that of documents without any of the words."""

    of: Column
    rest: float = 0.0

    def __add__(self, other: Score) -> Score:
        return Score(self.of + other.of, self.rest + other.rest)

    def __rmul__(self, factor: float) -> Score:
        return Score(factor * self.of, factor * self.rest)


def _least(scores: list[Score]) -> Score:
    return scores[0] if len(scores) == 1 else Score(F.least(*[s.of for s in scores]), min(s.rest for s in scores))


class Scores:
    """A scored query over one index."""

    def __init__(self, index, query: Query, params: RankerParams = RankerParams(), modes: Modes = Modes()):
        self.index, self.query, self.params = index, query, params
        leaves = query.leaves()
        words: dict[str, int] = {}
        slots: list[list[str]] = []
        for leaf in leaves:
            if isinstance(leaf, Term) and modes.term == "compatible":
                own = [leaf.text]
            else:
                own = index.analyzer.words(leaf.text)
            slots.append(own)
            for w in own:
                words.setdefault(w, len(words))
        self.words = list(words)
        self.term_words = {leaf.text for leaf in leaves if isinstance(leaf, Term)}
        hits = index.hits(self.words) if index.stored else index.positions(self.words)
        places = [[F.col(f"p{words[w]}") for w in own] for own in slots]
        counted = [phrase_frequency(p, modes.phrase).cast("int").alias(f"f{k}") for k, p in enumerate(places)]
        rows = hits.select("doc_id", "dl", *counted)
        # a scan is done once; an index is read again, since it is no more than the words' postings
        self.rows = rows if index.stored else cut(rows, "frequencies")
        sums = self.rows.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"), *[F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"d{k}") for k in range(len(leaves))]).first()
        n, tokens = index.totals() if index.stored else (sums.n, sums.dl or 0)
        self.others = n - sums.n
        avg = tokens / n if n else 0.0
        raw = [Score(bm25(F.col(f"f{k}"), F.col("dl"), avg, idf(n, sums[f"d{k}"] or 0), params)) for k in range(len(leaves))]
        self.scored = dict(zip(leaves, self.normalized(raw)))
        self.leaf = {leaf: s.of for leaf, s in self.scored.items()}

    def normalized(self, scores: list[Score]) -> list[Score]:
        """Each divided by its largest value, if that is positive; one aggregate for all."""
        if not scores:
            return []
        most = self.rows.agg(*[F.max(s.of).alias(f"m{k}") for k, s in enumerate(scores)]).first()
        out = []
        for s, m in zip(scores, most):
            m = max([x for x in (m, s.rest if self.others else None) if x is not None], default=0.0)
            out.append(Score(s.of / F.lit(m), s.rest / m) if m > 0 else s)
        return out

    def tree(self, node: Node) -> Score:
        match node:
            case Not(of):
                s = self.tree(of)
                return Score(F.lit(1.0) - s.of, 1.0 - s.rest)
            case And(a, b):
                return _least([self.tree(a), self.tree(b)])
            case Or(a, b):
                x, y = self.tree(a), self.tree(b)
                return Score(F.greatest(x.of, y.of), max(x.rest, y.rest))
        return self.scored[node]

    def combined(self, scores: list[Score]) -> Score:
        """Weighted sum of the normalised sum and the minimum of scores."""
        p = self.params
        total = reduce(lambda x, y: x + y, reversed(scores))
        return p.term_frequency_weight * self.normalized([total])[0] + p.exact_match_weight * _least(scores)

    def score(self) -> Score:
        terms = [self.scored[t] for t in self.query.terms]
        phrases = [self.tree(n) for n in self.query.phrases]
        if not phrases:
            return self.combined(terms)
        if not terms:
            return self.combined(phrases)
        both = [self.combined(terms), self.params.phrase_boost * self.combined(phrases)]
        return self.normalized([self.combined(both)])[0]

    def frame(self, above: float | None = None) -> DataFrame:
        """(doc_id, score) of every document or, where ``above`` is given, of those that score at least as much."""
        s = self.score()
        rows = self.rows.select("doc_id", s.of.cast("double").alias("score"))
        if self.others and (above is None or s.rest >= above):
            rest = self.index.doc_stats().select("doc_id").join(self.rows.select("doc_id"), "doc_id", "left_anti")
            rows = rows.unionByName(rest.select("doc_id", F.lit(float(s.rest)).alias("score")))
        return rows if above is None else accurate(rows, above)


def rank(index, text: str, params: RankerParams = RankerParams(), modes: Modes = Modes()) -> DataFrame:
    """(doc_id, score) of every document for a query."""
    return Scores(index, parse(text, modes), params, modes).frame()


def accurate(scores: DataFrame, accuracy: float = 0.5) -> DataFrame:
    return scores.filter(F.col("score") >= accuracy)


def top(scores: DataFrame, n: int = 100, order: str = "intended") -> DataFrame:
    """The ``n`` best, ties by id; ``compatible`` order takes any ``n``, here the least ids."""
    return scores.orderBy("doc_id").limit(n) if order == "compatible" else scores.orderBy(F.desc("score"), "doc_id").limit(n)
