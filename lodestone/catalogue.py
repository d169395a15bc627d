"""Registered queries, each over its whole tables, and their SQL counterparts.

The SQL is written from the operators' definitions, by itself: ``_leaf`` and
``_scored`` below only spell out the relational form of a leaf's score.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import html as H
from .functions import stemmer as P
from .functions import text as X
from .functions import urls as U
from .functions.stemmer import stem_word
from .operators import crawl as C
from .operators import index as I
from .operators import snippets as S
from .plans import rank as R
from .plans.query import Modes
from .sources.fetch import table_fetcher
from .sources.shared import shared_dir
from .sources.store import Store, proxies, stored_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


PLAIN = I.Analyzer(stem=False)


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.analyze(_documents(spark, sf_dir), PLAIN)


_TOKEN = X.TOKEN.replace("'", "''")
_TOKENS = f"tok AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS a FROM documents)"
_TERMS = f"""{_TOKENS},
raw AS (SELECT doc_id, a[i] AS token, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM tok)),
t AS (SELECT doc_id, pos, replace(replace(replace(lower(token), '_', ''), '''', ''), '-', '') AS term FROM raw)"""


# text and index ---------------------------------------------------------------


@query(f"WITH {_TOKENS}, r AS (SELECT unnest(a) AS token FROM tok) SELECT token, count(*) AS n FROM r GROUP BY token")
def tokenize_counts(spark, sf_dir):
    tokens = _documents(spark, sf_dir).select(F.explode(X.tokenize(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS n FROM t GROUP BY term")
def normalize_terms(spark, sf_dir):
    terms = _documents(spark, sf_dir).select(F.explode(X.tokenize(F.col("text"))).alias("token"))
    return terms.groupBy(X.normalize(F.col("token")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TERMS} SELECT term, doc_id, pos FROM t WHERE term <> ''")
def postings(spark, sf_dir):
    return I.postings(_analyzed(spark, sf_dir))


@query(
    f"""WITH {_TERMS} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions
FROM t WHERE term <> '' GROUP BY term, doc_id"""
)
def postings_nested(spark, sf_dir):
    nested = I.nested_postings(_analyzed(spark, sf_dir))
    return nested.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(len(a) AS INTEGER) AS dl FROM tok")
def doc_lengths(spark, sf_dir):
    return I.doc_stats(_analyzed(spark, sf_dir))


@query(f"WITH {_TOKENS} SELECT count(*) AS n_docs, CAST(sum(len(a)) AS BIGINT) AS sum_dl, round(sum(len(a)) / count(*), 6) AS avg_dl FROM tok")
def corpus_stats(spark, sf_dir):
    return I.corpus_stats(I.doc_lengths(_documents(spark, sf_dir))).withColumn("avg_dl", F.round("avg_dl", 6))


@query(f"WITH {_TERMS} SELECT term, doc_id, count(*) AS tf FROM t WHERE term <> '' GROUP BY term, doc_id")
def term_frequency(spark, sf_dir):
    return I.term_frequencies(I.nested_postings(_analyzed(spark, sf_dir)))


@query(f"WITH {_TERMS} SELECT term, count(DISTINCT doc_id) AS df FROM t WHERE term <> '' GROUP BY term")
def document_frequency(spark, sf_dir):
    return I.document_frequencies(I.nested_postings(_analyzed(spark, sf_dir)))


@query(f"WITH {_TOKENS}, h AS (SELECT doc_id % 2 AS half, sum(len(a)) AS s, count(*) AS n FROM tok GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_docs, round(sum(s) / sum(n), 6) AS avg_dl FROM h")
def incremental_avg_length(spark, sf_dir):
    """Statistics of two batches, added up."""
    stats = I.doc_stats(_analyzed(spark, sf_dir))
    halves = [I.corpus_stats(stats.filter(F.pmod("doc_id", F.lit(2)) == k)) for k in (0, 1)]
    both = halves[0].unionByName(halves[1]).agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("s"))
    return both.select("n_docs", F.round(F.col("s") / F.col("n_docs"), 6).alias("avg_dl"))


_STOP = ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


@query(f"WITH {_TERMS} SELECT term, count(*) AS n FROM t WHERE term <> '' AND term NOT IN ({', '.join(repr(w) for w in _STOP)}) GROUP BY term")
def stopword_filter(spark, sf_dir):
    kept = I.analyze(_documents(spark, sf_dir), I.Analyzer(stem=False, stop_words=tuple(_STOP)))
    return I.postings(kept).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS n FROM t WHERE strlen(term) BETWEEN 3 AND 20 GROUP BY term")
def valid_word_filter(spark, sf_dir):
    kept = I.analyze(_documents(spark, sf_dir), I.Analyzer(stem=False, valid_only=True))
    return I.postings(kept).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(regexp_replace(translate(text, chr(10) || chr(13) || chr(9), ''), ' +', ' ', 'g')) AS cleaned FROM documents")
def clean_snippet(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(X.clean_snippet(F.col("text"))).alias("cleaned"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents")
def split_by_space(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.size(X.split_by_space(F.col("text"))).cast("long").alias("n"))


@query("SELECT item_id, text AS phrase FROM benchmark")
def unquote_phrases(spark, sf_dir):
    quoted = _table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit('""'), "text", F.lit('""')).alias("q"))
    return quoted.select("item_id", X.unquoted(F.col("q")).alias("phrase"))


# ranking ----------------------------------------------------------------------

_BASE = f"""{_TERMS},
st AS (SELECT doc_id, len(a) AS dl FROM tok),
cs AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM st)"""


def _leaf(k: str, words: list[str], strict: bool = False, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs for one leaf: nk(doc_id, s), its score divided by the largest, in every document."""
    slots = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    need = f"n = {len(words)}" if strict else "true"
    return f""",
sl{k}(slot, term) AS (VALUES {slots}),
pr{k} AS (SELECT doc_id, slot, term, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY doc_id) AS n, min(slot) OVER (PARTITION BY doc_id) AS m
  FROM (SELECT DISTINCT s.slot, s.term, t.doc_id FROM sl{k} s JOIN t ON t.term = s.term) WINDOW w AS (PARTITION BY doc_id ORDER BY slot)),
sx{k} AS (SELECT p.doc_id, t.pos - p.j AS start, n, count(*) AS c FROM pr{k} p JOIN t ON t.doc_id = p.doc_id AND t.term = p.term WHERE m = 0 AND {need} GROUP BY 1, 2, 3),
f{k} AS (SELECT doc_id, count(*) AS f FROM sx{k} WHERE c = n GROUP BY doc_id),
d{k} AS (SELECT count(*) AS df FROM f{k}),
s{k} AS (SELECT st.doc_id, CASE WHEN f > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * (f * ({k1} + 1)) / (f + {k1} * ((1 - {b}) + {b} * (dl / avgdl))) ELSE 0 END AS s
  FROM st CROSS JOIN cs CROSS JOIN d{k} LEFT JOIN f{k} USING (doc_id)),
n{k} AS (SELECT doc_id, CASE WHEN (SELECT max(s) FROM s{k}) > 0 THEN s / (SELECT max(s) FROM s{k}) ELSE s END AS s FROM s{k})"""


def _norm(name: str, of: str) -> str:
    """A CTE with the scores of another divided by the largest."""
    return f",\n{name} AS (SELECT doc_id, CASE WHEN (SELECT max(s) FROM {of}) > 0 THEN s / (SELECT max(s) FROM {of}) ELSE s END AS s FROM {of})"


def _alone(name: str, of: str) -> str:
    """Combination of a single score: its normalised value and itself, weighted."""
    return _norm(f"{name}n", of) + f",\n{name} AS (SELECT a.doc_id, 0.4 * a.s + 0.6 * b.s AS s FROM {name}n a JOIN {of} b USING (doc_id))"


def _pair(name: str, a: str, b: str) -> str:
    """Combination of two scores: normalised sum and minimum, weighted."""
    return f",\n{name}t AS (SELECT x.doc_id, x.s + y.s AS s, least(x.s, y.s) AS l FROM {a} x JOIN {b} y USING (doc_id))" + _norm(f"{name}n", f"{name}t") + f",\n{name} AS (SELECT a.doc_id, 0.4 * a.s + 0.6 * b.l AS s FROM {name}n a JOIN {name}t b USING (doc_id))"


def _expr(name: str, leaves: list[str], expression: str) -> str:
    first, *rest = leaves
    return f",\n{name} AS (SELECT {first}.doc_id, {expression} AS s FROM {first}{''.join(f' JOIN {r} USING (doc_id)' for r in rest)})"


def _scored(parts: str, last: str, where: str = "true", tail: str = "") -> str:
    return f"WITH {_BASE}{parts}\nSELECT doc_id, round(s, 6) AS score FROM {last} WHERE {where} {tail}"


def _rank(text: str, modes: Modes = Modes(), params: R.RankerParams = R.RankerParams(), where: str = "true"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores = R.rank(I.ScanIndex(_documents(spark, sf_dir), PLAIN), text, params, modes)
        return scores.filter(where).select("doc_id", F.round("score", 6).alias("score"))

    return run


def ranked(name: str, text: str, sql: str, **how) -> None:
    QUERIES[name] = _rank(text, **how)
    ORACLE[name] = sql


ranked("bm25_term", "the", _scored(_leaf("0", ["the"]) + _alone("r", "n0"), "r"))
ranked("bm25_phrase_compatible", '"the and of"', _scored(_leaf("0", ["the", "and", "of"]) + _alone("r", "n0"), "r"))
ranked("bm25_phrase_strict", '"of the"', _scored(_leaf("0", ["of", "the"], strict=True) + _alone("r", "n0"), "r"), modes=Modes(phrase="intended"))
ranked("bool_and", '"the" and "is of"', _scored(_leaf("0", ["the"]) + _leaf("1", ["is", "of"]) + _expr("e", ["n0", "n1"], "least(n0.s, n1.s)") + _alone("r", "e"), "r"))
ranked("bool_or", '"the" or "de la"', _scored(_leaf("0", ["the"]) + _leaf("1", ["de", "la"]) + _expr("e", ["n0", "n1"], "greatest(n0.s, n1.s)") + _alone("r", "e"), "r"))
ranked("bool_not", 'not "the"', _scored(_leaf("0", ["the"]) + _expr("e", ["n0"], "1 - n0.s") + _alone("r", "e"), "r"))
ranked("bool_and_not", '"the of" and not "with"', _scored(_leaf("0", ["the", "of"]) + _leaf("1", ["with"]) + _expr("e", ["n0", "n1"], "least(n0.s, 1 - n1.s)") + _alone("r", "e"), "r"))
ranked(
    "bool_nested",
    '("the and" or "of the") not "with"',
    _scored(_leaf("0", ["the", "and"]) + _leaf("1", ["of", "the"]) + _leaf("2", ["with"]) + _expr("e", ["n0", "n1"], "greatest(n0.s, n1.s)") + _expr("g", ["n2"], "1 - n2.s") + _pair("r", "e", "g"), "r"),
)
ranked("bool_terms", "the & (of | is)".replace("&", "and").replace("|", "or"), _scored(_leaf("0", ["the"]) + _leaf("1", ["of"]) + _leaf("2", ["is"]) + _expr("e", ["n0", "n1", "n2"], "least(n0.s, greatest(n1.s, n2.s))") + _alone("r", "e"), "r"), modes=Modes.intended())
ranked("combine_terms", "the is", _scored(_leaf("0", ["the"]) + _leaf("1", ["is"]) + _pair("r", "n0", "n1"), "r"))
_MIXED = _leaf("0", ["the"]) + _leaf("1", ["is", "of"]) + _alone("a", "n0") + _alone("b", "n1") + _expr("c", ["b"], "1.35 * b.s") + _pair("m", "a", "c") + _norm("r", "m")
ranked("mixed_term_phrase_boost", 'the "is of"', _scored(_MIXED, "r"))
ranked("accuracy_filter", 'the "is of"', _scored(_MIXED, "r", "s >= 0.5"), where="score >= 0.5")
ranked("ranker_params_variant", "the", _scored(_leaf("0", ["the"], k1=1.2, b=0.5) + _norm("x", "n0") + _expr("r", ["x"], "x.s"), "r"), params=R.RankerParams(k1=1.2, b=0.5, exact_match_weight=0.3))
ranked("term_lookup_is_raw", "The", _scored(_leaf("0", ["The"]) + _alone("r", "n0"), "r"))
ranked("term_lookup_analysed", "The", _scored(_leaf("0", ["the"]) + _alone("r", "n0"), "r"), modes=Modes.intended())


@query(_scored(_MIXED, "r", "s >= 0.1", "ORDER BY round(s, 9) DESC, doc_id LIMIT 100"))
def ranked_topk(spark, sf_dir):
    scores = R.rank(I.ScanIndex(_documents(spark, sf_dir), PLAIN), 'the "is of"')
    best = R.top(R.accurate(scores.withColumn("score", F.round("score", 9)), 0.1), 100)
    return best.select("doc_id", F.round("score", 6).alias("score"))


@query(_scored(_MIXED, "r", "s >= 0.1", "ORDER BY doc_id LIMIT 100"))
def natural_order_100(spark, sf_dir):
    scores = R.rank(I.ScanIndex(_documents(spark, sf_dir), PLAIN), 'the "is of"')
    return R.top(R.accurate(scores, 0.1), 100, "compatible").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BASE}{_leaf("0", ["the"])}{_alone("r", "n0")}
SELECT r.doc_id, d.lang, d.source, round(r.s, 6) AS score, l.quality FROM r JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) WHERE s >= 0.5""")
def result_join(spark, sf_dir):
    best = R.accurate(R.rank(I.ScanIndex(_documents(spark, sf_dir), PLAIN), "the"), 0.5)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return best.join(docs, "doc_id").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", "source", F.round("score", 6).alias("score"), "quality")


@query(f"WITH {_TERMS} SELECT doc_id, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM t WHERE term IN ('the', 'of') GROUP BY doc_id")
def hit_positions(spark, sf_dir):
    hits = I.ScanIndex(_documents(spark, sf_dir), PLAIN).positions(["the", "of"])
    both = hits.select("doc_id", F.array_sort(F.concat("p0", "p1")).alias("p")).filter("size(p) > 0")
    return both.select("doc_id", F.array_join(F.col("p").cast("array<string>"), " ").alias("positions"))


def _stems(words: str) -> str:
    """CTEs from words(word) to stems(word, stem): the Porter2 definition step by step, for words without apostrophes."""

    def short(c: str) -> str:
        return f"(regexp_matches({c}, '^[aeiouy][^aeiouy]$') OR regexp_matches({c}, '[^aeiouy][aeiouy][^aeiouywxY]$'))"

    def suffixes(table, region, put) -> str:
        cases = " ".join(f"WHEN suffix(w, '{x}') THEN CASE WHEN len(w) - {len(x)} >= {region(x)} {put(x, to)} ELSE w END" for x, to in table)
        return f"CASE {cases} ELSE w END"

    def put(x: str, to: str, also: str = "") -> str:
        return f"{also} THEN left(w, -{len(x)}) || '{to}'"

    only = {"ogi": "AND suffix(w, 'logi')", "li": f"AND regexp_matches(w, '[{P._LI}]li$')", "ion": "AND regexp_matches(w, '[st]ion$')"}
    special = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in P._SPECIAL.items()) + "}[word]"
    kept = ", ".join(repr(w) for w in sorted(P._KEPT_AFTER_1A))
    first = "regexp_extract({}, '^.*?[aeiouy][^aeiouy]')"
    ends = "CASE " + " ".join(f"WHEN suffix(w, '{x}') THEN '{x}'" for x in ("eedly", "ingly", "edly", "eed", "ing", "ed")) + " END"
    step2 = suffixes(P._STEP2, lambda x: "r1", lambda x, to: put(x, to, only.get(x, "")))
    step3 = suffixes(P._STEP3, lambda x: "r2" if x == "ative" else "r1", put)
    step4 = suffixes([(x, "") for x in P._STEP4], lambda x: "r2", lambda x, to: put(x, to, only.get(x, "")))
    return f"""
p0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words}),
p1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN len(regexp_extract(w, '^(gener|commun|arsen)'))
  WHEN {first.format('w')} <> '' THEN len({first.format('w')}) ELSE len(w) END AS r1 FROM p0),
p2 AS (SELECT *, CASE WHEN {first.format('substr(w, r1 + 1)')} <> '' THEN r1 + len({first.format('substr(w, r1 + 1)')}) ELSE len(w) END AS r2 FROM p1),
p3 AS (SELECT word, r1, r2, CASE WHEN suffix(w, 'sses') THEN left(w, -2) WHEN suffix(w, 'ied') OR suffix(w, 'ies') THEN CASE WHEN len(w) > 4 THEN left(w, -2) ELSE left(w, -1) END
  WHEN suffix(w, 's') AND NOT suffix(w, 'us') AND NOT suffix(w, 'ss') AND regexp_matches(left(w, -2), '[aeiouy]') THEN left(w, -1) ELSE w END AS w FROM p2),
p4 AS (SELECT *, {ends} AS x FROM p3),
p5 AS (SELECT *, CASE WHEN x NOT IN ('eed', 'eedly') AND regexp_matches(left(w, -len(x)), '[aeiouy]') THEN left(w, -len(x)) END AS p FROM p4),
p6 AS (SELECT word, w AS w1a, r1, r2, CASE WHEN x IN ('eed', 'eedly') THEN CASE WHEN len(w) - len(x) >= r1 THEN left(w, -len(x)) || 'ee' ELSE w END
  WHEN p IS NULL THEN w WHEN regexp_matches(p, '(at|bl|iz)$') THEN p || 'e' WHEN regexp_matches(p, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(p, -1)
  WHEN r1 >= len(p) AND {short('p')} THEN p || 'e' ELSE p END AS w FROM p5),
p7 AS (SELECT word, w1a, r1, r2, CASE WHEN len(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, -1) || 'i' ELSE w END AS w FROM p6),
p8 AS (SELECT word, w1a, r1, r2, {step2} AS w FROM p7),
p9 AS (SELECT word, w1a, r1, r2, {step3} AS w FROM p8),
p10 AS (SELECT word, w1a, r1, r2, {step4} AS w FROM p9),
p11 AS (SELECT word, w1a, CASE WHEN suffix(w, 'e') THEN CASE WHEN len(w) - 1 >= r2 OR (len(w) - 1 >= r1 AND NOT {short('left(w, -1)')}) THEN left(w, -1) ELSE w END
  WHEN suffix(w, 'll') AND len(w) - 1 >= r2 THEN left(w, -1) ELSE w END AS w FROM p10),
stems AS (SELECT word, CASE WHEN len(word) <= 2 THEN word WHEN {special} IS NOT NULL THEN {special} WHEN w1a IN ({kept}) THEN w1a ELSE replace(w, 'Y', 'y') END AS stem FROM p11)"""


_STEMMED = f"""{_TERMS},
words AS (SELECT term AS word, count(*) AS n FROM t WHERE term <> '' GROUP BY term),{_stems('words')}"""


@query(f"WITH {_STEMMED} SELECT word, stem, n FROM stems JOIN words USING (word)")
def stem_vocabulary(spark, sf_dir):
    words = _documents(spark, sf_dir).select(F.explode(X.terms(F.col("text"))).alias("word"))
    vocabulary = words.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.select("word", stem_word(F.col("word")).alias("stem"), "n")


_STEM_LEAF = _leaf("0", ["blend", "thing"]).replace(" JOIN t ON", " JOIN ts t ON")


@query(
    f"""WITH {_STEMMED}, ts AS (SELECT doc_id, pos, stem AS term FROM t JOIN stems ON term = word),
st AS (SELECT doc_id, len(a) AS dl FROM tok), cs AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM st){_STEM_LEAF}{_alone('r', 'n0')}
SELECT doc_id, round(s, 6) AS score FROM r"""
)
def bm25_stemmed(spark, sf_dir):
    scores = R.rank(I.ScanIndex(_documents(spark, sf_dir), I.Analyzer(stem=True)), '"blending things"')
    return scores.select("doc_id", F.round("score", 6).alias("score"))


def _marked(scored: str, weights: dict[str, int], where: str, by_place: bool) -> str:
    """Snippets of the scored rows in ``r``: the best window of hits, widened, runs of hits marked.

    ``by_place`` keeps hits within the window's places and takes it for places;
    otherwise it is counted in hits, and their numbers are taken for places.
    """
    words = ", ".join(f"'{w}'" for w in weights)
    weight = " ".join(f"WHEN '{w}' THEN {n}" for w, n in weights.items())
    near = "b.pos - a.pos <= 40" if by_place else "b.i <= a.i + 40"
    place = ("a.pos", "b.pos") if by_place else ("a.i", "b.i")
    return f"""{scored},
best AS (SELECT doc_id, round(s, 6) AS score FROM r WHERE {where} ORDER BY s DESC, doc_id LIMIT 100),
h AS (SELECT doc_id, pos, CASE term {weight} END AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM t JOIN best USING (doc_id) WHERE term IN ({words})),
su AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM h),
win AS (SELECT doc_id, {place[0]} AS i, {place[1]} AS j, row_number() OVER (PARTITION BY doc_id ORDER BY b.c - a.c + a.w DESC, a.i, b.i) AS n FROM su a JOIN su b USING (doc_id) WHERE b.i >= a.i AND {near}),
wide AS (SELECT best.doc_id, score, a, len(a) AS n, coalesce(i, 0) AS i, coalesce(j, 0) AS j, greatest(40 - (coalesce(j, 0) - coalesce(i, 0)), 0) AS missing FROM best JOIN tok USING (doc_id) LEFT JOIN win ON win.doc_id = best.doc_id AND win.n = 1),
ends AS (SELECT doc_id, score, a, n, greatest(0, i - missing) AS x, greatest(j, least(n - 1, j + missing - (i - greatest(0, i - missing)))) AS y FROM wide),
places AS (SELECT doc_id, a, y, unnest(range(x, least(y, n - 1) + 1)) AS k FROM ends),
seen AS (SELECT p.doc_id, a[CAST(k AS INTEGER) + 1] AS token, k, y, h.pos IS NOT NULL AS hit FROM places p LEFT JOIN h ON h.doc_id = p.doc_id AND h.pos = p.k),
turn AS (SELECT *, coalesce(lag(hit) OVER d, false) AS before, lead(k) OVER d IS NULL AS last FROM seen WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
text AS (SELECT doc_id, string_agg(CASE WHEN hit AND NOT before THEN '<span>' WHEN before AND NOT hit THEN '</span>' ELSE '' END || token || CASE WHEN k <> y THEN ' ' ELSE '' END || CASE WHEN last AND hit THEN '</span>' ELSE '' END, '' ORDER BY k) AS content FROM turn GROUP BY doc_id)
SELECT doc_id, '' AS title, coalesce(content, '') AS content, '' AS url, score FROM best LEFT JOIN text USING (doc_id)"""


_SNIPPETS = _leaf("0", ["of", "the"]) + _leaf("1", ["with"]) + _expr("e", ["n0"], "n0.s") + _expr("g", ["n1"], "1 - n1.s") + _pair("r", "e", "g")
_INTENDED = _leaf("0", ["the"]) + _leaf("1", ["of", "the"], strict=True) + _expr("e", ["n0", "n1"], "least(n0.s, n1.s)") + _alone("r", "e")


@query(_marked(f"WITH {_BASE}{_SNIPPETS}", {"of": 0, "the": 0, "with": -5}, "s >= 0.3", False))
def snippets(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return S.search(I.ScanIndex(docs, PLAIN), docs, '"of the" not "with"', 0.3).withColumn("score", F.round("score", 6))


@query(_marked(f"WITH {_BASE}{_INTENDED}", {"of": 1, "the": 1}, "s >= 0.3", True))
def snippets_intended(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return S.search(I.ScanIndex(docs, PLAIN), docs, 'the and "of the"', 0.3, modes=Modes.intended()).withColumn("score", F.round("score", 6))


def _spread(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(_scored(_MIXED, "r"))
def stored_index_search(spark, sf_dir):
    """The same ranking from a written index of two batches, the second written twice."""
    docs = _documents(spark, sf_dir)
    index = I.StoredIndex(spark, _spread(spark, "index"), PLAIN, 16)
    halves = [docs.filter(F.pmod("doc_id", F.lit(2)) == k) for k in (0, 1)]
    for batch, half in ((0, halves[0]), (1, halves[1]), (1, halves[1])):
        index.add(half, batch)
    return R.rank(index, 'the "is of"').select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_TERMS} SELECT term, doc_id, count(*) AS tf FROM t WHERE term <> '' GROUP BY term, doc_id")
def stored_postings(spark, sf_dir):
    index = I.StoredIndex(spark, _spread(spark, "index"), PLAIN, 16)
    index.add(_documents(spark, sf_dir), 0)
    return index.postings().select("term", "doc_id", F.size("positions").cast("long").alias("tf"))


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(len(a) AS INTEGER) AS dl FROM tok")
def stream_index(spark, sf_dir):
    """Document lengths of an index built by a stream over the table's files."""
    from .streaming.incremental import index_stream

    source = _spread(spark, "stream-source")
    _documents(spark, sf_dir).write.parquet(source)
    index = I.StoredIndex(spark, _spread(spark, "index"), PLAIN, 16)
    index_stream(spark, source, index, _spread(spark, "stream-state"), title=None, content="text").awaitTermination()
    return index.doc_stats().select("doc_id", "dl")


# pages ------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


#: Top-level domains for the queries below and their SQL, a parameter of the operators.
TLDS = ["COM", "ORG", "NET", "EDU", "GOV", "INFO", "BIZ", "IO", "DE", "FR", "ES", "EN", "UK", "EU", "IT", "NL", "US", "AI", "ST", "TI", "ET", "RE", "AN"]
_IN_TLDS = f"IN ({', '.join(repr(t) for t in TLDS)})"


#: The SQL below repeats the URL patterns of ``functions.urls``.
def _sql_tld(c: str) -> str:
    return f"(contains({c}, '.') AND upper(split_part(split_part({c}, '.', -1), '/', 1)) {_IN_TLDS})"


def _sql_normal(c: str) -> str:
    return f"split_part(regexp_replace({c}, '[*$/?]+$', ''), '/*', 1)"


def _sql_absolute(c: str) -> str:
    return f"(regexp_matches({c}, '^(https?://)([a-zA-Z0-9-]+\\.)+[a-zA-Z0-9-]+') AND {_sql_tld(c)})"


@query(f"SELECT page_id, {_sql_normal('url')} AS url FROM pages")
def normalize_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.normalize_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, {_sql_absolute('url')} AS ok FROM pages")
def is_absolute_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.is_absolute(F.col("url"), TLDS).alias("ok"))


@query(f"SELECT page_id, regexp_matches(u, '^(https?://)?([a-zA-Z0-9-]+\\.)+[a-zA-Z]{{2,}}/?$') AND {_sql_tld('u')} AS ok FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS u FROM pages)")
def is_domain_url(spark, sf_dir):
    hosts = _pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("u"))
    return hosts.select("page_id", U.is_domain(F.col("u"), TLDS).alias("ok"))


@query("SELECT page_id, regexp_matches(url, '(https?://)?([a-zA-Z0-9.-]+)(/[^\\s]*)?') AS ok FROM pages")
def is_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.is_url(F.col("url")).alias("ok"))


@query(f"SELECT page_id, {_sql_tld('url')} AS ok FROM pages")
def tld_valid(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.is_valid_tld(F.col("url"), TLDS).alias("ok"))


@query("SELECT page_id, starts_with(url, '//') AS protocol_relative, starts_with(url, '/') AS root_relative, url IN ('', '/') OR starts_with(url, '#') AS ignored FROM (SELECT page_id, regexp_replace(url, '^https?:', '') AS url FROM pages)")
def classify_url(spark, sf_dir):
    u = F.regexp_replace("url", "^https?:", "")
    return _pages(spark, sf_dir).select("page_id", U.is_protocol_relative(u).alias("protocol_relative"), U.is_root_relative(u).alias("root_relative"), U.is_ignored(u).alias("ignored"))


@query("SELECT page_id, CASE WHEN url LIKE '%/' THEN url || 'robots.txt' ELSE url || '/robots.txt' END AS url FROM pages")
def robots_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.robots_url(F.col("url")).alias("url"))


_LINKS = f"""l AS (SELECT url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h FROM pages),
r AS (SELECT url, h, CASE WHEN h IN ('', '/') OR starts_with(h, '#') THEN url WHEN {_sql_absolute('h')} THEN h
  WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1) || h
  ELSE regexp_extract(url, '^(.*/)', 1) || h END AS u FROM l),
n AS (SELECT url, h, {_sql_normal('u')} AS target FROM r)"""


@query(f"WITH {_LINKS} SELECT url, h AS link, target, count(*) AS n FROM n WHERE {_sql_absolute('target')} GROUP BY ALL")
def resolve_links(spark, sf_dir):
    links = C.links_of(H.page_documents(_pages(spark, sf_dir)), TLDS)
    return links.groupBy("url", "link", "target").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINKS} SELECT DISTINCT target FROM n WHERE {_sql_absolute('target')} AND target NOT IN (SELECT url FROM pages)")
def visited_anti_join(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    links = C.links_of(H.page_documents(pages), TLDS).select("target").distinct()
    return links.join(pages.select(F.col("url").alias("target")), "target", "left_anti")


@query("""SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS title FROM pages""")
def page_title(spark, sf_dir):
    return H.page_documents(_pages(spark, sf_dir), keep=("page_id",)).select("page_id", "title")


@query("SELECT page_id, regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS language FROM pages")
def html_lang(spark, sf_dir):
    return H.page_documents(_pages(spark, sf_dir), keep=("page_id",)).select("page_id", "language")


@query("SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def link_counts(spark, sf_dir):
    return H.page_documents(_pages(spark, sf_dir), keep=("page_id",)).select("page_id", F.size("links").cast("long").alias("n_links"))


def _sql_unescaped(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def _sql_visible(c: str) -> str:
    """Text outside of tags, comments and skipped elements, each piece after a space, blanks collapsed."""
    for tag in sorted(H.SKIPPED - H.VOID, key=lambda t: (t not in ("script", "style"), t)):
        c = f"regexp_replace({c}, '(?s)<{tag}(?:\\s[^>]*)?>.*?</{tag}>', chr(1), 'g')"
    c = f"regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', chr(1), 'g'), '<[^>]*>', chr(1), 'g')"
    pieces = f"list_transform(list_filter(string_split({c}, chr(1)), lambda x: x <> ''), lambda x: ' ' || x)"
    return f"regexp_replace(translate({_sql_unescaped(f'array_to_string({pieces}, {chr(39) * 2})')}, chr(10) || chr(13) || chr(9), ''), ' +', ' ', 'g')"


@query(f"SELECT url, {_sql_visible('html')} AS content FROM pages")
def html_text(spark, sf_dir):
    return H.page_documents(_pages(spark, sf_dir)).select("url", "content")


@query(
    f"""SELECT url, {_sql_unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, '' AS description, '' AS keywords, '' AS author, '' AS publication_date, '' AS last_modified_date,
  '' AS content_type, '' AS tags, regexp_extract(html, '<img[^>]* src="([^"]*)"', 1) AS image_links, {_sql_visible('html')} AS content, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS language, false AS processed FROM pages"""
)
def page_document(spark, sf_dir):
    return H.page_documents(_pages(spark, sf_dir)).drop("links")


_HUB = "https://hub.example.com"


@query(
    f"""WITH RECURSIVE {_LINKS},
w AS (SELECT url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages
  UNION ALL SELECT '{_HUB}/n' || page_id, 'hub ' || page_id FROM pages UNION ALL SELECT '{_HUB}', 'hub'),
e AS (SELECT url, target FROM n WHERE {_sql_absolute('target')}
  UNION ALL SELECT '{_HUB}', '{_HUB}/n0'
  UNION ALL SELECT '{_HUB}/n' || page_id, '{_HUB}/n' || (10 * page_id + j) FROM pages, (SELECT unnest(range(1, 11)) AS j)
  UNION ALL SELECT '{_HUB}/n' || page_id, {_sql_normal('url')} FROM pages WHERE {_sql_absolute(_sql_normal('url'))}),
reached(url) AS (SELECT '{_HUB}' UNION SELECT e.target FROM reached JOIN e USING (url) WHERE e.target <> '{_HUB}/n7' AND e.target IN (SELECT url FROM w))
SELECT url, replace(replace(replace(replace(title, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS title FROM reached JOIN w USING (url)"""
)
def crawl_bfs(spark, sf_dir):
    """Crawled from one seed, robots kept: a tree of hub pages, ten below each, each with a link to a page of the table; the robots file forbids one hub."""
    pages = _pages(spark, sf_dir)
    k = F.col("page_id")
    below = F.concat(*[F.format_string('<a href="/n%d">x</a>', 10 * k + j) for j in range(1, 11)])
    hubs = pages.select(F.format_string(f"{_HUB}/n%d", k).alias("url"), F.concat(F.format_string("<title>hub %d</title>", k), below, F.lit('<a href="'), "url", F.lit('">p</a>')).alias("html"))
    start = spark.createDataFrame([(_HUB, '<title>hub</title><a href="/n0">0</a>'), (f"{_HUB}/robots.txt", "User-agent: *\nDisallow: /n7\n")], "url string, html string")
    web = pages.select("url", "html").unionByName(hubs).unionByName(start)
    store = Store(spark, _spread(spark, "crawl"))
    C.Crawler(spark, store, table_fetcher(web), TLDS, max_pages=1_000_000_000).run([_HUB])
    return store.read("pages").select("url", "title")


@query("SELECT count(*) AS n_pages, count(DISTINCT url) AS n_urls FROM pages")
def store_roundtrip(spark, sf_dir):
    """Insert, upsert and count through the store."""
    pages = _pages(spark, sf_dir)
    store = Store(spark, _spread(spark, "store"))
    rows = stored_pages(H.page_documents(pages))
    store.insert("pages", rows)
    store.upsert("pages", rows.filter(F.pmod("doc_id", F.lit(2)) == 0), "doc_id")
    return store.read("pages").agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct("url").alias("n_urls"))


@query("SELECT page_id, url FROM pages")
def seeds_json(spark, sf_dir):
    """URLs out of one JSON list per page."""
    lists = _pages(spark, sf_dir).select("page_id", F.concat(F.lit('["'), "url", F.lit('"]')).alias("t"))
    return lists.select("page_id", F.explode(X.quoted_strings(F.col("t"))).alias("url"))


@query("SELECT DISTINCT 'http://' || p AS proxy FROM (SELECT unnest(string_split_regex(string_agg(url, ' '), '\\s+')) AS p FROM pages) WHERE p <> ''")
def proxy_list(spark, sf_dir):
    return proxies(_pages(spark, sf_dir), "url").distinct()


@query("""SELECT page_id, string_agg(p, ',' ORDER BY i) AS paths FROM (SELECT page_id, unnest(['/private', '/x/' || page_id]) AS p, unnest([1, 2]) AS i FROM pages) GROUP BY page_id""")
def robots_disallow(spark, sf_dir):
    text = F.concat(F.lit("User-agent: a\nDisallow: /a\nUser-agent: *\nDisallow: /private\nDisallow: /x/"), F.col("page_id").cast("string"), F.lit("\n\nUser-agent: b\nDisallow: /b\n"))
    return _pages(spark, sf_dir).select("page_id", F.array_join(H.robots_disallowed(text), ",").alias("paths"))


# single operators of the store, pages and links ---------------------------------


def _page_store(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, _spread(spark, "store"))
    store.insert("pages", stored_pages(H.page_documents(_pages(spark, sf_dir))))
    return store


def _one_row(spark: SparkSession, **values: int) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in values.items()])


@query("SELECT count(*) AS everything, least(count(*), 7) AS limited, count(*) FILTER (contains(url, '/blog/')) AS filtered, 0 AS cleared FROM pages".replace("0 AS cleared", "CAST(0 AS BIGINT) AS cleared"))
def store_counts(spark, sf_dir):
    """Filtered and limited scans (a limit of 0 is none), and a cleared table."""
    store = _page_store(spark, sf_dir)
    counts = {"everything": store.limited("pages", 0).count(), "limited": store.limited("pages", 7).count(), "filtered": store.count("pages", F.col("url").contains("/blog/"))}
    store.clear("pages")
    return _one_row(spark, **counts, cleared=store.count("pages"))


@query("SELECT url FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)")
def store_first(spark, sf_dir):
    store = _page_store(spark, sf_dir)
    url = _pages(spark, sf_dir).orderBy("page_id").first().url
    row = store.first("pages", F.col("url") == url)
    return spark.createDataFrame([(row.url,)], "url string")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels ORDER BY doc_id LIMIT 60)")
def lookup_by_ids(spark, sf_dir):
    """Rows of a bounded list of ids."""
    schema = _table(spark, sf_dir, "documents").select("doc_id", "lang").schema
    store = Store(spark, sf_dir, {"documents.parquet": schema})
    ids = [r.doc_id for r in _table(spark, sf_dir, "labels").select("doc_id").orderBy("doc_id").limit(60).collect()]
    return store.by_ids("documents.parquet", ids)


@query("SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM pages")
def mark_processed(spark, sf_dir):
    """Unprocessed pages before and after marking all of them."""
    store = _page_store(spark, sf_dir)
    before = store.unprocessed().count()
    store.mark_processed(store.read("pages"))
    return _one_row(spark, before=before, after=store.unprocessed().count())


@query("SELECT DISTINCT url FROM pages")
def visited_set(spark, sf_dir):
    """Saved twice, each URL is there once."""
    store = Store(spark, _spread(spark, "store"))
    for _ in range(2):
        store.save_visited(_pages(spark, sf_dir).select("url"))
    return store.read("visited").select("url")


@query("SELECT url FROM pages")
def seed_lines(spark, sf_dir):
    from .sources.store import seed_file

    path = _spread(spark, "seeds")
    urls = _pages(spark, sf_dir).select("url")
    urls.unionByName(spark.createDataFrame([("",)], "url string")).write.text(path)
    return seed_file(spark, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(lang || ' ' || source || ' ' || text || ' ') AS content FROM documents")
def concat_text_fields(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.md5(X.all_text(F.col("lang"), F.col("source"), F.col("text"))).alias("content"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(lang || text, '{_TOKEN}')) AS INTEGER) AS dl FROM documents")
def titled_document_lengths(spark, sf_dir):
    """Title and content are put together without anything between."""
    docs = _table(spark, sf_dir, "documents")
    return I.doc_lengths(docs, title="lang")


@query("SELECT doc_id, lang AS language, source AS author, CAST(n_chars AS VARCHAR) AS tags, 'i.png' AS image_links, lang || ' & ' || source AS title FROM documents")
def meta_fields(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    markup = F.format_string('<html lang="%s"><head><title>%s &amp; %s</title><meta name="author" content="%s"><meta name="tags" content="%d"></head><img src="i.png"><img src="j.png">', "lang", "lang", "source", "source", "n_chars")
    pages = docs.select(F.col("doc_id").cast("string").alias("url"), markup.alias("html"))
    return H.page_documents(pages).select(F.col("url").cast("long").alias("doc_id"), "language", "author", "tags", "image_links", "title")


_FORMS = ("", "/", "#top", "//cdn.example.com/x", "/a/b?", "c/d*", "https://other.org/z/*/q")


@query(
    f"""WITH f AS (SELECT url, unnest([{', '.join(repr(x) for x in _FORMS)}]) AS h FROM pages),
r AS (SELECT url, h, CASE WHEN h IN ('', '/') OR starts_with(h, '#') THEN url WHEN {_sql_absolute('h')} THEN h
  WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1) || h
  ELSE regexp_extract(url, '^(.*/)', 1) || h END AS u FROM f)
SELECT url, h AS form, {_sql_normal('u')} AS target FROM r"""
)
def absolute_url_forms(spark, sf_dir):
    """Every form a link can have, on every page."""
    forms = _pages(spark, sf_dir).select("url", F.explode(F.array(*[F.lit(x) for x in _FORMS])).alias("form"))
    return forms.select("url", "form", U.to_absolute(F.col("form"), F.col("url"), TLDS).alias("target"))


@query(
    f"""WITH {_LINKS}, k AS (SELECT url, target, row_number() OVER (PARTITION BY target ORDER BY url, h) AS n FROM n WHERE {_sql_absolute('target')})
SELECT target, min(url) AS first_page FROM k GROUP BY target"""
)
def frontier_dedupe(spark, sf_dir):
    """Each link target once, with the first page that has it."""
    links = C.first_occurrence(C.links_of(H.page_documents(_pages(spark, sf_dir)), TLDS))
    return links.select("target", F.col("url").alias("first_page"))


@query("SELECT item_id, 'phrase' AS kind, text FROM benchmark UNION ALL SELECT item_id, 'operator', 'or' FROM benchmark UNION ALL SELECT item_id, 'term', 'der' FROM benchmark")
def lex_queries(spark, sf_dir):
    """A query made of every benchmark item, lexed: ``order "text"``."""
    from .plans.query import lex

    def tokens(frames):
        for f in frames:
            yield pd.DataFrame([(i, t.kind, t.text) for i, q in zip(f.item_id, f.q) for t in lex(q)], columns=["item_id", "kind", "text"])

    queries = _table(spark, sf_dir, "benchmark").select("item_id", F.format_string('order "%s"', "text").alias("q"))
    return queries.mapInPandas(tokens, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


@query(f"""WITH {_BASE}{_leaf("0", ["the"])}{_leaf("1", ["is"])}
SELECT a.doc_id, round(0.7 * a.s + 0.3 * b.s, 6) AS score FROM n0 a JOIN n1 b USING (doc_id)""")
def weighted_sum(spark, sf_dir):
    """Two leaves added with weights."""
    from .plans.query import Term, parse

    found = R.Scores(I.ScanIndex(_documents(spark, sf_dir), PLAIN), parse("the is"))
    total = 0.7 * found.leaf[Term("the")] + 0.3 * found.leaf[Term("is")]
    return found.rows.select("doc_id", F.round(total, 6).alias("score"))
