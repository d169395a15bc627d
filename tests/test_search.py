import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators.index import Analyzer, ScanIndex, StoredIndex, corpus_stats
from lodestone.operators.snippets import best_window, bounds, marked, search, snippet
from lodestone.plans.query import And, Modes, Not, Or, Phrase, QuerySyntaxError, Term, Token, lex, parse, weights_of
from lodestone.plans.rank import RankerParams, rank

CORPUS = [(1, "bbc news new york"), (2, "cnn news england"), (3, "new york new york bbc"), (4, "new york is in england not york"), (5, "bbc news england cnn new")]
GOLDEN = {
    "new": (0.766892, 0, 1, 0.588083, 0.696319),
    "New": (0, 0, 0, 0, 0),
    "news england": (0.17973, 1, 0, 0.137824, 0.815951),
    '"new york"': (0.766892, 0, 1, 0.588083, 0.696319),
    '"bbc news"': (1, 0, 0.907975, 0, 0.907975),
    '("bbc news" or "cnn") not "england"': (1, 0.2, 0.92638, 0.062176, 0.328834),
    '"new york" and not "england"': (0.766892, 0, 1, 0.310881, 0.184049),
    'new "bbc news"': (0.840569, 0, 1, 0.105686, 0.763216),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string").cache()


def scores(index, text, **how):
    return [r.score for r in rank(index, text, **how).orderBy("doc_id").collect()]


@pytest.mark.parametrize("text", sorted(GOLDEN))
@pytest.mark.parametrize("stem", [False, True])
def test_golden_scores(docs, text, stem):
    assert scores(ScanIndex(docs, Analyzer(stem=stem)), text) == pytest.approx(GOLDEN[text], abs=2e-6)


def test_modes(docs):
    index = ScanIndex(docs)
    strict = scores(index, '"new york"', modes=Modes(phrase="intended"))
    assert strict[4] == 0 and strict[2] == 1
    assert scores(index, "New", modes=Modes(term="intended")) == pytest.approx(GOLDEN["new"], abs=2e-6)
    either = scores(index, "cnn or york", modes=Modes.intended())
    assert all(s > 0 for s in either)
    assert scores(index, '""') == [0] * 5
    assert scores(index, "new", params=RankerParams(exact_match_weight=0.0)) == pytest.approx(GOLDEN["new"], abs=2e-6)


def test_stored_index_gives_the_same(spark, docs, tmp_path):
    index = StoredIndex(spark, str(tmp_path), Analyzer(stem=False), 4)
    index.add(docs.filter("doc_id < 3"), 1)
    for _ in range(2):
        index.add(docs.filter("doc_id >= 3"), 2)
    for text in ('new "bbc news"', '"new york" and not "england"'):
        assert scores(index, text) == pytest.approx(GOLDEN[text], abs=2e-6)
    assert tuple(corpus_stats(index.doc_stats()).first()) == (5, 24, 4.8)
    plan = index.postings().filter("bucket in (1) and term in ('new')")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan
    index.clear()
    assert index.postings().count() == 0 == corpus_stats(index.doc_stats()).first().n_docs


def held(index):
    stats = {r.doc_id: r.dl for r in index.doc_stats().collect()}
    posts = sorted((r.term, r.doc_id, r.dl, tuple(r.positions)) for r in index.postings().collect())
    return stats, posts


def expected(rows):
    """The index of (doc_id, text) rows, from plain Python."""
    out = {}
    for i, text in rows:
        for p, w in enumerate(text.split()):
            out.setdefault((w, i), []).append(p)
    return {i: len(t.split()) for i, t in rows}, sorted((w, i, len(dict(rows)[i].split()), tuple(p)) for (w, i), p in out.items())


def frame(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_last_version_of_a_document_counts(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path), Analyzer(stem=False))
    index.add(frame(spark, (1, "old words here"), (2, "b c")), "x")
    index.add(frame(spark, (1, "new words"), (3, "c c d")), "y")
    now = [(1, "new words"), (2, "b c"), (3, "c c d")]
    assert held(index) == expected(now) and index.totals() == (3, 7)
    assert scores(index, "old") == [0, 0, 0] and scores(index, "words") == [1, 0, 0]
    index.add(frame(spark, (1, "newest")), "z")
    index.add(frame(spark, (4, "d")), "y")  # "y" no longer holds documents 1 and 3
    now = [(1, "newest"), (2, "b c"), (4, "d")]
    assert held(index) == expected(now) and index.totals() == (3, 4)
    index.add(frame(spark, (2, "e")), "z")  # nor "z" document 1: the version in "x" is the last one again
    now = [(1, "old words here"), (2, "e"), (4, "d")]
    assert held(index) == expected(now) and index.totals() == (3, 5)
    before = scores(index, "words e")
    assert index.compact().docs == 3 and index.vacuum() == 5
    assert held(index) == expected(now) and index.totals() == (3, 5) and scores(index, "words e") == before


@pytest.mark.parametrize("dies_at", ["postings", "doc_stats", "replaced", "manifest"])
def test_a_write_that_dies_leaves_nothing(spark, tmp_path, monkeypatch, dies_at):
    index = StoredIndex(spark, str(tmp_path), Analyzer(stem=False))
    index.add(frame(spark, (1, "a b"), (2, "b")), 0)
    whole, write, commit = held(index), StoredIndex._write, StoredIndex._commit

    def failing(self, df, table, *more):
        write(self, df, table, *more)
        if table == dies_at:
            raise RuntimeError("killed")

    def no_commit(self, *args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(StoredIndex, "_write", failing)
        if dies_at == "manifest":
            m.setattr(StoredIndex, "_commit", no_commit)
        with pytest.raises(RuntimeError):
            index.add(frame(spark, (2, "c"), (3, "d")), 1)
    assert held(index) == whole and index.totals() == (2, 3)
    index.add(frame(spark, (2, "c"), (3, "d")), 1)
    assert held(index) == expected([(1, "a b"), (2, "c"), (3, "d")])
    assert commit is StoredIndex._commit and index.vacuum() == 1


def test_two_writers_cannot_both_commit(spark, tmp_path):
    one, two = (StoredIndex(spark, str(tmp_path), Analyzer(stem=False)) for _ in range(2))
    one.add(frame(spark, (1, "a")), 0)
    version, batches = two._latest()
    one.add(frame(spark, (2, "b")), 1)
    with pytest.raises(Exception, match="(?i)exist"):
        two._commit(version, batches)
    assert one.totals() == (2, 2)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB9_'- \n.é\u0130\u212a", max_size=30), min_size=1, max_size=20))
def test_terms_are_normalised_tokens(spark, texts):
    from pyspark.sql import functions as F

    from lodestone.functions import text as X

    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    for r in df.select("t", X.terms(F.col("t")).alias("terms"), X.tokenize(F.col("t")).alias("tokens"), X.token_count(F.col("t")).alias("n")).collect():
        import re

        assert r.n == len(r.tokens)

        assert r.tokens == re.findall(X.TOKEN, r.t or "")
        assert r.terms == [X.normalize_py(w) for w in r.tokens]


def test_nested_postings(spark):
    from lodestone.operators.index import analyze, nested_postings, postings

    df = frame(spark, (1, "b a _ b"), (2, ""), (3, None), (None, "a"), (4, "_ _"), (5, "z"), (5, "z"))
    rows = analyze(df, Analyzer(stem=False))
    flat = sorted((r.term, r.doc_id, r.pos) for r in postings(rows).collect())
    assert flat == [("a", 1, 1), ("b", 1, 0), ("b", 1, 3), ("z", 5, 0), ("z", 5, 0)]
    nested = sorted((r.term, r.doc_id, r.dl, r.positions) for r in nested_postings(rows).collect())
    assert nested == [("a", 1, 4, [1]), ("b", 1, 4, [0, 3]), ("z", 5, 1, [0]), ("z", 5, 1, [0])]
    assert nested_postings(rows).count() == 4 == nested_postings(rows).select("doc_id").count() and {r.term for r in nested_postings(rows).select("term").collect()} == {"a", "b", "z"}
    assert "Exchange" not in nested_postings(rows)._jdf.queryExecution().executedPlan().toString()


def test_empty_corpus_and_nulls(spark, docs):
    assert rank(ScanIndex(docs.limit(0)), 'a "b"').count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "new"), (3, "new")], "doc_id long, text string")
    assert scores(ScanIndex(odd), "new") == [0, 0, 1]


def test_lexer():
    t = lambda s: [(x.kind, x.text) for x in lex(s)]
    assert t('""Israel""') == [("phrase", "Israel")]
    assert t('order "x y"') == [("operator", "or"), ("term", "der"), ("phrase", "x y")]
    assert t("(foo AND bar)") == [("operator", "("), ("term", "foo"), ("operator", "and"), ("term", "bar)")]
    assert t('cat"dog"') == [("term", "cat"), ("phrase", "dog")]
    assert t('""') == [("phrase", "")]
    assert lex("order android", "intended") == [Token("term", "order"), Token("term", "android")]
    assert [x.text for x in lex("(foo AND bar)", "intended")] == ["(", "foo", "and", "bar", ")"]


def test_parser():
    a, b, c = Phrase("a"), Phrase("b"), Phrase("c")
    p = lambda s: parse(s).phrases
    assert p('"a" OR "b" AND "c"') == (Or(And(c, b), a),)
    assert p('"a" AND NOT "b"') == (And(Not(b), a),)
    assert p('"a" NOT "b"') == (a, Not(b))
    assert p('NOT ("a" OR "b") AND "c"') == (And(c, Not(Or(b, a))),)
    assert p('"a" OR ("b" AND "c"') == (a, And(c, b))
    assert p('"a" ) "b"') == (a, b)
    assert parse("x y").terms == (Term("x"), Term("y"))
    assert parse("x and y", Modes.intended()).phrases == (And(Term("y"), Term("x")),)
    for bad in ('NOT NOT "a"', '"a" AND', "cat AND dog", "", "( )", "not"):
        with pytest.raises(QuerySyntaxError):
            parse(bad)


def test_weights():
    assert weights_of(lex('x not "b c" y')) == {"x": 1, "b c": -5, "y": 1}
    assert weights_of(lex('not ( "a" or "b" ) "c"')) == {"a": -5, "b": -5, "c": 1}


def naive_bounds(i, j, n):
    d = j - i
    while d < 40 and i > 0:
        i, d = i - 1, d + 1
    while d < 40 and j < n - 1:
        j, d = j + 1, d + 1
    return i, j


@settings(max_examples=500, deadline=None)
@given(st.integers(1, 130), st.data())
def test_bounds(n, data):
    i = data.draw(st.integers(0, n - 1))
    j = data.draw(st.integers(i, min(n - 1, i + 40)))
    assert bounds(i, j, n) == naive_bounds(i, j, n)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([1, 1, 0, -5]), max_size=60))
def test_best_window(weights):
    every = [(sum(weights[i : j + 1]), -i, -j) for i in range(len(weights)) for j in range(i, min(len(weights), i + 41))]
    best = max(every) if every else (0, 0, 0)
    assert best_window(weights) == (-best[1], -best[2])


def test_marked():
    assert marked("foo bar baz".split(), {0}, 0, 2) == "<span>foo </span>bar baz"
    assert marked("foo bar baz".split(), {1, 2}, 0, 2) == "foo <span>bar baz</span>"
    assert snippet("one two", {}, {}) == "one two"
    assert snippet("", {}, {}) == ""
    long = " ".join(f"w{k}" for k in range(100))
    assert snippet(long, {90: "w90"}, {"w90": 1}, "intended").endswith("<span>w90</span>")
    assert len(snippet(long, {90: "w90"}, {"w90": 1}).split()) == 41


def test_search(docs):
    rows = {r.doc_id: r for r in search(ScanIndex(docs), docs, '("bbc news" or "cnn") not "england"', 0.1).collect()}
    assert rows[1].content == "<span>bbc news </span>new york"
    assert set(rows) == {1, 2, 3, 5}
    assert search(ScanIndex(docs), docs, "new", 0.9, limit=1).count() == 1
