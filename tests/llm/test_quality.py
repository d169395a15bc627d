import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import quality as Q
from lodestone.llm.queries import ORACLE, op3_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(lines[i] in lines[:i] for i in range(len(lines))), len(repeated), len(lines))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x0b\x1c ", max_size=60))
def test_measures(text):
    assert Q.measure(text) == brute(text)


def test_long_and_null():
    assert Q.measure(None) == (0,) * 6
    long = "a b " * 50_000
    assert Q.measure(long)[4] == 100_000


def test_query_equals_its_sql(same):
    same(op3_quality, ORACLE["op3_quality"])


def clean(k):
    return " ".join(f"word{k}x{i}" for i in range(80))


def junk(k):
    return " ".join(f"word{k}x{i}###" for i in range(80))


def test_host_verdicts(spark):
    good = [(k, clean(k), "good") for k in range(40)] + [(100, junk(100), "good")]
    poor = [(200 + k, junk(k), "poor") for k in range(40)] + [(300, clean(300), "poor")]
    kept = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(good + poor, "doc_id long, text string, source string")).collect()}
    assert all(kept[k] for k in range(40)) and kept[100]  # one soft failure on a good host
    assert not any(kept[200 + k] for k in range(40)) and kept[300]  # a clean document stays on a poor host


def test_hosts_decide_on_the_table(spark):
    """The host's verdict changes which documents are kept, only of those with one soft failure, only on hosts above the corpus."""
    rows = Q.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    changed = [r for r in rows if not r.kept and not r.base_failed]
    assert changed and all(r.host_poor for r in changed)
    poor = {r.source for r in rows if r.host_poor}
    assert 0 < len(poor) < len({r.source for r in rows}) / 2

    def bad(r):
        return r.base_failed or 100 * r.n_symbols > 30 * r.n_words or not 2 * r.n_words <= r.word_chars <= 15 * r.n_words or 100 * r.n_dup_lines > 30 * r.n_lines

    rate = sum(map(bad, rows)) / len(rows)
    for h in poor:
        own = [r for r in rows if r.source == h]
        assert sum(map(bad, own)) / len(own) > rate
    assert all(r.kept for r in rows if not bad(r))


def test_names_of_ids_and_hosts_may_clash(spark):
    rows = [(f"a{k}", "n" if k % 2 else "p", clean(k) if k % 2 else junk(k)) for k in range(60)] + [("b", "p", clean(99))]
    plain = sorted((r.doc_id, r.source, r.n_words, r.kept) for r in Q.judge(spark.createDataFrame(rows, "doc_id string, source string, text string")).collect())
    for key, host, text in (("kept", "n_words", "text"), ("host", "id", "base_failed"), ("text", "doc_id", "host"), ("n_lines", "host_poor", "kept")):
        out = Q.judge(spark.createDataFrame(rows, f"`{key}` string, `{host}` string, `{text}` string"), key, host, text)
        own = (*Q.MEASURES, "base_failed", "host_poor", "kept")
        assert len(set(out.columns)) == len(out.columns)
        names = ["id", "host"] if key in own or host in own else [key, host]
        assert sorted(map(tuple, out.select(*[f"`{n}`" for n in (*names, "n_words", "kept")]).collect())) == plain


def test_beta_prior():
    a, b = Q.beta_prior(3, 300, 30, 0.1 * 30)  # all hosts alike: as strong as a mean host
    assert a / (a + b) == pytest.approx(0.1) and a + b == pytest.approx(100)
    a, b = Q.beta_prior(2, 200, 100, 100 * 0.81 + 100 * 0.01)
    assert a + b < 3 and a / (a + b) == pytest.approx(0.5)
    assert Q.beta_prior(0, 0, 0, 0) == (1.0, 1.0)


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, kept string, n_words string, host string, row int, rate double"
    rows = [(1, clean(1), "a", "k", "n", "h", 1, 0.5), (1, clean(1), "a", "k", "n", "h", 1, 0.5), (2, None, None, None, None, None, None, None), (None, clean(2), None, "k", None, None, None, None), (3, "", "a", None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = Q.filter_documents(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.kept, r.n_words or "") for r in out.collect()) == [(0, "k", ""), (1, "k", "n"), (1, "k", "n")]
    assert Q.judge(df).count() == 5
    assert Q.filter_documents(df.limit(0)).count() == 0 == Q.judge(df.limit(0)).count()
    with_few = Q.filter_documents(df, rules=Q.QualityRules(broadcast_hosts=0))
    assert with_few.count() == 3
