import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.functions.stemmer import stem

TLDS = ["COM", "ORG"]


def value(spark, column, **inputs):
    names = list(inputs)
    return spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first().v


def test_tokenize(spark):
    got = value(spark, X.tokenize(F.col("t")), t="'tis don't a--b hello- _x_ é für can-t")
    assert got == ["tis", "don't", "a--b", "hello", "_x_", "f", "r", "can-t"]
    assert value(spark, X.tokenize(F.col("t")), t=None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab_'-9 é.\n", max_size=30))
def test_token_pattern_is_the_ascii_word_boundary_one(text):
    assert re.findall(X.TOKEN, text) == re.findall(r"\b[\w'-]+\b", text, re.A)


@pytest.mark.parametrize("word, expected", [("Don't", "dont"), ("a--b", "ab"), ("_", ""), ("A.B,C", "abc"), ("É", "É")])
def test_normalize(spark, word, expected):
    assert value(spark, X.normalize(F.col("t")), t=word) == expected == X.normalize_py(word)


def test_clean_snippet(spark):
    assert value(spark, X.clean_snippet(F.col("t")), t="a\nb  c\t d") == "ab c d" == X.clean_snippet_py("a\nb  c\t d")
    assert value(spark, X.clean_snippet(F.col("t"), "intended"), t="a\nb  c\t d") == "a b c d"


@pytest.mark.parametrize("s", ['""Israel""', '"a', 'a"', '"', '""', '"""', '"""a"', "a", ""])
def test_unquote(spark, s):
    assert value(spark, X.unquoted(F.col("t")), t=s) == X.unquote(s)


def test_words_and_lists(spark):
    assert value(spark, X.split_by_space(F.col("t")), t="  a \n b ") == ["a", "b"]
    assert value(spark, X.quoted_strings(F.col("t")), t='["a","b c"]') == ["a", "b c"]
    assert value(spark, X.all_text(F.col("a"), F.col("b")), a="x", b=None) == "x  "
    assert value(spark, X.document_text(F.col("a"), F.col("b")), a="x", b="y") == "xy"
    assert value(spark, X.is_valid_word(F.col("t")), t="éé") is True
    words = X.stop_words(spark)
    assert "the" in words and "don't" in words and "don’t" in words
    assert value(spark, X.is_stop_word(F.col("t"), ["the"]), t="the") is True


STEMS = {
    "consignment": "consign", "consistently": "consist", "consolatory": "consolatori", "conspiracies": "conspiraci", "knightly": "knight",
    "running": "run", "cities": "citi", "happy": "happi", "relational": "relat", "generously": "generous", "hopping": "hop", "hoping": "hope",
    "national": "nation", "university": "univers", "flies": "fli", "ties": "tie", "gas": "gas", "kiwis": "kiwi", "agreed": "agre", "bled": "bled",
    "luxuriated": "luxuri", "troubled": "troubl", "sky": "sky", "skies": "sky", "dying": "die", "by": "by", "say": "say", "cry": "cri", "inning": "inning",
    "proceed": "proceed", "exceedingly": "exceed", "communism": "communism", "arsenal": "arsenal", "yes": "yes", "youth": "youth", "boyish": "boyish", "ion": "ion",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stem(word):
    assert stem(word) == STEMS[word]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789", max_size=14))
def test_stem_never_fails_and_never_grows_much(word):
    assert len(stem(word)) <= len(word) + 1


@pytest.mark.parametrize("url, expected", [("https://a.com/x/*", "https://a.com/x"), ("https://a.com/?", "https://a.com"), ("https://a.com/p/*/q", "https://a.com/p"), ("", "")])
def test_normalize_url(spark, url, expected):
    assert value(spark, U.normalize_url(F.col("u")), u=url) == expected


@pytest.mark.parametrize("url, compatible, intended", [("https://a.com/x", True, True), ("https://a.com/x.html", False, True), ("https://a.com:80", False, True), ("https://a.com?x=1", False, True), ("a.xyz", False, False)])
def test_valid_tld(spark, url, compatible, intended):
    assert value(spark, U.is_valid_tld(F.col("u"), TLDS), u=url) is compatible
    assert value(spark, U.is_valid_tld(F.col("u"), TLDS, "intended"), u=url) is intended


@pytest.mark.parametrize(
    "url, expected",
    [("", "https://a.com/p/q"), ("#x", "https://a.com/p/q"), ("https://b.org/z", "https://b.org/z"), ("//b.org/z", "https://b.org/z"), ("/r", "https://a.com/r"), ("s", "https://a.com/p/s"), ("mailto:x@y.com", "https://a.com/p/mailto:x@y.com"), ("x/*", "https://a.com/p/x")],
)
def test_to_absolute(spark, url, expected):
    assert value(spark, U.to_absolute(F.col("u"), F.col("b"), TLDS), u=url, b="https://a.com/p/q") == expected


def test_other_urls(spark):
    assert value(spark, U.robots_url(F.col("u")), u="https://a.com") == "https://a.com/robots.txt" == value(spark, U.robots_url(F.col("u")), u="https://a.com/")
    assert value(spark, U.is_domain(F.col("u"), TLDS), u="https://www.a.com/") is True
    assert value(spark, U.is_domain(F.col("u"), TLDS), u="https://www.a.com/x") is False
    assert "COM" in U.top_level_domains(spark)
    with pytest.raises(ValueError):
        U.require_base("")


PAGE = """<html lang="en"><head><title>A &amp; B</title><meta name="description" content="d"><meta name="last_modification_date" content="2020">
<style>no</style></head><body><nav>no<a href="/n">n</a></nav><p>one<b>two</p><input>three<img src="i.png"><small>no</small>
<!-- no --><a href="/x">four</a><script>no</script></body>"""


def test_extract():
    row = H.extract("https://a.com", PAGE)
    assert (row["title"], row["language"], row["description"], row["last_modified_date"], row["image_links"]) == ("A & B", "en", "d", "2020", "i.png")
    assert row["links"] == ["/n", "/x"]
    assert row["content"].split() == ["A", "&", "B", "one", "two", "three", "four"]
    assert not row["processed"] and row["keywords"] == ""


def test_named_references_end_with_a_semicolon():
    row = H.extract("u", '<html lang="a&ampb"><title>A &amp; B &&&amp</title><a href="/x?a=1&copy=2&amp;b=3">&ltx &ampx; &amp;amp; &#65; &eacute; &</a><img src="i?&amp">')
    assert (row["title"], row["language"], row["image_links"]) == ("A & B &&&amp", "a&ampb", "i?&amp")
    assert row["links"] == ["/x?a=1&copy=2&b=3"]
    assert row["content"] == " A & B &&&amp &ltx &ampx; &amp; A é &"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/anvp =\"'&;!-t", max_size=60))
def test_extract_never_fails(html):
    H.extract("u", html)


def test_extract_nulls(spark):
    row = H.page_documents(spark.createDataFrame([(None, None)], "url string, html string")).first()
    assert (row.url, row.content, row.links) == ("", "", [])


def test_page_columns_are_kept(spark):
    pages = spark.createDataFrame([("k1", 1, "u", "<title>a</title>"), ("k2", None, None, None)], "k string, n int, url string, html string")
    got = H.page_documents(pages, keep=("n", "k"))
    assert got.columns == ["n", "k", *H.PAGE.names]
    assert {(r.n, r.k, r.url, r.title) for r in got.collect()} == {(1, "k1", "u", "a"), (None, "k2", "", "")}
    with pytest.raises(ValueError, match="title"):
        H.page_documents(pages.withColumn("title", F.lit("t")), keep=("title",))


def test_robots(spark):
    text = "User-agent: x\nDisallow: /a\nUser-agent: *\nDisallow: /b\nDisallow:\nDisallow: /c\nUser-agent: y\nDisallow: /d"
    assert value(spark, H.robots_disallowed(F.col("t")), t=text) == ["/b", "/c"]
    assert value(spark, H.robots_disallowed(F.col("t"), "compatible"), t=text) == []
