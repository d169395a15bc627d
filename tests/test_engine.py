import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions.html import page_documents
from lodestone.operators.crawl import Crawler
from lodestone.operators.index import Analyzer
from lodestone.service import answer, serve
from lodestone.sources.fetch import http_fetcher, table_fetcher
from lodestone.sources.store import Store, proxies, seed_file, seeds_from_json, stored_pages

SITE = {
    "https://a.com": '<title>start</title><a href="/one">1</a><a href="/two">2</a><a href="https://b.org/x">b</a>',
    "https://a.com/one": '<title>one</title>bbc news new york<a href="/two">2</a><a href="/secret">s</a>',
    "https://a.com/two": "<title>two</title>cnn news england",
    "https://a.com/secret": "<title>secret</title>hidden news",
    "https://b.org/x": "<title>other</title>new york new york bbc",
    "https://a.com/robots.txt": "User-agent: *\nDisallow: /secret\n",
}


@pytest.fixture
def engine(spark, tmp_path):
    pages = spark.createDataFrame(list(SITE.items()), "url string, html string")
    return Engine(spark, str(tmp_path / "base"), table_fetcher(pages), Analyzer(stem=False), tlds=["COM", "ORG"], buckets=4)


def urls(engine):
    return {r.url for r in engine.store.read("pages").collect()}


def test_crawl_index_search(engine):
    assert engine.crawl(["https://a.com/"], 10) == 4
    assert urls(engine) == {"https://a.com", "https://a.com/one", "https://a.com/two", "https://b.org/x"}
    assert engine.crawl(["https://a.com"], 10) == 0  # all visited
    assert engine.index_documents() == 4
    assert engine.index_documents() == 0
    found = engine.search_json("york", 0.1)
    assert [r["url"] for r in found] == ["https://b.org/x", "https://a.com/one"]
    assert "<span>york" in found[0]["content"]
    assert engine.index_documents(clear=True) == 4
    assert engine.statistics().first().n_docs == 4
    engine.terminate_index(clear=True)
    assert engine.statistics().first().n_docs == 0
    engine.terminate_crawl(clear=True)
    assert not urls(engine)


def test_a_run_that_dies_before_marking_doubles_nothing(engine, monkeypatch):
    engine.crawl(["https://a.com"], 10)

    def killed(self, rows):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Store, "mark_processed", killed)
        with pytest.raises(RuntimeError):
            engine.index_documents()
    before = [(r["url"], r["score"]) for r in engine.search_json("york", 0.1)]
    assert engine.statistics().first().n_docs == 4
    assert engine.index_documents() == 4 and engine.statistics().first().n_docs == 4
    assert [(r["url"], r["score"]) for r in engine.search_json("york", 0.1)] == before
    engine.compact()
    assert [(r["url"], r["score"]) for r in engine.search_json("york", 0.1)] == before


def test_search_leaves_no_tables(engine):
    from lodestone.sources.shared import drop_intermediate

    engine.crawl_and_index(["https://a.com"], 10)
    drop_intermediate(engine.spark)
    assert engine.search_json('york not "news"', 0.0)
    assert drop_intermediate(engine.spark) == 0


def test_an_interrupted_replacement_is_put_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": spark.createDataFrame([], "doc_id long").schema})
    store.insert("t", spark.range(3).withColumnRenamed("id", "doc_id"))
    store.files.rename("t", "t.old-1")
    assert store.count("t") == 3


def test_page_limit(engine):
    assert engine.crawl(["https://a.com"], 2) == 2 == len(urls(engine))
    assert engine.crawl_and_index(["https://b.org/x"], 5, clear=True) == (1, 1)


@pytest.mark.parametrize("seeds, failing, limit, expected", [(30, 3, 10, range(3, 13)), (30, 10, 10, range(10, 20)), (12, 9, 10, [9, 10, 11]), (40, 38, 3, [38, 39]), (12, 12, 5, [])])
def test_page_limit_below_the_seeds(spark, tmp_path, seeds, failing, limit, expected):
    """The first ``failing`` seeds can't be fetched; the others link to a failing one and, at last, to a page beyond."""
    known = [(f"https://a.com/{k:03d}", '<a href="/000">0</a><a href="/z">z</a>') for k in range(failing, seeds)] + [("https://a.com/z", "z")]
    fetch, asked = table_fetcher(spark.createDataFrame(known, "url string, html string")), []

    def counted(urls):
        asked.extend(r.url for r in urls.collect())
        return fetch(urls)

    engine = Engine(spark, str(tmp_path / "base"), counted, Analyzer(stem=False), tlds=["COM"], buckets=4)
    n = engine.crawl([f"https://a.com/{k:03d}" for k in range(seeds)], limit)
    beyond = {"https://a.com/z"} if expected and len(expected) < limit else set()
    assert urls(engine) == {f"https://a.com/{k:03d}" for k in expected} | beyond and n == len(expected) + len(beyond)
    assert len(asked) == len(set(asked))


def test_frontier_limit_loses_nothing(spark, tmp_path):
    known = [("https://a.com", "".join(f'<a href="/{k}">x</a>' for k in range(7)))] + [(f"https://a.com/{k}", "x") for k in range(7)]
    store = Store(spark, str(tmp_path / "s"))
    crawler = Crawler(spark, store, table_fetcher(spark.createDataFrame(known, "url string, html string")), ["COM"], frontier_limit=3)
    assert crawler.run(["https://a.com"]) == 8 == store.count("pages")


def test_all_pages_of_a_url(spark, tmp_path):
    """Two pages of one URL are stored, indexed and followed as two; a limit keeps them together and loses no other."""
    known = [("https://a.com/1", 'red<a href="/2">x</a>'), ("https://a.com/1", 'blue<a href="/3">x</a><a href="/gone">x</a>'), ("https://a.com/2", "red"), ("https://a.com/3", "green"), ("https://a.com/3", "green")]
    engine = Engine(spark, str(tmp_path / "base"), table_fetcher(spark.createDataFrame(known, "url string, html string")), Analyzer(stem=False), tlds=["COM"], buckets=4)
    assert engine.crawl(["https://a.com/1", "https://a.com/2"], 1) == 2
    assert {r.url for r in engine.store.read("frontier").collect()} == {f"https://a.com/{k}" for k in ("2", "3", "gone")}
    assert engine.crawl([], 10, resume=True) == 3
    pages = engine.store.read("pages").collect()
    assert sorted(r.url for r in pages) == [u for u, _ in known] and len({r.doc_id for r in pages}) == 5
    assert engine.index_documents() == 5 == engine.statistics().first().n_docs
    assert sorted(r["url"] for r in engine.search_json("red", 0.5)) == ["https://a.com/1", "https://a.com/2"]


def test_limit_counts_seeds_that_have_no_page(spark, tmp_path):
    """A URL of two pages doesn't make up for one that failed: it is asked for once."""
    known, asked = [("https://a.com/1", '<a href="/0">x</a>'), ("https://a.com/1", '<a href="/0">y</a>')], []
    fetch = table_fetcher(spark.createDataFrame(known, "url string, html string"))

    def counted(urls):
        asked.extend(r.url for r in urls.collect())
        return fetch(urls)

    assert Crawler(spark, Store(spark, str(tmp_path / "s")), counted, ["COM"]).run(["https://a.com/0", "https://a.com/1"]) == 2
    assert sorted(asked) == ["https://a.com/0", "https://a.com/1"]


@pytest.mark.parametrize("dies_in", [None, "insert", "save_visited", "overwrite"])
def test_a_crawl_goes_on_where_it_ended(spark, tmp_path, monkeypatch, dies_in):
    """A chain of pages with side pages: limited, or killed after each kind of write in its second round."""
    known = [(f"https://a.com/{k}", f'<a href="/{k + 1}">n</a><a href="/x{k}">s</a>') for k in range(4)] + [(f"https://a.com/x{k}", "x") for k in range(3)]
    fetch = table_fetcher(spark.createDataFrame(known, "url string, html string"))

    def crawler(limit):
        return Crawler(spark, Store(spark, str(tmp_path / "s")), fetch, ["COM"], max_pages=limit)

    if dies_in is None:
        assert crawler(2).run(["https://a.com/0"]) == 2
    else:
        whole, calls = getattr(Store, dies_in), []

        def killed(self, *args):
            whole(self, *args)
            calls.append(args)
            if len(calls) > 2:
                raise RuntimeError("killed")

        with monkeypatch.context() as m:
            m.setattr(Store, dies_in, killed)
            with pytest.raises(RuntimeError):
                crawler(100).run(["https://a.com/0"])
    crawler(100).run([], resume=True)
    store = Store(spark, str(tmp_path / "s"))
    found = [r.url for r in store.read("pages").collect()]
    assert sorted(found) == sorted(u for u, _ in known)
    store.compact("pages")
    assert store.count("pages") == len(known)


def test_a_failing_job_is_answered(engine, monkeypatch):
    monkeypatch.setattr(Engine, "index_documents", lambda self, clear=False: 1 / 0)
    status, _, text = answer(engine, "POST", "/indexDocuments", "{}")
    assert status == 500 and "ZeroDivisionError" in text


def test_routes(engine):
    def call(method, target, **body):
        status, _, text = answer(engine, method, target, json.dumps(body))
        return status, text

    assert call("GET", "/")[0] == 200
    assert call("POST", "/crawlAndIndexDocument", seedUrls=["https://a.com"], numberOfPages=10)[0] == 200
    status, text = call("GET", "/search?query=york&accuracy=0.1")
    assert status == 200 and [set(r) for r in json.loads(text)] == [{"title", "content", "url", "score"}] * 2
    assert call("GET", "/search")[0] == 404 == call("GET", "/search?query=a&accuracy=x")[0] == call("GET", "/nothing")[0]
    assert call("GET", "/search?query=not")[0] == 404
    assert call("PUT", "/setRankerParameters", BM25_K1=2.0)[0] == 200 and engine.params.k1 == 2.0
    assert call("PUT", "/setThreadsNumber", threads=4)[0] == 200
    assert call("PUT", "/setThreadsNumber", threads=0)[0] == 404
    assert call("POST", "/crawl", seedUrls=["https://a.com"], numberOfPages=1)[0] == 200
    assert call("POST", "/indexDocuments", clear=True)[0] == 200
    assert call("PUT", "/crawl_terminate", clearDocumentsHistory=False)[0] == 200
    assert call("PUT", "/indexDocuments_terminate", clearIndexHistory=True)[0] == 200
    assert call("DELETE", "/clearCrawlHistory")[0] == 200


def test_server_and_web_fetcher(engine, spark):
    server = serve(engine, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        with urllib.request.urlopen(url) as got:
            assert got.status == 200
        wanted = spark.createDataFrame([(url,), (url + "none",), ("http://127.0.0.1:1/",), ("file:///etc/hostname",), (None,)], "url string")
        rows = {r.url: r.html for r in http_fetcher(partitions=2)(wanted).collect()}
        assert set(rows) == {url, url + "none"} and "Routes" in rows[url]
    finally:
        server.shutdown()


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": spark.createDataFrame([], "doc_id long, v string").schema})
    assert store.count("t") == 0 and store.first("t") is None and store.ping()
    rows = spark.createDataFrame([(k, "a") for k in range(150)], "doc_id long, v string")
    store.insert("t", rows)
    store.upsert("t", spark.createDataFrame([(0, "b"), (999, "c")], "doc_id long, v string"), "doc_id")
    assert store.count("t") == 151 and store.first("t", F.col("doc_id") == 0).v == "b"
    assert store.limited("t", 0).count() == 151 and store.limited("t", 3).count() == 3
    assert store.by_ids("t", list(range(150))).count() == 100 and store.by_ids("t", []).count() == 0
    store.mark_processed(rows)
    assert store.read("processed").count() == 150
    store.clear("t")
    assert store.count("t") == 0


def test_upsert_of_all_pages_of_a_url(spark, tmp_path):
    pages = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "b"), ("v", "a")], "url string, html string")
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        store.upsert("pages", stored_pages(page_documents(pages)), "doc_id")
    rows = store.read("pages").withColumn("plain", F.xxhash64("url")).collect()
    assert sorted((r.url, r.content) for r in rows) == [("u", " a"), ("u", " b"), ("u", " b"), ("v", " a")]
    assert sorted(r.content for r in rows if r.doc_id == r.plain) == [" a", " a"]


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("https://a.com\n\nhttps://b.org\n")
    assert [r.url for r in seed_file(spark, str(tmp_path / "seeds.txt")).collect()] == ["https://a.com", "https://b.org"]
    assert [r.url for r in seeds_from_json(spark, '["x","y"]').collect()] == ["x", "y"]
    assert [r.proxy for r in proxies(spark.createDataFrame([("1:2 3:4\n",)], "value string")).collect()] == ["http://1:2", "http://3:4"]


def test_intermediate_tables_can_be_dropped(spark):
    from lodestone.sources.shared import cut, drop_intermediate

    drop_intermediate(spark)
    kept = cut(spark.range(3), "t")
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://")
    import os

    assert os.path.exists(path)
    assert drop_intermediate(spark) == 1 and not os.path.exists(path)
