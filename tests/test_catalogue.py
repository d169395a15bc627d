import subprocess
import sys

import pytest

from lodestone.catalogue import ORACLE, QUERIES
from tests.conftest import ROOT, SMALL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(same, name):
    same(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["page_title", "html_lang", "link_counts", "html_text", "page_document", "crawl_bfs", "store_roundtrip"])
def test_pages_of_one_url(spark, tmp_path, name):
    """Pages share a URL, also with equal text, and end in cut references."""
    import duckdb

    html = ['<html lang="en"><title>a &amp; b&amp</title><a href="/x">x</a>', '<html lang="de"><title>c</title><p>z&amp</p>', '<html lang="en"><title>d</title>', '<title>x</title>']
    urls = ["https://a.example.com/p", "https://a.example.com/p", "https://a.example.com/q", "https://a.example.com/x"]
    rows = [(k, u, h) for k, (u, h) in enumerate(zip([*urls, urls[2], urls[2]], [*html, html[2], "<title>e</title>"]))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    theirs = con.sql(ORACLE[name])
    ours = con.sql(f"select * from '{tmp_path}/out/*.parquet'").project(", ".join(f'"{n}"' for n in theirs.columns))
    assert sorted(map(repr, ours.fetchall())) == sorted(map(repr, theirs.fetchall()))


def test_entry_without_the_corpus_subpackage():
    code = "import sys; sys.modules['lodestone.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_term' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from lodestone.sources.shared import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(cluster)


def test_nothing_else_imports_the_corpus_subpackage():
    import pathlib

    for p in pathlib.Path(ROOT, "lodestone").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
