import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing as M
from lodestone.llm.queries import ORACLE, op7_mixing
from tests.conftest import SMALL


def brute_targets(sizes):
    """Water level by bisection: each source takes min(2 size, level x weight)."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, lo, hi = 1.5 * sum(sizes.values()), 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * w[s]) for s in names) < budget else (lo, mid)
    return {s: min(2 * sizes[s], hi * w[s]) for s in names}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 5, None: 7}, {"a": 0, "b": 0}, {"a": 5}, {}, {f"s{k}": 17 * k * k % 101 for k in range(20)}])
def test_targets(sizes):
    assert M.targets(sizes) == pytest.approx(brute_targets(sizes), abs=1e-6)


def brute_mix(rows, seed_of):
    """rows: (doc_id, source, size); the mix by sorting all passes on one list."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal = M.targets(sizes)
    passes = []
    for s in sizes:
        own = sorted((seed_of[i], i, n) for i, t, n in rows if t == s)
        for k in (0, 1):
            upto = k * sizes[s]
            for h, i, n in own:
                upto += n
                if n and goal[s]:
                    passes.append((upto / goal[s], h, i, k, n))
    out, total = {i: 0 for i, _, _ in rows}, 0
    for _, _, i, _, n in sorted(passes):
        total += n
        if total > sum(goal.values()):
            break
        out[i] += n
    return out, goal, sizes


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("h")).collect()
    rows = [(d.doc_id, d.source, len(re.findall(r"[^\x20\x09-\x0D]+", d.text))) for d in docs]
    taken, goal, sizes = brute_mix(rows, {d.doc_id: d.h for d in docs})
    got = op7_mixing(spark, SMALL).collect()
    source = {i: s for i, s, _ in rows}
    assert {r.doc_id: r.taken for r in got} == taken
    assert all(r.target == goal[source[r.doc_id]] and r.source_size == sizes[source[r.doc_id]] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op7_mixing(spark, SMALL).collect()))


def test_query_equals_its_sql(same):
    same(op7_mixing, ORACLE["op7_mixing"])


def test_many_small_documents_come_near_their_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit("one two three").alias("text"))
    rows = M.mix(M.sizes_of(df), slice_rows=100).collect()
    per = {}
    source = {r.doc_id: r.source for r in df.collect()}
    for r in rows:
        per.setdefault(source[r.doc_id], [r.target, 0])[1] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(a - b) <= 6 for a, b in per.values())


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, size string, n string, key int, row int"
    rows = [(1, "a b c", "x", "1", None, 1, 1), (1, "a b c", "x", "1", None, 1, 1), (2, None, "x", None, None, None, None), (None, "d e", None, None, None, None, None), (3, "", None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = M.mix(M.sizes_of(df)).collect()
    assert len(got) == 5 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in got)
    assert M.mix(M.sizes_of(df.limit(0))).count() == 0 == M.mixed_documents(df.limit(0)).count()
    assert M.mixed_documents(df.filter("doc_id = 2")).count() == 0
