import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash as S
from lodestone.llm.queries import op1_simhash
from tests.conftest import SMALL


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps: dict[int, int], radius=3) -> dict[int, int]:
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_every_pair_within_the_radius_shares_a_table_at_every_level():
    levels = S.mask_levels(3)
    assert [len(x) for x in levels] == [15, 225, 3375]
    rng = random.Random(1)
    for _ in range(300):
        differing = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        tables = [0]
        for masks in levels:
            tables = [t * 15 + v for t in tables for v in range(15) if not masks[t * 15 + v] & differing]
            assert tables
    assert max(64 - m.bit_count() for m in levels[-1]) <= 8


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b c d e f g a b c", "é É x y", "word " * 5000])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_links_against_all_pairs(spark, block):
    rng = random.Random(block)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(120):
        fps.append(rng.choice(fps) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(S.signed(x),) for x in fps], "fp long")
    edges = S.links(df, block=block).collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() < 64 for e in edges)
    labels = {r.node: r.label for r in S.components(S.links(df, block=block)).collect()}
    brute = brute_classes({k: x for k, x in enumerate(fps)})
    groups = {}
    for k, x in enumerate(fps):
        groups.setdefault(brute[k], set()).add(labels.get(S.signed(x), S.signed(x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_chain(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)]
    random.Random(2).shuffle(pairs)
    labels = {r.node: r.label for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert labels == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark):
    rows = op1_simhash(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_classes(fps)


def test_odd_rows(spark):
    schema = "doc_id long, text string, id long, fp string, row int, label string"
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, 1, "a", 1, None), (5, text, 1, "a", 1, None), (3, text, None, None, None, None), (None, text, 9, "b", 2, "x"), (8, None, 1, "c", 3, "y"), (9, "", 1, "d", 4, "z"), (None, "alone in the world", 1, "e", 5, "q")]
    df = spark.createDataFrame(rows, schema)
    found = [(r.id, r.component_id) for r in S.near_duplicate_classes(df).collect()]
    assert sorted(found, key=str) == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (8, 8), (9, 8), (None, None)], key=str)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1 for r in kept.collect())) == [-1, -1, 3, 8]
    one = S.keep_one(df.filter("doc_id = 5"))
    assert one.count() == 1 and one.first().fp == "a"
    assert S.keep_one(df.limit(0)).count() == 0 == S.near_duplicate_classes(df.limit(0)).count()


def test_many_copies_make_no_pairs(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text in every one of the rows").alias("text"))
    assert {r.component_id for r in S.near_duplicate_classes(df).collect()} == {0}


def test_star_edges_stay_within_the_radius_graph():
    import pyarrow as pa

    x = np.array([0, 1, 3, 7, 15, 3 << 40], np.int64)
    out = list(S._stars([pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.int64()))], names=["m"])], 1))
    assert sorted(zip(out[0][0].to_pylist(), out[0][1].to_pylist())) == [(0, 1), (0, 3), (0, 7), (0, 15)]


def test_each_class_keeps_one_row_where_ids_repeat(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, one), (1, two), (1, two), (2, one), (2, three), (3, three), (4, two)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, one), (1, two), (2, three)]
