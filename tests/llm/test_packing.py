import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import packing as P
from lodestone.llm.queries import op6_packing
from lodestone.llm.tokens import _SETTLED, ByteBpe, _exact
from tests.conftest import SMALL


def fewest(items, capacity):
    """Least number of sequences by exhaustive search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[k]:
                rest = list(rooms)
                rest.remove(r)
                go(k + 1, [*rest, r - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def used(layouts, capacity, counts):
    got = Counter()
    for lengths, times in layouts:
        assert times > 0 and sum(a * n for a, n in lengths) <= capacity
        for a, n in lengths:
            got[a] += n * times
    assert got == Counter(counts)
    return sum(t for _, t in layouts)


def test_dominance_never_costs_a_sequence():
    rng = random.Random(4)
    for _ in range(400):
        capacity = rng.randint(4, 12)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = dict(Counter(items))
        fixed = P.dominated_pairs(counts, capacity)
        rest = [a for a, n in counts.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + fewest(rest, capacity) == fewest(items, capacity), items


def test_solutions_are_whole_and_close_to_the_bound():
    rng = random.Random(5)
    for _ in range(500):
        capacity = rng.randint(3, 40)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 60)))
        used(P.solve(dict(counts), capacity), capacity, counts)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(50_000))
    n = used(P.solve(dict(counts), 2048), 2048, counts)
    assert n <= 1.001 * -(-sum(a * k for a, k in counts.items()) // 2048)


@pytest.mark.parametrize("n", [1, 5, 10, 11, 25, 30])
def test_piece_bounds(n):
    bounds = P.piece_bounds(n, 10)
    assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    assert all(b - a == 10 for a, b in bounds[1:]) and all(0 < b - a <= 10 for a, b in bounds)


def checked(rows, texts):
    """That rows place every token of texts once, in sequences without gaps."""
    bpe = ByteBpe()
    expected = Counter()
    for doc_id, text in texts:
        ids = np.append(_exact(bpe.path).encode(text or "", add_special_tokens=False).ids, 0).astype("<u4")
        for k, (a, b) in enumerate(P.piece_bounds(len(ids), 2048)):
            expected[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), sum(r.length for r in rows)


def test_query_against_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    n, total = checked(op6_packing(spark, SMALL).collect(), texts)
    assert n <= -(-total // 2048) + 2


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x"), (4, "wörd 漢字 😀 " * 3000), (5, "a" * 20_000)] + [(k, "same length") for k in range(10, 60)]
    df = spark.createDataFrame([(*t, 1, 2, "s") for t in texts], "doc_id long, text string, length int, rank int, salt string")
    checked(P.pack(df).collect(), texts)
    assert P.pack(df.limit(0)).count() == 0


def test_fast_encoding_is_exact():
    bpe = ByteBpe()
    settled = [chr(c) for c in range(0x3000) if not _SETTLED.search(chr(c))]
    assert len(settled) > 400
    exact = _exact(bpe.path)
    for c in settled:
        for text in (c, f"a{c}b", f" {c}{c}", f"1{c}2 {c}"):
            assert bpe.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice([*settled, *" \n" * 60, "漢", "😀", "<|endoftext|>"]) for _ in range(40))
        assert bpe.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
        assert bpe.decode_bytes(bpe.encode(text).tolist()).decode() == text


def test_layout_places_are_unique():
    table = P.slots(P.solve({3: 7, 5: 4, 10: 2, 1: 30}, 10))
    assert len(np.unique(table[:, :2], axis=0)) == len(table)
