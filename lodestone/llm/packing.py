"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are cut into pieces of at most ``capacity`` tokens (only longer ones
are cut; the first piece takes what is left over).  How many pieces have each
length is all the solver needs: a table of at most ``capacity`` rows, whatever
the number of documents.  On it, sets of lengths that provably dominate every
alternative are fixed for as many sequences as they occur, and the rest is
packed best-fit, longest first.  Every piece then finds its place by its rank
among the pieces of its length.  Ranks are counted in salted groups, so that a
length that many documents share is no larger a group than any other.

Defined results: a null text counts as empty (its piece holds the end id
alone); repeated rows are pieces of their own; ids may be of any type or null;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shuffle_partitions, slices
from .tokens import ByteBpe

#: A sequence layout: ((length, how many), ...) in order of place, and the number of sequences laid out so.
Layout = tuple[tuple[tuple[int, int], ...], int]

_PIECE = [*(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")), T.StructField("piece", T.IntegerType()), T.StructField("salt", T.LongType())]
_NAMES = ("doc_id", "start", "length", "ids_crc32", "piece")


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of each piece of n tokens: the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((a, a + capacity) for a in range(first, n, capacity))]


def dominated_pairs(counts: dict[int, int], capacity: int) -> list[Layout]:
    """Fix dominating sets by Martello and Toth's criteria, taking them out of ``counts``.

    For a piece j let k be the most further pieces that fit beside it.  Alone,
    if k = 0.  With the longest piece that fits, b, if k = 1 or b fills the
    sequence exactly; or, if k = 2, when no two pieces that fit together hold
    more than b.  Any other content of j's sequence could be exchanged for the
    fixed one without needing a further sequence.
    """
    fixed: list[Layout] = []

    def fix(lengths: tuple[tuple[int, int], ...], times: int) -> None:
        fixed.append((lengths, times))
        for length, each in lengths:
            counts[length] -= each * times
            if not counts[length]:
                del counts[length]

    for j in sorted(counts, reverse=True):
        b = capacity - j
        if j == capacity:
            fix(((j, 1),), counts[j])
        elif j in counts and b in counts and b <= j:
            if b == j:
                if counts[j] > 1:
                    fix(((j, 2),), counts[j] // 2)
            else:
                fix(((j, 1), (b, 1)), min(counts[j], counts[b]))
    shortest = sorted(counts)
    for j in sorted(counts, reverse=True):
        while counts.get(j):
            room = capacity - j
            shortest = [x for x in shortest if x in counts]
            left = counts[j] - 1

            def others(x: int) -> int:
                return left if x == j else counts[x]

            fit = [x for x in shortest[:4] if others(x)]
            low: list[int] = []
            for x in fit:
                low += [x] * min(others(x), 3 - len(low))
            if not low or low[0] > room:
                fix(((j, 1),), counts[j])
                continue
            b = next(x for x in reversed(shortest[: bisect_left(shortest, room + 1)]) if others(x))
            pairs = len(low) > 1 and low[0] + low[1] <= room
            triples = len(low) > 2 and sum(low) <= room
            if not triples and pairs:
                best, hi = 0, bisect_left(shortest, room + 1) - 1
                lo = 0
                while lo <= hi:
                    s = shortest[lo] + shortest[hi]
                    if s > room:
                        hi -= 1
                        continue
                    if lo != hi or others(shortest[lo]) > 1:
                        best = max(best, s)
                    lo += 1
                pairs = best > b
            if pairs or triples:
                break
            # what is fixed only takes alternatives away, so it holds for as many as there are
            if b == j:
                fix(((j, 2),), counts[j] // 2)
            else:
                fix(((j, 1), (b, 1)), min(counts[j], counts[b]))
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Layout]:
    """Best-fit decreasing on lengths with multiplicities.

    Consecutive pieces of one length behave alike: the fullest sequence that
    can take one takes as many as it can, then the next one.
    """
    by_room: dict[int, list[Layout]] = {}
    rooms: list[int] = []

    def put(room: int, layout: Layout) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(layout)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            lengths, times = by_room[room].pop() if at < len(rooms) else ((), left)
            if room in by_room and not by_room[room]:
                del by_room[room]
                rooms.remove(room)
            each = min(room // length, left)
            used = min(times, left // each)
            if times > used and lengths:
                put(room, (lengths, times - used))
            put(room - each * length, (lengths + ((length, each),), used))
            left -= each * used
    return [x for room in rooms for x in by_room[room]]


def solve(counts: dict[int, int], capacity: int) -> list[Layout]:
    counts = {k: v for k, v in counts.items() if v}
    fixed = dominated_pairs(counts, capacity)
    return fixed + best_fit(counts, capacity)


def slots(layouts: list[Layout]) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many in each, place of the first), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in layouts:
        place = 0
        for length, each in lengths:
            rows.append((length, rank.get(length, 0), sequence, each, place))
            rank[length] = rank.get(length, 0) + each * times
            place += each * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut_up(batches: Iterator[pa.RecordBatch], capacity: int, end_id: int, paths: tuple) -> Iterator[pa.RecordBatch]:
    bpe = ByteBpe(*paths)
    salt = 0
    for batch in slices(batches):
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(bpe.encode(text), np.uint32(end_id)).astype("<u4", copy=False)
            for k, (a, b) in enumerate(piece_bounds(len(ids), capacity)):
                crc = zlib.crc32(ids[a:b].tobytes())
                salt = (salt * 31 + crc + 1) % (1 << 40)
                out.append((doc_id, a, b - a, crc, k, salt))
        columns = list(zip(*out)) if out else [()] * 6
        types = [batch.column(0).type, *[pa.int64()] * 3, pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*_NAMES, "salt"])


def _place(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    t = table.value
    keys = (t[:, 0] << 44) + t[:, 1]
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
        rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
        row = t[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
        nth = rank - row[:, 1]
        kept = [batch.column(batch.schema.get_field_index(n)) for n in _NAMES]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], names=[*_NAMES, "sequence_id", "offset"])


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and a salt that differs also between repeated rows."""
    slim = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return slim.mapInArrow(lambda it: _cut_up(it, capacity, end_id, (tokenizer, ranks)), T.StructType([T.StructField("doc_id", df.schema[key].dataType), *_PIECE]))


def place(cut_up: DataFrame, capacity: int = 2048, group_rows: int = 1_000_000) -> DataFrame:
    """``cut_up`` with sequence_id and offset; it must be a stored table, since it is read three times.

    Pieces of one length are ranked in groups by salt, as many as the shuffle
    has partitions or, for more rows, of about ``group_rows``.
    """
    spark = cut_up.sparkSession
    groups = max(shuffle_partitions(spark), -(-cut_up.count() // group_rows))
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    counts = cut(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    layouts = solve({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)
    table = spark.sparkContext.broadcast(slots(layouts))
    schema = T.StructType([cut_up.schema[n] for n in _NAMES] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*_NAMES, "rank").mapInArrow(lambda it: _place(it, table), schema)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return place(cut(pieces(df, key, text, capacity, end_id, tokenizer, ranks), "pieces"), capacity)
