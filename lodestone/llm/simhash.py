"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Fingerprints are 64 bits wide.  For radius r every bit position gets a vector
of r + 1 bits, and table v (v not zero) keeps those positions whose vector has
an odd inner product with v.  Two fingerprints that differ in at most r
positions agree on all kept positions of at least one table: the differing
positions' vectors span at most r of the r + 1 dimensions, so some v is
orthogonal to all of them.  No pair within the radius can be missed.

A bucket (table, kept bits) with more fingerprints than ``block`` is dealt out
again by the same construction on the positions that its table left out.
Three levels leave at most 8 positions free, so the last level's buckets hold
at most 256 fingerprints whatever the data are; nothing is capped.

Inside a bucket distances are computed in place, and only a spanning star of
each linked set leaves it, never all pairs.

Defined results: a null or blank text has fingerprint 0, linked like any
other; fewer words than a shingle: the whole sequence is one shingle; repeated
rows are rows of their own; ids may be of any type that has an order; a null
id is passed through and never is a class id (the class id is null if no
member has an id); empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, packed, slices, unpacked, utf8

SEED = 42
WIDTH = 64


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of the lower-cased text's word shingles, repeats included."""
    found = utf8(text).lower().split()
    if not found:
        return 0
    if len(found) < size:
        shingles = [b" ".join(found)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist())]
    total = np.zeros(WIDTH, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(shingles), bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fps = [signed(fingerprint(x, size)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("fp", T.LongType())])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(lambda it: _fingerprinted(it, size), schema)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """The kept positions of each table, as bit masks over ``positions``."""
    tables = 1 << (radius + 1)
    vector = {p: 1 + i % (tables - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, tables)]


def mask_levels(radius: int, levels: int = 3) -> list[list[int]]:
    """Masks of each level; table t of a level has tables t * n ... t * n + n - 1 below it."""
    out = [covering_masks(list(range(WIDTH)), radius)]
    for _ in range(levels - 1):
        below = []
        for kept in out[-1]:
            free = [p for p in range(WIDTH) if not kept >> p & 1]
            below += [kept | m for m in covering_masks(free, radius)]
        out.append(below)
    return out


def _stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Per bucket, edges from the least fingerprint of each linked set to the others."""
    for batch in batches:
        left, right = [], []
        for members in batch.column(0):
            x = np.unique(members.values.to_numpy(zero_copy_only=False))
            if len(x) == 2:
                if ((int(x[0]) ^ int(x[1])) & ((1 << 64) - 1)).bit_count() <= radius:
                    left.append(int(x[0]))
                    right.append(int(x[1]))
                continue
            rest = x
            while len(rest) > 1:
                root, rest = rest[0], rest[1:]
                queue = [root]
                while queue and len(rest):
                    near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= radius
                    if near.any():
                        found = rest[near]
                        rest = rest[~near]
                        queue.extend(found)
                        left.extend([int(root)] * len(found))
                        right.extend(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def links(distinct: DataFrame, radius: int = 3, block: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that span all links within the radius."""
    levels = mask_levels(radius)
    n = len(levels[0])
    rows = distinct.select("fp", F.lit(0).alias("t"))
    edges = None
    for depth, masks in enumerate(levels):
        lookup = F.lit([signed(m) for m in masks])
        keyed = rows.select("fp", F.explode(F.sequence(F.col("t") * n, F.col("t") * n + (n - 1))).alias("t"))
        keyed = keyed.withColumn("k", F.col("fp").bitwiseAND(F.element_at(lookup, F.col("t") + 1)))
        counts = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        found = cut(keyed.join(counts, ["t", "k"]), f"buckets{depth}")
        last = depth == len(levels) - 1
        small = found if last else found.filter(F.col("c") <= block)
        here = small.groupBy("t", "k").agg(F.collect_list("fp").alias("m")).select("m").mapInArrow(lambda it: _stars(it, radius), _EDGE)
        edges = here if edges is None else edges.unionByName(here)
        if last:
            break
        rows = found.filter(F.col("c") > block).select("fp", "t")
        if rows.isEmpty():
            break
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's connected component, for nodes with an edge.

    Alternating large-star and small-star contraction: after each round every
    edge points from a node to a smaller one of the same component, and the
    rounds end when nothing changes.  Minima are pre-aggregated, and the joins
    that hand them back have one row per node on one side, so a hub's edges
    can be split.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        sums = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == before or not sums[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        before = tuple(sums)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3, block: int = 4096, hot_share: float = 0.001) -> DataFrame:
    """(id, fp, component_id, class_fp) of every row of ``df``; class_fp, the least fingerprint, tells classes apart.

    Rows meet their class by fingerprint; those of fingerprints with more than
    ``hot_share`` of all rows, fewer than its inverse in number, by broadcast.
    """
    fps = cut(fingerprints(df, key, text, size), "fingerprints")
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "distinct")
    labels = cut(components(links(distinct, radius, block)), "labels")
    named = labels.join(distinct.withColumnRenamed("fp", "node"), "node")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = named.join(least, "label").select(F.col("node").alias("fp"), "component_id", "label", F.lit(True).alias("linked"))
    classes = distinct.join(linked, "fp", "left").select("fp", "rows", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"), F.coalesce("label", "fp").alias("class_fp"))
    classes = cut(classes, "classes")
    most = hot_share * (distinct.agg(F.sum("rows")).first()[0] or 0)
    hot, cold = (classes.filter(c).drop("rows") for c in (F.col("rows") > most, F.col("rows") <= most))
    one = fps.join(F.broadcast(hot), "fp")
    return one.unionByName(fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp"))


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df``, a stored table, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One document of each class: the one with the least id (of rows that share it, the least fingerprint's, then by a hash of the row).

    Rows without an id can't be named by a class and all stay.  What is joined
    to the documents are the ids that go, not those that stay; up to
    ``broadcast_ids`` of them are broadcast, so that no text is shuffled.
    """
    classes = near_duplicate_classes(df, key, text, size, radius).filter("id is not null")
    first = F.col("id") == F.col("component_id")
    each = classes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("stays"))
    gone = cut(each.filter("n > 1 or not stays"), "gone")
    rows = packed(df, key=F.col(f"`{key}`"), t=F.col(f"`{text}`").cast("string"))
    out = rows.join(_small(gone.select("id"), broadcast_ids), F.col("key") == F.col("id"), "left_anti").select("row")
    shared = gone.filter("n > 1")
    if not shared.isEmpty():
        # An id doesn't tell these rows apart, so their fingerprints are taken again.
        heads = classes.filter(first).groupBy("class_fp").agg(F.min("id").alias("id"), F.min("fp").alias("fp")).select("id", "fp")
        heads = cut(heads.join(shared.select("id"), "id", "left_semi"), "heads")
        print_of = F.udf(lambda x: signed(fingerprint(x, size)), "long")
        ours = rows.join(_small(shared.select("id"), broadcast_ids), F.col("key") == F.col("id")).select("row", "id", print_of("t").alias("fp"))
        nth = F.row_number().over(Window.partitionBy("id", "fp").orderBy(F.xxhash64("row")))
        out = out.unionByName(ours.join(heads, ["id", "fp"]).withColumn("nth", nth).filter("nth = 1").select("row"))
    return unpacked(out)
