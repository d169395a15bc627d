"""Mixing sources to target weights by weighted fair queueing.

Each document of a source, in shuffled order, gets a virtual finish time: the
source's tokens up to and including it, divided by the source's target.  A
source that must give more than it has passes through its documents again.
All passes are range-sorted by finish time, and the mix is what comes before
the total budget is used up.

Running sums come in two steps, per slice of the shuffle order and then inside
the slices, so that a source with a third of all rows is as many groups as its
rows need.  The driver sees one row per source (the mixture's components) and
one per range partition.

Defined results: a null text has size 0; a null source is a source, last in
order; documents of size 0 take nothing; repeated rows are taken each by
itself; ids may be of any type that has an order, and a null one comes before
all others; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, packed, shuffle_partitions, unpacked


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Tokens to take of each source.

    Sources in code point order, null last, weigh as ``weights`` repeating and
    share ``share`` of all tokens; what exceeds ``most`` times a source's own
    tokens is shared anew among the others, until no source exceeds that.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget = share * sum(sizes.values())
    out: dict[str | None, float] = {}
    open_ = list(names)
    while open_:
        left = budget - sum(out.values())
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if given[s] > most * sizes[s]]
        if not over:
            return out | given
        out |= {s: most * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in out]
    return out


def shuffled(seed: int) -> Column:
    """The place of ``doc_id`` in the shuffled order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))


def mix(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, slice_rows: int = 5000, broadcast_sources: int = 20_000, most_sources: int = 1_000_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for stored rows (doc_id, source, size).

    More than ``most_sources`` sources are an error: they are the components of
    a mixture, and the driver sees them all.
    """
    spark = sized.sparkSession
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(most_sources + 1).collect()
    if len(by_source) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = {r.source: r["size"] for r in by_source}
    goal = targets(sizes, weights, share, most)
    rows = sum(r.n for r in by_source)
    digits = max(0, min(6, math.ceil(math.log(rows / slice_rows, 16)))) if rows > slice_rows else 0
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("sid", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    known = spark.createDataFrame([(s, k, sizes[s], float(goal[s])) for k, s in enumerate(goal)], schema)
    if len(goal) <= broadcast_sources:
        known = F.broadcast(known)
    docs = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    docs = docs.withColumn("h", shuffled(seed)).withColumn("slice", F.substring("h", 1, digits))
    before = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("sid", "slice").agg(F.sum("size").alias("n"))
    first = sums.select("sid", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("sid", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = cut(docs.join(first, ["sid", "slice"]).withColumn("upto", F.col("first") + F.sum("size").over(within)), "queued")

    def position(k: int) -> Column:
        finish = (F.col("upto") + k * F.col("source_size")).cast("double") / F.col("target")
        return F.struct(finish.alias("finish"), F.col("h"), F.col("doc_id").alias("id"), F.lit(k).alias("k"))

    real = queued.filter("target > 0 and size > 0")
    passes = None
    for k in range(most):
        one = real.select(position(k).alias("at"), "size")
        passes = one if passes is None else passes.unionByName(one)
    n = shuffle_partitions(spark)
    ranged = cut(passes.repartitionByRange(n, "at").withColumn("part", F.spark_partition_id()), "ranged")
    budget, before_part, last, whole = min(share, most) * sum(sizes.values()), 0, None, None
    for r in sorted(ranged.groupBy("part").agg(F.sum("size").alias("n")).collect()):
        if before_part + r.n > budget:
            running = F.sum("size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
            fit = ranged.filter(F.col("part") == r.part).select("at", running.alias("n")).filter(F.col("n") + before_part <= budget)
            last = fit.agg(F.max("at").alias("at")).first().at
            break
        before_part += r.n
        whole = r.part
    taken = F.lit(0).cast("long")
    if last is None and whole is not None:
        last = ranged.filter(F.col("part") == whole).agg(F.max("at").alias("at")).first().at
    if last is not None:
        limit = F.struct(F.lit(last.finish).cast("double"), F.lit(last.h), F.lit(last.id).cast(sized.schema["doc_id"].dataType), F.lit(last.k).cast("int"))
        taken = sum((F.when((F.col("target") > 0) & (position(k) <= limit), F.col("size")).otherwise(0) for k in range(most)), taken)
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def sizes_of(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return cut(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), n_words(text).alias("size")), "sizes")


def mixed_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, broadcast_sources: int = 20_000, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns.

    In its source's shuffled order a pass takes the documents up to some place,
    so what the documents have to be joined with is one place per source and
    pass, and no text is shuffled.  Only rows that have the very id and size of
    such a place, of which the mix takes but some, are told apart by a hash.
    """
    most = how.get("most", 2)
    decided = cut(mix(sizes_of(df, key, source, text), seed=seed, broadcast_sources=broadcast_sources, **how), "decided")
    here = F.struct(shuffled(seed).alias("h"), F.col("doc_id").alias("id"), F.col("size").alias("n"))
    passes = decided.filter("size > 0").withColumn("times", (F.col("taken") / F.col("size")).cast("int")).withColumn("at", here)
    last = [F.max(F.when(F.col("times") > k, F.col("at"))).alias(f"last{k}") for k in range(most)]
    ends = cut(passes.groupBy("source").agg(*last), "ends")
    n = ends.count()
    hint = F.broadcast if n <= broadcast_sources else lambda x: x
    on_end = passes.join(hint(ends.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    counts = [F.sum((F.col("at").eqNullSafe(F.col(f"last{k}")) & (F.col("times") > k)).cast("long")).alias(f"some{k}") for k in range(most)]
    counts += [F.sum(F.col("at").eqNullSafe(F.col(f"last{k}")).cast("long")).alias(f"all{k}") for k in range(most)]
    some = cut(on_end.groupBy("source").agg(*counts).withColumnRenamed("source", "t"), "some")
    bounds = ends.join(some, F.col("source").eqNullSafe(F.col("t"))).drop("t").withColumnRenamed("source", "s")
    rows = packed(df, doc_id=F.col(f"`{key}`"), source=F.col(f"`{source}`").cast("string"), size=n_words(text)).filter("size > 0").withColumn("at", here)
    joined = rows.join(hint(bounds), F.col("source").eqNullSafe(F.col("s")))
    split = [F.col("at").eqNullSafe(F.col(f"last{k}")) & (F.col(f"some{k}") < F.col(f"all{k}")) for k in range(most)]
    unclear = split[0]
    for c in split[1:]:
        unclear = unclear | c
    clear = sum((F.when(F.col("at") <= F.col(f"last{k}"), 1).otherwise(0) for k in range(most)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("s", "at").orderBy(F.xxhash64("row")))
    told = sum((F.when(F.when(c, F.col("nth") <= F.col(f"some{k}")).otherwise(F.col("at") <= F.col(f"last{k}")), 1).otherwise(0) for k, c in enumerate(split)), F.lit(0))
    out = joined.filter(~unclear).select("row", clear.alias("copies"))
    if not some.filter(" or ".join(f"some{k} < all{k}" for k in range(most))).isEmpty():
        out = out.unionByName(joined.filter(unclear).withColumn("nth", nth).select("row", told.alias("copies")))
    return unpacked(out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def oracle(weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7) -> str:
    """The mix of ``documents`` as SQL for DuckDB.

    Targets without a loop: by falling excess, the first k sources stop at
    their most, for the least k at which no other source exceeds its own.
    """
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(concat_ws(':', '{seed}', CAST(doc_id AS VARCHAR))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS DOUBLE) AS w, CAST({most} * source_size AS DOUBLE) AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source) AS k FROM w),
b AS (SELECT {share} * sum(source_size) AS budget, sum(w) AS all_w, {min(share, most)} * sum(source_size) AS cut FROM o),
c AS (SELECT n.k, budget - coalesce((SELECT sum(cap) FROM o WHERE o.k <= n.k), 0) AS rest, all_w - coalesce((SELECT sum(w) FROM o WHERE o.k <= n.k), 0) AS total FROM (SELECT 0 AS k UNION ALL SELECT k FROM o) n, b),
f AS (SELECT min(c.k) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k > c.k AND c.rest * o.w / c.total > o.cap)),
t AS (SELECT o.source, o.source_size, CASE WHEN o.k <= f.k THEN o.cap ELSE c.rest * o.w / c.total END AS target FROM o, f JOIN c ON c.k = f.k),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, size, k, sum(size) OVER (ORDER BY CAST(upto + k * source_size AS DOUBLE) / target, h, doc_id, k ROWS UNBOUNDED PRECEDING) AS running FROM q, (SELECT unnest(range({most})) AS k) WHERE target > 0 AND size > 0),
m AS (SELECT doc_id, sum(size) AS taken FROM p, b WHERE running <= cut GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(m.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN m ON q.doc_id = m.doc_id"""
