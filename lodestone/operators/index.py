"""Positional inverted index and corpus statistics.

Two access paths give the same frames.  ``ScanIndex`` analyses documents on the
fly: word positions of a query are found inside each document's term array,
with no shuffle at all.  ``StoredIndex`` keeps one row per (term, document) in
hash buckets sorted by term, so a query reads the buckets and row groups of its
terms only, and only of documents that hold one of them.

Statistics are kept as sums (documents, tokens), which add up over batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.stemmer import stem, stem_tokens
from ..sources.files import Files


@dataclass(frozen=True)
class Analyzer:
    """What a token becomes: normalised, stemmed if asked, and empty if filtered; it keeps its position."""

    stem: bool = True
    stop_words: tuple[str, ...] = ()
    valid_only: bool = False

    def terms(self, text: Column) -> Column:
        out = X.terms(text)
        if self.stop_words:
            out = F.transform(out, lambda t: F.when(X.is_stop_word(t, list(self.stop_words)), "").otherwise(t))
        if self.valid_only:
            out = F.transform(out, lambda t: F.when(X.is_valid_word(t), t).otherwise(""))
        return stem_tokens(out) if self.stem else out

    def words(self, phrase: str) -> list[str]:
        """Terms of a query phrase, empty ones dropped."""
        import re

        found = [X.normalize_py(t) for t in re.findall(X.TOKEN, phrase)]
        return [stem(w) if self.stem else w for w in found if w]


def analyze(docs: DataFrame, analyzer: Analyzer = Analyzer(), doc_id: str = "doc_id", title: str | None = None, content: str = "text") -> DataFrame:
    """(doc_id, dl, terms): dl counts all tokens, also those whose term is empty."""
    text = X.document_text(F.col(title) if title else F.lit(""), F.col(content))
    rows = docs.select(F.col(doc_id).alias("doc_id"), analyzer.terms(text).alias("terms"))
    return rows.select("doc_id", F.size("terms").alias("dl"), "terms")


def postings(analyzed: DataFrame) -> DataFrame:
    """(term, doc_id, pos); empty terms dropped."""
    return analyzed.select("doc_id", F.posexplode("terms").alias("pos", "term")).filter("term <> '' and doc_id is not null").select("term", "doc_id", "pos")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sort by (document, term) of a batch's tokens, on arrays."""
    for batch in batches:
        ids, dl, terms = batch.columns
        sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        full = np.flatnonzero(pc.not_equal(known, "").to_numpy(zero_copy_only=False)[code])
        key = doc[full] * max(len(known), 1) + code[full]
        order = np.argsort(key, kind="stable")
        key, at = key[order], full[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[at], pa.int32()))
        head = at[first]
        yield pa.RecordBatch.from_arrays([known.take(pa.array(code[head])), ids.take(pa.array(doc[head])), dl.take(pa.array(doc[head])), positions], names=["term", "doc_id", "dl", "positions"])


def nested_postings(analyzed: DataFrame) -> DataFrame:
    """(term, doc_id, dl, positions), grouped inside each document, without a shuffle.

    Arrow batches and array operations: the same by array lambdas took seven
    microseconds a token, and by a shuffle of tokens more.
    """
    schema = T.StructType([T.StructField("term", T.StringType()), analyzed.schema["doc_id"], T.StructField("dl", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return analyzed.filter("doc_id is not null").select("doc_id", "dl", "terms").mapInArrow(_grouped, schema)


def doc_stats(analyzed: DataFrame) -> DataFrame:
    return analyzed.filter("doc_id is not null").select("doc_id", "dl")


def doc_lengths(docs: DataFrame, doc_id: str = "doc_id", title: str | None = None, content: str = "text") -> DataFrame:
    """``doc_stats`` of documents that needn't be analysed otherwise."""
    text = X.document_text(F.col(title) if title else F.lit(""), F.col(content))
    return docs.select(F.col(doc_id).alias("doc_id"), X.token_count(text).alias("dl")).filter("doc_id is not null")


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs, sum_dl, avg_dl."""
    n, s = F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))
    return stats.agg(n.alias("n_docs"), s.alias("sum_dl")).withColumn("avg_dl", F.when(F.col("n_docs") > 0, F.col("sum_dl") / F.col("n_docs")).otherwise(0.0))


def term_frequencies(nested: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of nested postings."""
    return nested.select("term", "doc_id", F.size("positions").cast("long").alias("tf"))


def document_frequencies(nested: DataFrame) -> DataFrame:
    """(term, df) of nested postings of distinct documents."""
    return nested.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


class ScanIndex:
    """An index over analysed documents that is never written."""

    stored = False

    def __init__(self, docs: DataFrame, analyzer: Analyzer = Analyzer(stem=False), doc_id: str = "doc_id", title: str | None = None, content: str = "text"):
        self.analyzer = analyzer
        self.docs = docs
        self.analyzed = analyze(docs, analyzer, doc_id, title, content).filter("doc_id is not null")

    def positions(self, words: list[str]) -> DataFrame:
        """(doc_id, dl, p0, p1, ...): where each word stands, every document a row."""
        if not words:
            return self.analyzed.select("doc_id", "dl")
        places = F.transform("terms", lambda t, i: F.when(t.isin(words), F.struct(t.alias("t"), i.alias("i"))))
        slim = self.analyzed.select("doc_id", "dl", F.filter(places, lambda x: x.isNotNull()).alias("hits"))
        each = [F.transform(F.filter("hits", _is(w)), lambda x: x.i).alias(f"p{k}") for k, w in enumerate(words)]
        return slim.select("doc_id", "dl", *each)

    def hits(self, words: list[str]) -> DataFrame:
        """``positions`` of the documents that hold one of the words."""
        found = self.positions(words)
        return found.filter(" or ".join(f"size(p{k}) > 0" for k in range(len(words))) if words else "false")


def _is(word: str):
    return lambda x: x.t == word


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_ID, _DL, _ATTEMPT = ("doc_id", T.LongType()), ("dl", T.IntegerType()), ("attempt", T.StringType())
POSTING = _schema(("term", T.StringType()), _ID, _DL, ("positions", T.ArrayType(T.IntegerType())), _ATTEMPT, ("bucket", T.IntegerType()))
DOC_STAT = _schema(_ID, _DL, _ATTEMPT)
REPLACED = _schema(_ID, _DL, ("old", T.StringType()), _ATTEMPT)


@dataclass(frozen=True)
class Batch:
    """A batch as the manifest lists it: what it holds, and what it replaced in earlier ones."""

    name: str
    attempt: str
    buckets: int
    docs: int
    tokens: int
    replaced: int = 0


class StoredIndex:
    """An index under ``path``: ``postings`` by bucket, ``doc_stats``, ``replaced`` and the manifest.

    Every write of a batch goes to folders of its own (an attempt); then a new
    manifest, which lists the attempts that count, is put in place by one
    rename.  So a write that dies leaves nothing behind that is read, a batch
    written again under its name replaces all it held before, and two writers
    can't both succeed from the same state.  Of a document in several batches
    the batch committed last wins: each batch stores which rows of other ones
    it replaces.  ``compact`` makes one batch of all, ``vacuum`` deletes the
    folders that no longer count.  Ids are unique within a batch.
    """

    stored = True

    def __init__(self, spark: SparkSession, path: str, analyzer: Analyzer = Analyzer(), buckets: int | None = None, bucket_bytes: int = 64 << 20):
        self.spark, self.path, self.analyzer, self.buckets, self.bucket_bytes = spark, path.rstrip("/"), analyzer, buckets, bucket_bytes
        self.files = Files(spark, self.path)

    # the manifest ---------------------------------------------------------------

    def _latest(self) -> tuple[int, list[Batch]]:
        versions = sorted(n for n in self.files.names("manifest") if n.endswith(".json"))
        if not versions:
            return 0, []
        return int(versions[-1].removesuffix(".json")), [Batch(**b) for b in json.loads(self.files.read(f"manifest/{versions[-1]}"))]

    def batches(self) -> list[Batch]:
        """In the order of their commits."""
        return self._latest()[1]

    def _commit(self, version: int, batches: list[Batch]) -> None:
        """Put the next manifest in place; fails if another writer did so since ``version`` was read."""
        self.files.write_new(f"manifest/{version + 1:012d}.json", json.dumps([asdict(b) for b in batches]))
        for name in self.files.names("manifest"):
            if name.endswith(".json") and int(name.removesuffix(".json")) < version:
                self.files.delete(f"manifest/{name}")

    # reading ----------------------------------------------------------------------

    def _read(self, table: str, schema: T.StructType, batches: list[Batch]) -> DataFrame:
        where = [f"{table}/attempt={b.attempt}" for b in batches]
        where = [f"{self.path}/{w}" for w in where if self.files.exists(w)]
        if not where:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*where)

    def _live(self, rows: DataFrame, batches: list[Batch]) -> DataFrame:
        """Without what later batches replaced."""
        newer = [b for b in batches if b.replaced]
        if not newer:
            return rows
        dead = self._read("replaced", REPLACED, newer).select("doc_id", F.col("old").alias("attempt"))
        return rows.join(dead, ["doc_id", "attempt"], "left_anti")

    def postings(self) -> DataFrame:
        """(term, doc_id, dl, positions, attempt, bucket)."""
        batches = self.batches()
        return self._live(self._read("postings", POSTING, batches), batches).select(*POSTING.names)

    def doc_stats(self) -> DataFrame:
        """(doc_id, dl, attempt)."""
        batches = self.batches()
        return self._live(self._read("doc_stats", DOC_STAT, batches), batches).select(*DOC_STAT.names)

    def totals(self) -> tuple[int, int]:
        """Documents and tokens: from the manifest or, where batches replaced documents, from doc_stats."""
        batches = self.batches()
        if any(b.replaced for b in batches):
            sums = corpus_stats(self.doc_stats()).first()
            return sums.n_docs, sums.sum_dl
        return sum(b.docs for b in batches), sum(b.tokens for b in batches)

    def hits(self, words: list[str]) -> DataFrame:
        """(doc_id, dl, p0, p1, ...) of the documents that hold one of the words, reading the words' buckets only."""
        batches = self.batches()
        none = F.array().cast("array<int>")
        sizes = {b.buckets for b in batches}
        if not words or not sizes:
            empty = _schema(_ID, _DL, *((f"p{k}", T.ArrayType(T.IntegerType())) for k in range(len(words))))
            return self.spark.createDataFrame([], empty)
        own = self.spark.range(1).select(*[F.array(*[bucket_of(F.lit(w), n) for w in words]).alias(str(n)) for n in sizes]).first()
        found = self._read("postings", POSTING, batches)
        read = F.lit(False)
        for n in sizes:
            at = F.col("bucket").isin(sorted(set(own[str(n)])))
            read = read | (at if len(sizes) == 1 else at & F.col("attempt").isin([b.attempt for b in batches if b.buckets == n]))
        found = self._live(found.filter(read & F.col("term").isin(words)), batches)
        if len(words) == 1:
            return found.select("doc_id", "dl", F.col("positions").alias("p0"))
        each = [F.coalesce(F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True), none).alias(f"p{k}") for k, w in enumerate(words)]
        return found.groupBy("doc_id").agg(F.first("dl").alias("dl"), *each)

    def positions(self, words: list[str]) -> DataFrame:
        """As ScanIndex.positions: every document a row."""
        stats = self.doc_stats().select("doc_id", "dl")
        if not words:
            return stats
        rows = stats.join(self.hits(words).drop("dl"), "doc_id", "left")
        return rows.select("doc_id", "dl", *[F.coalesce(f"p{k}", F.array().cast("array<int>")).alias(f"p{k}") for k in range(len(words))])

    # writing ----------------------------------------------------------------------

    def _write(self, df: DataFrame, table: str, attempt: str, *parts: str) -> None:
        df.write.partitionBy(*parts).parquet(f"{self.path}/{table}/attempt={attempt}")

    def _put(self, nested: DataFrame, size: int) -> tuple[str, int]:
        """Write nested postings of about ``size`` bytes of text as a new attempt; its name and number of buckets.

        One shuffle, by (bucket, salt of the document), so that a frequent
        term is never one task's.
        """
        attempt = "a" + uuid.uuid4().hex
        tasks = max(1, -(-size // self.bucket_bytes))
        buckets = self.buckets or max(1, -(-tasks // 8))
        salts = max(1, -(-tasks // buckets))
        rows = nested.withColumn("bucket", bucket_of(F.col("term"), buckets)).withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
        rows = rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "term", "doc_id")
        self._write(rows.select("term", F.col("doc_id").cast("long").alias("doc_id"), "dl", "positions", "bucket"), "postings", attempt, "bucket")
        return attempt, buckets

    def add(self, docs: DataFrame, batch: int | str, doc_id: str = "doc_id", title: str | None = None, content: str = "text") -> Batch:
        """Index ``docs`` as batch ``batch``, in place of what that batch held and of older versions of its documents."""
        version, batches = self._latest()
        rows = analyze(docs, self.analyzer, doc_id, title, content).filter("doc_id is not null")
        size = docs.select(F.sum(F.octet_length(F.col(content).cast("string")))).first()[0] or 0
        attempt, buckets = self._put(nested_postings(rows), size)
        self._write(doc_lengths(docs, doc_id, title, content).select(F.col("doc_id").cast("long").alias("doc_id"), "dl"), "doc_stats", attempt)
        others = [b for b in batches if b.name != str(batch)]
        new = Batch(str(batch), attempt, buckets, 0, 0)
        own = self._read("doc_stats", DOC_STAT, [new])
        n = 0
        if others:
            older = self._read("doc_stats", DOC_STAT, others).withColumnRenamed("attempt", "old")
            self._write(older.join(own.select("doc_id"), "doc_id", "left_semi").select("doc_id", "dl", "old"), "replaced", attempt)
            n = self._read("replaced", REPLACED, [new]).count()
        sums = corpus_stats(own).first()
        new = replace(new, docs=sums.n_docs, tokens=sums.sum_dl, replaced=n)
        self._commit(version, [*others, new])
        return new

    def compact(self, name: str = "compacted") -> Batch | None:
        """Make one batch of all that counts."""
        version, batches = self._latest()
        if not batches:
            return None
        stats, posts = self.doc_stats().select("doc_id", "dl"), self.postings().select("term", "doc_id", "dl", "positions")
        n, tokens = self.totals()
        attempt, buckets = self._put(posts, 6 * tokens)
        self._write(stats, "doc_stats", attempt)
        new = Batch(name, attempt, buckets, n, tokens)
        self._commit(version, [new])
        return new

    def vacuum(self) -> int:
        """Delete attempts that no longer count; their number.  For when no result that reads them and no writer is left."""
        counted = {f"attempt={b.attempt}" for b in self.batches()}
        gone = {(table, n) for table in ("postings", "doc_stats", "replaced") for n in self.files.names(table) if n.startswith("attempt=") and n not in counted}
        for table, n in gone:
            self.files.delete(f"{table}/{n}")
        return len({n for _, n in gone})

    def clear(self) -> None:
        self._commit(self._latest()[0], [])
        self.vacuum()
