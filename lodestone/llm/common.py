"""Shared helpers: words, stored intermediate tables, table access."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir

__all__ = ["BLANKS", "WORD", "count_blanks", "cut", "packed", "shared_dir", "shuffle_partitions", "slices", "table", "unpacked", "utf8"]

#: A word is a maximal run without space and ``\t \n \v \f \r``, which is what
#: ``bytes.split()`` cuts at.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def count_blanks(text: str) -> int:
    return sum(map(text.count, BLANKS))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts at a time become Python objects and results leave early."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """Every row as one column ``row`` beside computed ones, so that no name of ``df`` can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in named.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")
