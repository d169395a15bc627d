"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset, as in local tests, one temporary folder of the driver
    serves, since driver and executors are one machine then; with any other
    master that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps then neither recompute it nor depend on the executors that
    made it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediate(spark: SparkSession) -> int:
    """Delete the intermediate tables this driver has written; the number of them.

    For when no result that reads them is needed any more: results are lazy
    and read these tables when they are used.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        where = jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(conf).delete(where, True)
    return n
