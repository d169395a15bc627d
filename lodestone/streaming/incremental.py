"""Incremental indexing: new page files become index batches exactly once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import StoredIndex
from ..sources.store import Store


def index_new(store: Store, index: StoredIndex, batch: str | None = None, title: str = "title", content: str = "content") -> int:
    """Index the stored pages not yet processed as one batch, then mark them; their number.

    Marking comes last.  A run that dies before is repeated: its pages are
    indexed again, and of a page in two batches only the later one counts.
    """
    new = store.unprocessed().dropDuplicates(["doc_id"])
    n = new.count()
    if n:
        index.add(new, batch or f"pages-{uuid.uuid4().hex}", "doc_id", title, content)
        store.mark_processed(new)
    return n


def index_stream(spark: SparkSession, source: str, index: StoredIndex, checkpoint: str, schema=None, doc_id: str = "doc_id", title: str | None = "title", content: str = "content", files_per_trigger: int = 1000, name: str = "stream") -> StreamingQuery:
    """Index page files as they appear under ``source``; stops when all present ones are done.

    A micro-batch is the index batch of the stream's ``name`` and its number,
    so a repeated one replaces what it wrote before, and no other batch.
    """
    schema = schema or spark.read.parquet(source).schema

    def add(df: DataFrame, epoch: int) -> None:
        index.add(df, f"{name}-{epoch}", doc_id, title, content)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
