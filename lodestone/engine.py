"""The facade: crawl, index, search, and their settings."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.urls import top_level_domains
from .operators.crawl import Crawler
from .operators.index import Analyzer, StoredIndex, corpus_stats
from .operators.snippets import search
from .plans.query import Modes
from .plans.rank import RankerParams
from .sources.fetch import Fetcher, http_fetcher
from .sources.store import Store
from .streaming.incremental import index_new


class Engine:
    """Crawl, index and search under one base path (any file system Spark knows)."""

    def __init__(self, spark: SparkSession, path: str, fetch: Fetcher | None = None, analyzer: Analyzer = Analyzer(), params: RankerParams = RankerParams(), modes: Modes = Modes(), tlds: list[str] | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path)
        self.index = StoredIndex(spark, f"{self.path}/index", analyzer, buckets)
        self.fetch = fetch or http_fetcher()
        self.params, self.modes = params, modes
        self.tlds = tlds
        self._crawler: Crawler | None = None
        self._tag = f"lodestone-index-{uuid.uuid4().hex}"

    def search(self, query: str, accuracy: float = 0.5, limit: int = 100) -> DataFrame:
        """(doc_id, title, content, url, score), best first."""
        pages = self.store.read("pages")
        out = search(self.index, pages, query, accuracy, limit, self.params, self.modes, "doc_id", "title", "content", "url")
        return out.orderBy(F.desc("score"), "doc_id")

    def search_json(self, query: str, accuracy: float = 0.5) -> list[dict]:
        return [{k: r[k] for k in ("title", "content", "url", "score")} for r in self.search(query, accuracy).collect()]

    def crawl(self, seeds: list[str] | DataFrame, max_pages: int, clear: bool = False, resume: bool = False) -> int:
        self.tlds = self.tlds or top_level_domains(self.spark)
        self._crawler = Crawler(self.spark, self.store, self.fetch, self.tlds, max_pages)
        return self._crawler.run(seeds, clear, resume)

    def terminate_crawl(self, clear: bool = False) -> None:
        if self._crawler:
            self._crawler.terminate(clear)
        elif clear:
            self.clear_crawl_history()

    def index_documents(self, clear: bool = False) -> int:
        """Index what is not yet indexed (after ``clear``: everything); the number of documents."""
        if clear:
            self.clear_index()
        context = self.spark.sparkContext
        context.addJobTag(self._tag)
        try:
            return index_new(self.store, self.index)
        finally:
            context.removeJobTag(self._tag)

    def terminate_index(self, clear: bool = False) -> None:
        """Cancel this engine's indexing jobs, and no others."""
        self.spark.sparkContext.cancelJobsWithTag(self._tag)
        if clear:
            self.clear_index()

    def clear_index(self) -> None:
        self.index.clear()
        self.store.clear("processed")

    def compact(self) -> None:
        """Make one index batch of all, few files of each table, and delete what no longer counts; for when no search or crawl is running."""
        for table in ("pages", "visited", "processed"):
            self.store.compact(table)
        self.index.compact()
        self.index.vacuum()

    def crawl_and_index(self, seeds: list[str] | DataFrame, max_pages: int, clear: bool = False) -> tuple[int, int]:
        return self.crawl(seeds, max_pages, clear), self.index_documents(clear)

    def clear_crawl_history(self) -> None:
        for table in ("pages", "visited", "frontier"):
            self.store.clear(table)

    def set_ranker_parameters(self, **values: float) -> RankerParams:
        """k1, b, phrase_boost, exact_match_weight."""
        self.params = replace(self.params, **values)
        return self.params

    def set_parallelism(self, n: int, most: int | None = None) -> None:
        """Shuffle partitions, between 0 and what there is, both excluded."""
        most = most or max(self.spark.sparkContext.defaultParallelism, os.cpu_count() or 1) * 1000
        if not 0 < n < most:
            raise ValueError(f"parallelism must be above 0 and below {most}")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(n))

    def statistics(self) -> DataFrame:
        return corpus_stats(self.index.doc_stats())
