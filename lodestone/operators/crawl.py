"""Breadth-first crawl as rounds of joins over a frontier."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import page_documents, robots_disallowed
from ..sources.fetch import Fetcher
from ..sources.shared import cut
from ..sources.store import Store, stored_pages


@dataclass
class Crawler:
    """A crawl that stops at ``max_pages``, when the frontier is empty, when told to, or after ``max_rounds`` rounds.

    The frontier is one level of the breadth-first search: URLs that were
    neither visited nor tried by this run.  A round fetches and parses at most
    ``frontier_limit`` of them and stores the pages; the others wait for the
    next round.  When all of a level were tried, the links of its pages make
    the next one.  URLs are told apart by themselves, not by a hash, and a page
    is stored once however many links lead to it.  Where a source has several
    pages of one URL, all are stored, beyond ``max_pages`` if they are the last.

    What is found but not yet tried is a table of the store, ``frontier``,
    after each round.  A crawl that was stopped, came to its limit or died goes
    on from there if run with ``resume``.
    """

    spark: SparkSession
    store: Store
    fetch: Fetcher
    tlds: list[str]
    max_pages: int = 1000
    frontier_limit: int = 1_000_000
    max_rounds: int = 1000
    robots_mode: str = "intended"
    tld_mode: str = "compatible"
    stop: threading.Event = field(default_factory=threading.Event)

    def seeds(self, urls: list[str] | DataFrame) -> DataFrame:
        df = urls if isinstance(urls, DataFrame) else self.spark.createDataFrame([(u,) for u in urls], "url string")
        return df.select(U.normalize_url(F.col("url")).alias("url")).distinct()

    def forbidden(self, domains: DataFrame) -> DataFrame:
        """Absolute URLs that the robots files of bare domains forbid."""
        robots = domains.select(F.col("url").alias("base"), U.robots_url(F.col("url")).alias("url"))
        texts = robots.join(self.fetch(robots.select("url").distinct()), "url")
        paths = texts.select("base", F.explode(robots_disallowed(F.col("html"), self.robots_mode)).alias("path"))
        return paths.select(U.to_absolute(F.col("path"), F.col("base"), self.tlds, self.tld_mode).alias("url")).filter("url is not null").distinct()

    def run(self, seeds: list[str] | DataFrame, clear: bool = False, resume: bool = False) -> int:
        """Crawl from ``seeds`` and, to ``resume``, what earlier crawls left untried; the number of pages stored."""
        if clear:
            self.clear()
        start = self.seeds(seeds)
        if resume:
            # a run may have died between storing pages and noting them as visited
            self.store.save_visited(self.store.read("pages").select("url"))
            start = start.unionByName(self.store.read("frontier")).distinct()
        frontier, stored, rounds = cut(start.filter("url is not null"), "frontier"), 0, 0
        failed = frontier.limit(0)
        self.store.overwrite("frontier", frontier)
        pending = [frontier]
        while not self.ended(stored, rounds):
            visited = self.store.read("visited").select("url")
            rest = level = cut(frontier.join(visited, "url", "left_anti").join(failed, "url", "left_anti"), "level")
            domains = level.filter(U.is_domain(F.col("url"), self.tlds, self.tld_mode))
            if self.robots_mode != "compatible" and not domains.isEmpty():
                banned = cut(self.forbidden(domains), "forbidden")
                self.store.save_visited(banned)
                rest = level = cut(level.join(banned, "url", "left_anti"), "level")
            left = level.count()
            found, tried, had, spread = [], 0, 0, 1
            while left and not self.ended(stored, rounds):
                wanted = self.max_pages - stored
                size = min(wanted * spread, self.frontier_limit, left)
                whole = size == left
                batch = rest if whole else cut(rest.orderBy("url").limit(size), "batch")
                rounds += 1
                got = page_documents(self.fetch(batch).filter("html <> ''"))
                pages, late = cut(got, "pages"), []
                if pages.count() > wanted:
                    # up to the URL of the last page wanted, with all that belongs to it; the others are left to do
                    last = pages.select("url").orderBy("url").limit(wanted).agg(F.max("url")).first()[0]
                    late = [pages.filter(F.col("url") > last).select("url")]
                    pages = pages.filter(F.col("url") <= last)
                n, named = pages.agg(F.count(F.lit(1)), F.countDistinct("url")).first()
                if n:
                    found.append(cut(self.next_frontier(pages), "frontier"))
                # first what is left to do, with the batch itself, so that nothing is lost whenever a run dies
                self.store.overwrite("frontier", reduce(DataFrame.unionByName, found, rest).distinct())
                if n:
                    repeated = pages.groupBy("url").count().filter("count > 1").select("url")
                    self.store.insert("pages", stored_pages(pages, cut(repeated, "repeated")))
                    self.store.save_visited(pages.select("url"))
                    stored += n
                tried, had, left = tried + size, had + named, left - size
                rest = rest.limit(0) if whole else cut(rest.join(batch, "url", "left_anti"), "rest")
                pending = [*found, rest, *late]
                # Where most fetches fail, the last few pages would else take a round each.
                spread = 2 * spread if 2 * named < min(size, wanted) else 1
            if not found:
                break
            if had < tried:
                failed = cut(failed.unionByName(level.join(self.store.read("visited").select("url"), "url", "left_anti")), "failed")
            frontier = found[0] if len(found) == 1 else cut(reduce(DataFrame.unionByName, found).distinct(), "frontier")
        untried = reduce(DataFrame.unionByName, pending).distinct().join(self.store.read("visited").select("url"), "url", "left_anti")
        self.store.overwrite("frontier", untried)
        return stored

    def ended(self, stored: int, rounds: int) -> bool:
        return self.stop.is_set() or stored >= self.max_pages or rounds >= self.max_rounds

    def next_frontier(self, pages: DataFrame) -> DataFrame:
        """Absolute, not yet visited URLs that pages link to."""
        return links_of(pages, self.tlds, self.tld_mode).select(F.col("target").alias("url")).distinct().join(self.store.read("visited").select("url"), "url", "left_anti")

    def terminate(self, clear: bool = False) -> None:
        self.stop.set()
        if clear:
            self.clear()

    def clear(self) -> None:
        for table in ("pages", "visited", "frontier"):
            self.store.clear(table)


def links_of(pages: DataFrame, tlds: list[str], tld_mode: str = "compatible") -> DataFrame:
    """(url, nth, link, target): every link of a page resolved, where that is absolute."""
    links = pages.select("url", F.posexplode("links").alias("nth", "link"))
    resolved = links.withColumn("target", U.to_absolute(F.col("link"), F.col("url"), tlds, tld_mode))
    return resolved.filter(U.is_absolute(F.col("target"), tlds, tld_mode))


def first_occurrence(links: DataFrame) -> DataFrame:
    """Each target once, with the least (url, nth) that leads to it."""
    order = Window.partitionBy("target").orderBy("url", "nth")
    return links.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
