"""URL functions as column expressions."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The patterns of absolute URLs, of anything like a URL, and of bare domains.
_PREFIX = r"^(https?://)([a-zA-Z0-9-]+\.)+[a-zA-Z0-9-]+"
_ANY = r"(https?://)?([a-zA-Z0-9.-]+)(/[^\s]*)?"
_DOMAIN = r"^(https?://)?([a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}/?$"
#: The patterns of a page's scheme, and of its scheme and host.
_SCHEME = "^(https?:)"
_ORIGIN = "^([a-zA-Z]+://[^/]+)"


@lru_cache(maxsize=4)
def _suffixes(java_home: str) -> tuple[str, ...]:
    """Top-level domains that the Java runtime's public suffix list knows."""
    found = glob.glob(os.path.join(java_home, "lib/security/public_suffix_list.dat"))
    if not found:
        raise FileNotFoundError("this Java runtime has no public suffix list; pass the top-level domains")
    with zipfile.ZipFile(found[0]) as z:
        return tuple(sorted(n.upper() for n in z.namelist() if n.isascii() and "/" not in n))


def top_level_domains(spark: SparkSession, path: str | None = None) -> list[str]:
    """Upper-case top-level domains: one per line of ``path``, else those of the Java runtime."""
    if path:
        return sorted(r.value.strip().upper() for r in spark.read.text(path).filter("trim(value) <> ''").collect())
    return list(_suffixes(spark.sparkContext._jvm.java.lang.System.getProperty("java.home")))


def normalize_url(c: Column) -> Column:
    """Without trailing ``* $ / ?``, and cut at the first ``/*``."""
    return F.substring_index(F.regexp_replace(c, r"[*$/?]+$", ""), "/*", 1)


def host_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]+)", 1)


def is_valid_tld(c: Column, tlds: list[str], mode: str = "compatible") -> Column:
    """Whether the top-level domain is a known one.

    ``compatible`` looks after the last dot of the whole string, up to a slash;
    ``intended`` looks at the host.
    """
    if mode == "compatible":
        tail = F.split_part(F.substring_index(c, ".", -1), F.lit("/"), F.lit(1))
        return c.contains(".") & F.upper(tail).isin(tlds)
    host = F.when(host_of(c) != "", host_of(c)).otherwise(F.regexp_extract(c, r"^([^/?#:]+)", 1))
    return host.contains(".") & F.upper(F.substring_index(host, ".", -1)).isin(tlds)


def is_absolute(c: Column, tlds: list[str], mode: str = "compatible") -> Column:
    return c.rlike(_PREFIX) & is_valid_tld(c, tlds, mode)


def is_url(c: Column) -> Column:
    return c.rlike(_ANY)


def is_domain(c: Column, tlds: list[str], mode: str = "compatible") -> Column:
    return c.rlike(_DOMAIN) & is_valid_tld(c, tlds, mode)


def is_protocol_relative(c: Column) -> Column:
    return c.startswith("//")


def is_root_relative(c: Column) -> Column:
    return c.startswith("/")


def is_ignored(c: Column) -> Column:
    return c.isin("", "/") | c.startswith("#")


def to_absolute(url: Column, base: Column, tlds: list[str], mode: str = "compatible") -> Column:
    """``url`` as found on page ``base``; null where ``base`` has no scheme or host to take over."""
    scheme = F.regexp_extract(base, _SCHEME, 1)
    origin = F.regexp_extract(base, _ORIGIN, 1)
    folder = F.regexp_extract(base, "^(.*/)", 1)
    folder = F.when(folder != "", folder).otherwise(base)
    out = (
        F.when(is_ignored(url), base)
        .when(is_absolute(url, tlds, mode), url)
        .when(is_protocol_relative(url), F.when(scheme != "", F.concat(scheme, url)))
        .when(is_root_relative(url), F.when(origin != "", F.concat(origin, url)))
        .otherwise(F.concat(folder, url))
    )
    return normalize_url(out)


def robots_url(c: Column) -> Column:
    return F.when(c.endswith("/"), F.concat(c, F.lit("robots.txt"))).otherwise(F.concat(c, F.lit("/robots.txt")))


def require_base(url: str) -> str:
    if not url:
        raise ValueError("the base URL is empty")
    return url
