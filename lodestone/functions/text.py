"""Text functions as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A token: ASCII word characters, apostrophes and hyphens inside.  It equals
#: a word-boundary pattern whose boundaries know ASCII letters only.
TOKEN = r"[A-Za-z0-9_](?:[A-Za-z0-9_'-]*[A-Za-z0-9_])?"
#: The same without backtracking, in Java's form.
_TOKEN = r"[A-Za-z0-9_]++(?:['-]++[A-Za-z0-9_]++)*+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def tokenize(c: Column) -> Column:
    """Array of tokens; null is taken as empty."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    """How many tokens there are, without normalising them."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(_TOKEN))


def terms(c: Column) -> Column:
    """``normalize_token`` of each of ``tokenize``, made on the text as a whole.

    Normalising deletes apostrophes, hyphens and underscores.  Without the
    first two a token is a run of word characters; only then, when nothing but
    ASCII is left, is it lower-cased, and underscores go last, since a token of
    them alone is an empty term with a place of its own.
    """
    plain = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("")), F.lit("-"), F.lit(""))
    # a first element keeps an empty list apart from a list of one empty term
    runs = F.array_join(F.concat(F.array(F.lit("x")), F.regexp_extract_all(plain, F.lit("[A-Za-z0-9_]++"), F.lit(0))), "\n")
    return F.slice(F.split(F.replace(F.lower(runs), F.lit("_"), F.lit("")), "\n", -1), 2, 1 << 30)


def normalize(c: Column) -> Column:
    """ASCII lower case without ASCII punctuation."""
    return F.regexp_replace(F.translate(c, UPPER, LOWER), _PUNCTUATION, "")


def normalize_token(c: Column) -> Column:
    """``normalize`` for what ``tokenize`` yields, which holds no other punctuation."""
    return F.translate(c, UPPER + "'-_", LOWER)


def normalize_py(word: str) -> str:
    out = word.translate(str.maketrans(UPPER, LOWER))
    return "".join(ch for ch in out if not ("!" <= ch <= "/" or ":" <= ch <= "@" or "[" <= ch <= "`" or "{" <= ch <= "~"))


@lru_cache(maxsize=1)
def _english() -> tuple[str, ...]:
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def stop_words(spark: SparkSession, words: list[str] | None = None) -> list[str]:
    """The given list, else the platform's English one; each apostrophe in both its forms."""
    base = words or _english()
    return sorted({w for x in base for w in (x, x.replace("'", "’"))})


def is_stop_word(c: Column, words: list[str]) -> Column:
    return c.isin(words)


def is_valid_word(c: Column) -> Column:
    """3 to 20 bytes."""
    return F.octet_length(c).between(3, 20)


def clean_snippet(c: Column, mode: str = "compatible") -> Column:
    """Line ends and tabs deleted (``intended``: made spaces), runs of spaces collapsed."""
    flat = F.translate(c, "\n\r\t", "" if mode == "compatible" else "   ")
    return F.regexp_replace(flat, " +", " ")


def clean_snippet_py(text: str, mode: str = "compatible") -> str:
    for ch in "\n\r\t":
        text = text.replace(ch, "" if mode == "compatible" else " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def unquote(text: str) -> str:
    """Without matching outer double quotes, however many."""
    while len(text) >= 2 and text[0] == text[-1] == '"':
        text = text[1:-1]
    return text


def unquoted(c: Column) -> Column:
    """Column form of ``unquote``: as many quotes go from both ends as the shorter run has."""
    left = F.length(F.regexp_extract(c, '^("*)', 1))
    right = F.length(F.regexp_extract(c, '("*)$', 1))
    whole = F.length(c)
    n = F.when(left == whole, F.floor(whole / 2)).otherwise(F.least(left, right)).cast("int")
    return F.substring(c, n + 1, whole - 2 * n)


def split_by_space(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def document_text(title: Column, content: Column) -> Column:
    """Title and content without anything between."""
    return F.concat(F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))


def all_text(*parts: Column) -> Column:
    """The parts, each followed by a space."""
    return F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit(" ")) for p in parts])


def quoted_strings(c: Column) -> Column:
    """Contents of all double-quoted strings, as in a JSON list of URLs."""
    return F.regexp_extract_all(c, F.lit('"(.*?)"'), F.lit(1))
