"""Columns over text: white space, words, ratios, word windows.

Java's classes are ASCII unless told otherwise, and other engines differ again, so white space is spelled out: the characters
that Python's ``str.split`` and ``str.strip`` take for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as a class without its brackets; valid for Java and RE2.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = f"[^{SPACE}]+"
#: The same characters for Java alone, whose own class is three times as fast as the ranges; with the flag (?U).
FAST_SPACE = r"\s\x1C-\x1F"
LETTER = r"\p{L}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^[{FAST_SPACE}]+|[{FAST_SPACE}]+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)[{FAST_SPACE}]+$", "")


def words(text: Column) -> Column:
    """The words of a text; none for the empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?U)[^{FAST_SPACE}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U)[^{FAST_SPACE}]+"))


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def share_of(text: Column, kept: str) -> Column:
    """The share of characters that the class ``kept`` (without brackets) has; 0 for the empty text."""
    return F.length(F.regexp_replace(text, f"(?U)[^{kept}]", "")) / F.greatest(F.length(text), F.lit(1))


def alpha_share(text: Column) -> Column:
    return share_of(text, LETTER)


def alpha_or_space_share(text: Column) -> Column:
    return share_of(text, LETTER + FAST_SPACE)


def unique_share(text: Column) -> Column:
    return bound(words(text), lambda w: F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(w: Column, n: int = 3) -> Column:
    """The windows of ``n`` words, joined by a space; none if there are fewer words."""

    def windows(w: Column) -> Column:
        last = F.size(w) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return bound(w, windows)


def cut(text: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def peek(text: Column, head: int = 120, tail: int = 80) -> Column:
    """A text on one line, the middle left out if it is long."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" | "))
    return F.when(F.length(t) <= head + tail, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(" [...] "), F.right(t, F.lit(tail))))
