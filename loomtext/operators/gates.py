"""Filters with a reason: predicates, the first gate a document fails, and counts by gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.config import Quality
from loomtext.functions.text import alpha_or_space_share, strip, unique_share, word_count


def quality_rules(text: Column, q: Quality = Quality()) -> dict[str, Column]:
    """Each rule that a good text meets, in order."""
    lines = F.split(text, "\n")
    # the lengths of the lines are the text's without its line ends
    mean = (F.length(text) - F.size(lines) + 1) / F.size(lines)
    return {
        "chars": F.length(text) >= q.min_chars,
        "words": word_count(text) >= q.min_words,
        "unique": unique_share(text) >= q.min_unique,
        "alpha": alpha_or_space_share(text) >= q.min_alpha,
        "lines": ~((mean < q.min_line) & (F.size(lines) > q.max_short_lines)),
    }


def good(text: Column, q: Quality = Quality()) -> Column:
    return reduce(lambda a, b: a & b, quality_rules(F.coalesce(text, F.lit("")), q).values())


def first_failure(rules: dict[str, Column], passed: str = "kept") -> Column:
    """The name of the first rule that does not hold (a null counts as not), or ``passed``."""
    out = F.lit(passed)
    for name, rule in reversed(rules.items()):
        out = F.when(F.coalesce(rule, F.lit(False)), out).otherwise(F.lit(name))
    return out


def audit(gated: DataFrame, gate: str = "gate") -> DataFrame:
    """Documents by gate."""
    return gated.groupBy(gate).agg(F.count("*").alias("n_docs"))


def web_gate(text: Column, min_chars: int = 200, min_words: int = 30, min_unique: float = 0.3) -> Column:
    return (F.length(text) >= min_chars) & (word_count(text) >= min_words) & (unique_share(text) >= min_unique)


def language_gate(lang: Column, allowed: tuple[str, ...] = ("fr", "en")) -> Column:
    """No language, or an allowed one in any case."""
    return F.coalesce(F.lower(lang), F.lit("")).isin("", *allowed)


def title_gate(title: Column, prefixes: tuple[str, ...]) -> Column:
    return ~reduce(lambda a, b: a | b, (title.startswith(p) for p in prefixes))


def no_redirect(text: Column) -> Column:
    """Redirects are told by their mark anywhere in the text, in any case."""
    return ~F.upper(text).contains("#REDIRECT")


def required(*fields: Column) -> Column:
    """All fields have more than white space."""
    return reduce(lambda a, b: a & b, (strip(F.coalesce(f, F.lit(""))) != "" for f in fields))


def arithmetic_only(expression: Column) -> Column:
    return expression.rlike(r"^[0-9+\-*/.()% ]*$")


def length_between(text: Column, more_than: int, less_than: int) -> Column:
    n = F.length(text)
    return (n > more_than) & (n < less_than)
