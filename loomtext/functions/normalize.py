"""Normalisation of texts and wiki markup, as Columns.

The order of the steps defines the result and is kept where one step hides another: category links are
unwrapped before the rule that would remove them, and the rules for orphaned braces reach across lines.
Only Unicode NFKC, for which Spark has no function, runs in an Arrow function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.text import FAST_SPACE, SPACE, bound, count_of, rstrip, strip

#: The first line of what ends an article (lower case, trimmed).
TAIL = r"^(?:notes et .*rences|voir aussi|bibliographie|liens externes|external links|références$|references$)"
#: Patterns of markup. (?d) keeps line ends to \n, as in the texts.
TEMPLATE = r"\{\{[^{}]*\}\}"
OPEN_ORPHAN = r"(?dm)\{\{[^}]*$"
CLOSE_ORPHAN = r"(?dm)^[^{]*\}\}"
TABLE = r"\{\|[^{}]*?\|\}"
LINK = r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]"
HEADING = rf"(?dm)^[ \t]*={{2,}}[{SPACE}]*([^=\n]+?)[{SPACE}]*={{2,}}[{SPACE}]*$"
URL = rf"https?://[^{SPACE}]+"
MEDIA_LINK = r"(?iu)\[\[(?:Catégorie|Category|Fichier|File):[^\]]*\]\]"
TEMPLATE_ROUNDS, TABLE_ROUNDS = 20, 10


#: The same, from the line end before it.  White space in front may reach over blank lines, as what is cut is trimmed at its end.
TAIL_CUT = rf"(?Uiud)\n[{FAST_SPACE}]*(?:notes et .*rences|voir aussi|bibliographie|liens externes|external links|(?:références|references)(?=[{FAST_SPACE}]*(?:\n|\z)))(?s:.*)"


def wiki_tail_cut(text: Column) -> Column:
    """Cut before the first line that opens a tail section; trimmed at the end only if cut."""

    # with a line end in front the first line is as the others, and the search begins with one character
    both = bound(text, lambda t: F.struct(t.alias("t"), F.regexp_replace(F.concat(F.lit("\n"), t), TAIL_CUT, "").alias("r")))
    # one lambda after the other: Spark does not extract nfkc over a condition that gives an outer lambda's variable from an inner one
    return bound(both, lambda x: F.when(F.octet_length(x["r"]) <= F.octet_length(x["t"]), rstrip(F.substr(x["r"], F.lit(2)))).otherwise(x["t"]))


def line_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def newline_repair(text: Column) -> Column:
    """Line ends to \\n; written-out \\n and \\t decoded where they outnumber real line ends and occur twice or more."""

    def repaired(t: Column) -> Column:
        broken = (count_of(t, "\\n") >= 2) & (count_of(t, "\n") < count_of(t, "\\n"))
        return F.when(broken, F.replace(F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit(" "))).otherwise(t)

    return bound(line_ends(F.coalesce(text, F.lit(""))), repaired)


def loaded(text: Column) -> Column:
    return wiki_tail_cut(newline_repair(text))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def _again(text: Column, pattern: str, opened: str, rounds: int) -> Column:
    """``pattern`` taken out so many times; texts without ``opened`` are not searched."""
    once = lambda t: F.when(t.contains(opened), F.regexp_replace(t, pattern, "")).otherwise(t)
    for _ in range(rounds):
        text = bound(text, once)
    return text


def _without_close_orphans(text: Column) -> Column:
    """Every line would be tried to the end of the text; what follows the last }} has no match, so it is not searched."""
    rest = F.substring_index(text, "}}", -1)
    return F.concat(F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - F.length(rest)), CLOSE_ORPHAN, ""), rest)


def without_templates(text: Column, rounds: int = TEMPLATE_ROUNDS) -> Column:
    """Templates go, innermost first; what is nested deeper than ``rounds`` falls to the rules for orphans."""
    return bound(_again(_again(text, TEMPLATE, "{{", rounds), OPEN_ORPHAN, "{{", 1), _without_close_orphans)


def without_tables(text: Column, rounds: int = TABLE_ROUNDS) -> Column:
    return _again(text, TABLE, "{|", rounds)


def unwrapped_links(text: Column) -> Column:
    return F.regexp_replace(text, LINK, "$1")


def plain_headings(text: Column) -> Column:
    return F.regexp_replace(text, HEADING, "\n\n$1\n\n")


def without_tags(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"&nbsp;?|&[a-z]+;|&#[0-9]+;", " ")


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def without_media_links(text: Column) -> Column:
    """Category and file links go. Within ``clean`` links are unwrapped before, so their words stay."""
    return F.regexp_replace(text, MEDIA_LINK, "")


def tidy_spaces(text: Column) -> Column:
    for pattern, to in ((" {2,}", " "), ("\n{3,}", "\n\n"), ("[ \t]+\n", "\n"), ("\n[ \t]+", "\n")):
        text = F.regexp_replace(text, pattern, to)
    return text


def clean(text: Column, unicode: bool = True) -> Column:
    """All steps for corpus text; ``unicode=False`` leaves out NFKC."""
    t = loaded(text)
    t = nfkc(t) if unicode else t
    t = without_tables(without_templates(t))
    t = without_urls(without_tags(plain_headings(unwrapped_links(t))))
    return strip(wiki_tail_cut(tidy_spaces(without_media_links(t))))


#: The patterns of the shorter cleaning, in order, and what takes their place.
WIKITEXT = (
    (r"\{\{[^}]*\}\}", ""),
    (r"\{\|[^}]*\|\}", ""),
    (r"(?iu)\[\[(?:Catégorie|Category|Fichier|File|Image):[^\]]*\]\]", ""),
    (r"\[\[([^\]|]*)\|([^\]]*)\]\]", "$2"),
    (r"\[\[([^\]]*)\]\]", "$1"),
    (r"'''?([^']*?)'''?", "$1"),
    (rf"==+[{SPACE}]*([^=]+?)[{SPACE}]*==+", "$1"),
    (r"<[^>]+>", ""),
    (r"&[a-z]+;", " "),
    (r"\{\{[^}]*$", ""),
    (r"^[^{]*\}\}", ""),
    (r"\n{3,}", "\n\n"),
    (r" +", " "),
)


def clean_wikitext(text: Column) -> Column:
    """The shorter cleaning of dump pages: one round for templates, media links before other links, quotes off."""
    for pattern, to in WIKITEXT:
        text = F.regexp_replace(text, pattern, to)
    return strip(text)
