"""Text and links of web pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.text import SPACE

#: Elements whose content is no text (fixed values).
SKIPPED = ("script", "style", "nav")
NO_TEXT = "(?is)<!--.*?-->|<!doctype[^>]*>|" + "|".join(rf"<{x}\b.*?</{x}\s*>" for x in SKIPPED)
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED

    def handle_endtag(self, tag):
        self.depth -= tag in SKIPPED and self.depth > 0

    def handle_data(self, data):
        if not self.depth and (piece := data.strip()):
            self.parts.append(piece)


def _text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    """The text pieces outside script, style and nav, trimmed, one to a line, by an HTML parser."""
    return html.map(_text)


def page_text_approx(html: Column) -> Column:
    """The same for well-formed pages, by patterns alone: stays in generated code, decodes five named entities."""
    pieces = F.transform(F.split(F.regexp_replace(html, NO_TEXT, "<x>"), "<[^>]*>"), lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    out = F.array_join(F.filter(pieces, lambda x: x != ""), "\n")
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(to))
    return out


def hrefs(html: Column) -> Column:
    """Targets of the page's anchors, in order."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolved(base: pd.Series, links: pd.Series) -> pd.Series:
    """Links made absolute against the page's address, those to another host left out."""

    def one(url, found):
        if url is None or found is None:
            return None
        host = urlparse(url).netloc
        return [x for x in (urljoin(url, f) for f in found) if urlparse(x).netloc == host]

    return pd.Series([one(u, f) for u, f in zip(base, links, strict=True)])


def netloc(url: Column) -> Column:
    """What stands between ``//`` and the path: host with port and user."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
