"""Text and links of HTML pages, by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED = frozenset(("footer", "nav", "script", "style"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.links = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.inside.append(tag)
        href = dict(attrs).get("href")
        if tag == "a" and href and not self.inside:
            self.links.append(href)

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID or tag == "a":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def read(html: str, links: bool = False) -> str:
    """Text nodes joined by line feeds, without navigation, footers, scripts and styles; links listed at the end if wanted."""
    r = _Reader()
    r.feed(html)
    r.close()
    text = "\n".join(r.parts)
    return text + "\n\n--- Links ---\n" + "\n".join(f"Link: {x}" for x in r.links) if links else text


def text(html: Column, links: bool = False) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else read(p, links) for p in pages.to_pylist()], pa.string())

    return run(html)


def hrefs(html: Column) -> Column:
    """All quoted link targets, by an expression."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*"([^"]*)\""""), F.lit(1))


def valid_url(url: Column) -> Column:
    """Whether it's http(s) with a host."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))
