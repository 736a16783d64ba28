"""Link extraction from ``name:html`` lines, the one operator that needs Python."""

from __future__ import annotations

import re
import xml.sax
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: relative paths that end in .html and hold no tilde.
LINK = r"^\..*/([^~]+)\.html$"
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


class _BodyLinks(xml.sax.ContentHandler):
    """Collects anchors below a ``div`` whose id is bodyContent; depth 0 is outside of one."""

    def __init__(self) -> None:
        super().__init__()
        self.depth = 0
        self.names: list[str] = []

    def startElement(self, name, attrs):  # noqa: N802
        if self.depth == 0:
            ids = {k: v for k, v in attrs.items() if k == "id"}
            self.depth = int(name.lower() == "div" and ids.get("id", "").lower() == "bodycontent")
            return
        self.depth += 1
        href = attrs.get("href") if name.lower() == "a" else None
        if href is not None:
            target = re.search(LINK, href if _BAD_ESCAPE.search(href) else unquote_plus(href))
            if target:
                self.names.append(target[1])

    def endElement(self, name):  # noqa: N802
        self.depth = max(0, self.depth - 1)


def page_links(html: str | None) -> list[str] | None:
    """The link names in order, duplicates kept; None where the page is no well-formed XML."""
    if html is None:
        return None
    handler = _BodyLinks()
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setFeature(xml.sax.handler.feature_external_pes, False)
    parser.setContentHandler(handler)
    try:
        parser.feed(html.replace("&", "&amp;"))
        parser.close()
    except xml.sax.SAXException:
        return None
    return handler.names


def _links(pages: pd.Series) -> pd.Series:
    return pages.map(page_links)


def extract_links(lines: DataFrame, line: str = "value") -> DataFrame:
    """(page, links) of the lines ``name:html``.

    Lines without a colon, names that are empty or hold a tilde, and pages that
    are not well-formed are dropped.
    """
    parts = F.split(F.col(line), ":", 2)
    pages = lines.select(parts[0].alias("page"), F.get(parts, F.lit(1)).alias("html")).filter("page <> '' and not contains(page, '~') and html is not null")
    return pages.select("page", F.pandas_udf(_links, "array<string>")("html").alias("links")).filter("links is not null")
