"""Links and table rows of web pages, one row each."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from tidewell.session import ship


class _Reader(HTMLParser):
    """Collects anchors as (text, href) and table rows as lists of (tag, text)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.links, self.rows, self.anchor, self.row, self.cell = [], [], None, None, None
        self.feed(html)
        self.close()
        self.end_row()

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.end_link()
            self.anchor = [dict(attrs).get("href"), []]
        elif tag == "tr":
            self.end_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = (tag, [])
            self.row.append(self.cell)

    def handle_endtag(self, tag):
        if tag == "a":
            self.end_link()
        elif tag in ("td", "th"):
            self.cell = None
        elif tag in ("tr", "table"):
            self.end_row()

    def handle_data(self, data):
        if self.anchor is not None:
            self.anchor[1].append(data)
        if self.cell is not None:
            self.cell[1].append(data)

    def end_link(self):
        if self.anchor is not None and self.anchor[0] is not None:
            self.links.append(("".join(self.anchor[1]).strip(), self.anchor[0]))
        self.anchor = None

    def end_row(self):
        if self.row:
            self.rows.append([(t, " ".join("".join(x).split())) for t, x in self.row])
        self.row = self.cell = None


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, n, text, href of each anchor with an address, in page order from 0."""
    ship(pages.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(k, i, t, h) for k, x in zip(b["k"], b["h"]) if x for i, (t, h) in enumerate(_Reader(x).links)]
            yield pd.DataFrame(rows, columns=["key", "n", "text", "href"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.selectExpr(f"{key} as k", f"{html} as h").mapInPandas(run, f"key {kind}, n int, text string, href string").withColumnRenamed("key", key)


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html", sep: str = "|") -> DataFrame:
    """key, n, tag, line of each table row: its th cells joined, else its td cells; separators in cells are dropped."""
    ship(pages.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for k, x in zip(b["k"], b["h"]):
                for i, cells in enumerate(_Reader(x).rows if x else []):
                    tag = "th" if any(t == "th" for t, _ in cells) else "td"
                    out.append((k, i, tag, sep.join(v.replace(sep, "") for t, v in cells if t == tag)))
            yield pd.DataFrame(out, columns=["key", "n", "tag", "line"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.selectExpr(f"{key} as k", f"{html} as h").mapInPandas(run, f"key {kind}, n int, tag string, line string").withColumnRenamed("key", key)
