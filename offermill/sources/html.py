"""Landed HTML: titles, text blocks and cards with a price, by the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin a block, and whose text is never shown.
BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 section article table tr td th br header footer nav main".split())
HIDDEN = frozenset("script style noscript template".split())


class _Parts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.blocks, self.now, self.hidden, self.in_title = "", [], [], 0, False

    def end_block(self):
        if line := " ".join("".join(self.now).split()):
            self.blocks.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.in_title |= tag == "title"
        if tag in BLOCKS:
            self.end_block()

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.end_block()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.now.append(data)


def parts(html: str | None) -> tuple[str, list[str]]:
    p = _Parts()
    p.feed(html or "")
    p.close()
    p.end_block()
    return " ".join(p.title.split()), p.blocks


def page_parts(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The id, title and visible text blocks of each page; a null page has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parts(h) for h in b["html"]]
            yield pd.DataFrame({"id": b["id"], "title": [t for t, _ in got], "blocks": [x for _, x in got]})

    out = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInPandas(run, "id long, title string, blocks array<string>")
    return out.withColumnRenamed("id", id_col)


def priced_blocks(parsed: DataFrame, id_col: str) -> DataFrame:
    """Blocks that hold a price, once each by their first 500 characters, with the price."""
    rows = parsed.select(id_col, F.explode("blocks").alias("block")).withColumn("price", F.regexp_extract("block", r"(\d{1,4}[.,]\d{2})\s*€", 1)).where("price <> ''")
    return rows.withColumn("head", F.substring("block", 1, 500)).groupBy(id_col, "head").agg(F.min("block").alias("block"), F.min("price").alias("price")).drop("head")
