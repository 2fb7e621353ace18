"""Landed HTML as a table of nodes, and joins on it: selectors, texts below a node, and the first ancestor that holds something."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermill.functions.money import locale_number

#: Elements without content, and elements that end an open one of the same group.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HIDDEN = frozenset("script style noscript template".split())
PRICE = r"(?<![\d.,])(\d{1,4}[.,]\d{2})(?!\d)\s*€"
SIZE = r"(?iu)(?<![0-9a-z])(\d+(?:[.,]\d+)?\s*(?:kg|g|l|ml|stück|stk))(?![0-9a-zäöüß])"

NODES = "id long, node int, parent int, path array<int>, tag string, classes array<string>, attrs map<string,string>, text string"


class _Tree(HTMLParser):
    """Nodes in document order; text is a node of its own, without a tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[tuple[int, str]] = []

    def _node(self, tag: str | None, attrs: dict, text: str | None) -> int:
        n, path = len(self.rows), [i for i, _ in self.open]
        self.rows.append((n, path[-1] if path else None, path, tag, (attrs.get("class") or "").split(), attrs, text))
        return n

    def handle_starttag(self, tag, attrs):
        if self.open and self.open[-1][1] in CLOSES.get(tag, ()):
            self.open.pop()
        n = self._node(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append((n, tag))

    def handle_startendtag(self, tag, attrs):
        self._node(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag):
        if any(t == tag for _, t in self.open):
            while self.open.pop()[1] != tag:
                pass

    def handle_data(self, data):
        if (line := " ".join(data.split())) and not any(t in HIDDEN for _, t in self.open):
            self._node(None, {}, line)


def nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, node (its place in the document), parent, path (all ancestors, outermost first), tag, classes, attrs and text of each node.

    Texts are nodes without a tag, with single spaces; hidden ones (scripts,
    styles) are left out. A null page has no nodes. What is not closed ends
    with what it is in; list items, paragraphs, rows and cells end those before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, html in zip(b["id"], b["html"]):
                tree = _Tree()
                tree.feed(html or "")
                tree.close()
                yield pd.DataFrame([(i, *r) for r in tree.rows], columns=[c.split()[0] for c in NODES.split(", ")]).astype({"parent": "Int32"})

    out = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInPandas(run, NODES)
    return out


def _matches(step: str) -> Column:
    """`tag.class.class[attribute]`, each part or the tag left out."""
    rest, _, attribute = step.partition("[")
    tag, *classes = rest.split(".")
    out = F.col("tag").isNotNull()
    if tag not in ("", "*"):
        out = out & (F.col("tag") == tag)
    for c in classes:
        out = out & F.array_contains("classes", c)
    return out & F.map_contains_key("attrs", attribute.rstrip("]")) if attribute else out


def selected(table: DataFrame, selector: str) -> DataFrame:
    """The nodes of a selector of descendants: steps with spaces between, as in `ul.nav li a[href]`.

    Each step is an equi-join of a node's ancestors with the nodes of the step before.
    """
    first, *steps = selector.split()
    found = table.where(_matches(first))
    for s in steps:
        above = found.select("id", F.col("node").alias("above"))
        mine = table.where(_matches(s))
        inside = mine.select("id", "node", F.explode("path").alias("above")).join(above, ["id", "above"], "left_semi").select("id", "node").distinct()
        found = mine.join(inside, ["id", "node"], "left_semi")
    return found


def texts_below(table: DataFrame, which: DataFrame) -> DataFrame:
    """id, node and text of the given nodes: all texts in them, in order, with a space between."""
    words = table.where("text is not null").select("id", F.col("node").alias("at"), "text", F.explode("path").alias("node"))
    mine = words.join(which.select("id", "node").distinct(), ["id", "node"], "left_semi")
    said = mine.groupBy("id", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), " ").alias("text"))
    return which.select("id", "node").distinct().join(said, ["id", "node"], "left").select("id", "node", F.coalesce("text", F.lit("")).alias("text"))


def nearest_holding(table: DataFrame, anchors: DataFrame, holds: Column) -> DataFrame:
    """id, node and holder: of each anchor the innermost of itself and its ancestors that holds a text of the condition; null if none does."""
    holders = table.where("text is not null").where(holds).select("id", F.explode("path").alias("holder")).distinct()
    up = anchors.select("id", "node", F.explode(F.concat("path", F.array("node"))).alias("holder")).join(holders, ["id", "holder"])
    return anchors.select("id", "node").join(up.groupBy("id", "node").agg(F.max("holder").alias("holder")), ["id", "node"], "left")


def tiles(table: DataFrame, anchor: str, key: str) -> DataFrame:
    """id, key, name, price, regular and size of product tiles: anchors with an attribute `key`, each with the first ancestor that holds a price.

    The name is the anchor's text, the price the first one in the tile, the
    regular price the greatest of the others that is above it, the size the
    first amount. Of anchors of the same key in a page the last one with a price counts.
    """
    anchors = selected(table, anchor).where(F.map_contains_key("attrs", key))
    at = nearest_holding(table, anchors, F.col("text").rlike(PRICE)).where("holder is not null")
    names = texts_below(table, anchors).withColumnRenamed("text", "name")
    inside = texts_below(table, at.select("id", F.col("holder").alias("node"))).select("id", F.col("node").alias("holder"), "text")
    rows = anchors.select("id", "node", F.col("attrs")[key].alias("key")).join(at, ["id", "node"]).join(names, ["id", "node"]).join(inside, ["id", "holder"])
    prices = F.transform(F.regexp_extract_all("text", F.lit(PRICE), 1), locale_number)
    rows = rows.withColumn("prices", prices).withColumn("price", F.col("prices")[0])
    over = F.array_max(F.filter("prices", lambda p: p > F.col("price")))
    rows = rows.select("id", "key", "node", F.struct("name", "price", over.alias("regular"), F.nullif(F.regexp_extract("text", SIZE, 1), F.lit("")).alias("size")).alias("t"))
    return rows.groupBy("id", "key").agg(F.max_by("t", "node").alias("t")).select("id", "key", "t.*")
