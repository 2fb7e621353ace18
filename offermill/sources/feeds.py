"""Landed answers of shops: pages of products, price windows, cards, lines and word boxes; and what is written back."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def market_parts(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """The rows of all part files of a pattern, each a JSON array; columns that a part lacks are null, unknown ones are left out."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern)


def manifest_catalog(spark: SparkSession, folder: str, product: StructType) -> DataFrame:
    """Products of the catalog files that folder/index.json names, with retailer and file; files that it does not name don't count."""
    index = spark.read.schema("files array<string>").option("multiLine", True).json(f"{folder}/index.json").select(F.explode("files").alias("file"))
    schema = StructType().add("retailer", "string").add("products", ArrayType(product))
    read = spark.read.schema(schema).option("multiLine", True).option("ignoreCorruptFiles", True).json(f"{folder}/*.json").withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return read.join(index.distinct(), "file", "left_semi").select("file", "retailer", F.explode("products").alias("p")).select("file", "retailer", "p.*")


def captured(responses: DataFrame, page: str, order: str, most_bytes: int = 2_500_000, most: int = 120) -> DataFrame:
    """JSON answers (url, content_type, body) of a page that may hold products: not too large, and the first so many of each page in order."""
    json_like = F.col("content_type").rlike("(?i)json") | F.col("url").rlike(r"(?i)\.json(\?|$)")
    rows = responses.where(json_like & (F.octet_length("body") <= most_bytes))
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(page).orderBy(order))).where(F.col("_place") <= most).drop("_place")


def paged(pages: DataFrame, key: str, page: str, products: str, total: Column, size: int, most: int) -> DataFrame:
    """Products of landed pages (an array each): those that the first page's total asks for, at most so many pages; a page landed twice counts once."""
    asked = pages.where(F.col(page) == 1).groupBy(key).agg(F.least(F.ceil(F.max(total) / size), F.lit(most)).alias("_asked"))
    rows = pages.join(asked, key).where(F.col(page).between(1, F.col("_asked")))
    once = rows.groupBy(key, page).agg(F.min(products).alias("p"))
    return once.select(key, page, F.posexplode("p").alias("place", "product"))


def until_empty(pages: DataFrame, key: str, page: str, n: str, streak: int = 3, most: int = 250) -> DataFrame:
    """Pages in order up to the end of the first run of `streak` empty ones, at most so many."""
    w = Window.partitionBy(key).orderBy(page)
    empty = (F.coalesce(F.col(n), F.lit(0)) == 0).cast("int")
    rows = pages.where(F.col(page) <= most).withColumn("_run", F.sum(empty).over(w.rowsBetween(1 - streak, 0)))
    before = F.coalesce(F.max((F.col("_run") >= streak).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_over", before).where("_over = 0").drop("_run", "_over")


def price_windows(prices: DataFrame, price: str, low: float, high: float, most: int = 1000, width: float = 0.05, depth: int = 8) -> DataFrame:
    """(low, high, n) of the halves of a price range, halved again while more than `most` products lie within.

    A window that is `width` wide, or was halved `depth` times, stays as it
    is. Only prices by the cent are counted, so what a round looks at is small
    however many products there are.
    """
    cents = lambda c: F.round(c * 100).cast("long")
    rows = prices.groupBy(cents(F.col(price)).alias("p")).agg(F.count("*").alias("n"))
    rows = rows.withColumns({"low": cents(F.lit(low)), "high": cents(F.lit(high))}).where(F.col("p").between(F.col("low"), F.col("high")))
    for _ in range(depth):
        own = Window.partitionBy("low", "high")
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        split = (F.sum("n").over(own) > most) & (F.col("high") - F.col("low") > round(width * 100))
        rows = rows.select("p", "n", F.when(split & (F.col("p") > middle), middle + 1).otherwise(F.col("low")).alias("_low"), F.when(split & (F.col("p") <= middle), middle).otherwise(F.col("high")).alias("high")).withColumnRenamed("_low", "low")
    return rows.groupBy((F.col("low") / 100).alias("low"), (F.col("high") / 100).alias("high")).agg(F.sum("n").alias("n"))


class _Cards(HTMLParser):
    def __init__(self, marker: str):
        super().__init__(convert_charrefs=True)
        self.marker, self.cards, self.depth, self.now, self.heading, self.name = marker, [], 0, [], False, []

    def handle_starttag(self, tag, attrs):
        if tag in ("img", "br", "input", "meta", "link", "hr", "source"):
            return
        if self.depth:
            self.depth += 1
        elif self.marker in (dict(attrs).get("class") or "").split():
            self.depth, self.now, self.name = 1, [], []
        self.heading = self.depth > 0 and (self.heading or tag in ("h1", "h2", "h3", "h4"))

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3", "h4"):
            self.heading = False
        if self.depth and tag not in ("img", "br", "input", "meta", "link", "hr", "source"):
            self.depth -= 1
            if not self.depth:
                self.cards.append((" ".join("".join(self.name).split()), " ".join("".join(self.now).split())))

    def handle_data(self, data):
        if self.depth:
            self.now.append(data + " ")
            if self.heading:
                self.name.append(data + " ")


def cards(pages: DataFrame, id_col: str, html_col: str, marker: str) -> DataFrame:
    """id, place, name and text of all elements of a class in each page; the name is that of its headings, or empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, html in zip(b["id"], b["html"]):
                p = _Cards(marker)
                p.feed(html or "")
                rows += [(i, k, n, t) for k, (n, t) in enumerate(p.cards)]
            yield pd.DataFrame(rows, columns=["id", "place", "name", "text"])

    out = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInPandas(run, "id long, place int, name string, text string")
    return out.withColumnRenamed("id", id_col)


def priced_lines(docs: DataFrame, id_col: str, text_col: str, back: int = 10) -> DataFrame:
    """Lines of texts with a price, each with the nearest line before it, at most so many back, that looks like a name."""
    rows = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("place", "line"))
    price = F.regexp_extract("line", r"(?<![\d,.])(\d{1,3}[.,]\d{2})(?![\d.,])\s*€?", 1)
    named = F.length(F.trim("line")).between(3, 140) & F.col("line").rlike(r"\p{L}{3}") & (price == "")
    w = Window.partitionBy(id_col).orderBy("place").rowsBetween(-back, -1)
    rows = rows.withColumn("name", F.last(F.when(named, F.trim("line")), ignorenulls=True).over(w)).withColumn("price", F.replace(F.nullif(price, F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(12,2)"))
    return rows.where("price is not null and name is not null").select(id_col, "place", "name", "price")


def word_boxes(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words of landed page layouts (XML of pages, blocks, lines and words with their boxes): page, block, line, place and the box."""
    word = r'<word xMin="([\d.]+)" yMin="([\d.]+)" xMax="([\d.]+)" yMax="([\d.]+)">([^<]*)</word>'
    level = lambda df, tag, name: df.select(*(c for c in df.columns if c != "x"), F.posexplode(F.slice(F.split("x", rf"<{tag}\b"), F.lit(2), F.greatest(F.size(F.split("x", rf"<{tag}\b")) - 1, F.lit(0)))).alias(name, "x"))
    rows = files.select(id_col, F.col(text_col).alias("x"))
    for tag, name in (("page", "page"), ("block", "block"), ("line", "line")):
        rows = level(rows, tag, name)
    parts = [F.regexp_extract_all("x", F.lit(word), i) for i in range(1, 6)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("x1", "y1", "x2", "y2", "word"))))
    out = rows.select(id_col, "page", "block", "line", F.posexplode(zipped).alias("place", "w"))
    unescaped = F.replace(F.replace(F.replace("w.word", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return out.select(id_col, "page", "block", "line", "place", *(F.col(f"w.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), unescaped.alias("word"))


def better_slice(current: DataFrame, fresh: DataFrame, store: str, least: int = 20) -> DataFrame:
    """The table with the slices of stores that `fresh` has enough rows of, or more than there were, in place of the old ones."""
    new = fresh.groupBy(store).agg(F.count("*").alias("_new"))
    old = current.groupBy(store).agg(F.count("*").alias("_old"))
    taken = new.join(old, store, "left").where((F.col("_new") >= least) | (F.col("_new") > F.coalesce("_old", F.lit(0)))).select(store)
    return current.join(taken, store, "left_anti").unionByName(fresh.join(taken, store, "left_semi"), allowMissingColumns=True)


def write_catalogs(products: DataFrame, folder: str, retailer: str) -> None:
    """Products by retailer below `folder`, and a manifest (retailer, file, n): a retailer that is written again replaces its own."""
    products.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(retailer).parquet(f"{folder}/products")
    spark = products.sparkSession
    spark.read.parquet(f"{folder}/products").groupBy(retailer).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{folder}/index")  # one row a retailer


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as lines of JSON in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def widest_json(text: str | None, fields: tuple[str, ...], depth: int = 15, most: int = 8000) -> Iterator[dict]:
    """All nodes of a JSON text that have a name and any of `fields`, as they are; broken JSON has none."""
    try:
        todo = [(json.loads(text or "null"), 0)]
    except ValueError:
        return
    while todo:
        node, at = todo.pop()
        if at <= depth and isinstance(node, list):
            todo += [(x, at + 1) for x in reversed(node[:most])]
        elif at <= depth and isinstance(node, dict):
            if isinstance(node.get("name"), str) and any(node.get(f) is not None for f in fields):
                yield node
            todo += [(x, at + 1) for x in reversed(list(node.values())) if isinstance(x, (dict, list))]


def json_catalog(pages: DataFrame, id_col: str, json_col: str, fields: tuple[str, ...] = ("brand", "gtin", "price", "size", "image")) -> DataFrame:
    """Structured products anywhere in JSON texts: the id, name and each of the fields as written."""
    schema = "id long, name string, " + ", ".join(f"{f} string" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n["name"], *(None if n.get(f) is None else str(n[f]) for f in fields)) for i, t in zip(b["id"], b["json"]) for n in widest_json(t, fields)]
            yield pd.DataFrame(rows, columns=["id", "name", *fields])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("json")).mapInPandas(run, schema).withColumnRenamed("id", id_col)
