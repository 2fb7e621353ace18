"""Landed files: JSON envelopes, catalogs, Markdown, logs and trees of foreign JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def envelope(spark: SparkSession, path: str, schema: StructType, field: str) -> DataFrame:
    """The rows of an array field of whole-file JSON documents. No matching file gives an empty frame of the rows' schema."""
    rows = next(f.dataType.elementType for f in schema.fields if f.name == field)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        return spark.createDataFrame([], rows)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select(F.explode(field).alias("r")).select("r.*")


def catalog(spark: SparkSession, pattern: str, product: StructType) -> DataFrame:
    """Products of all catalog files of a pattern, with their retailer; unreadable files are passed over."""
    schema = StructType().add("retailer", "string").add("products", ArrayType(product))
    read = spark.read.schema(schema).option("multiLine", True).option("ignoreCorruptFiles", True).json(pattern)
    return read.select("retailer", F.explode("products").alias("p")).select("retailer", "p.*")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All stored snapshots, oldest first by their partition column snapshot_ts: a scan that prunes by it."""
    return spark.read.parquet(folder)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """epoch_ms and text of a log of tab-separated lines; other lines are left out."""
    raw = spark.read.text(path)
    parts = raw.select(F.regexp_extract("value", r"^(\d+)\t(.*)$", 1).try_cast("long").alias("epoch_ms"), F.regexp_extract("value", r"^(\d+)\t(.*)$", 2).alias("text"))
    return parts.where("epoch_ms is not null")


def markdown_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sections below headings of third to fifth level: the id, name and body of each."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n#{3,5}\s+")
    out = docs.select(id_col, F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("position", "section"))  # all but what is before the first heading
    return out.select(id_col, "position", F.trim(F.substring_index("section", "\n", 1)).alias("name"), F.trim(F.regexp_replace("section", r"^[^\n]*\n?", "")).alias("body"))


def markdown_candidates(docs: DataFrame, id_col: str, text_col: str, least: int = 3, most: int = 240) -> DataFrame:
    """Lines and link labels of a text, once each, within bounds of length."""
    both = F.array_distinct(F.transform(F.concat(F.split(text_col, "\n"), F.regexp_extract_all(text_col, F.lit(r"\[([^\]\n]+)\]\("), 1)), F.trim))
    return docs.select(id_col, F.explode(both).alias("line")).where(F.length("line").between(least, most))


def products_in(tree: object, depth: int = 10, most: int = 800) -> Iterator[tuple[str, str]]:
    """(name, price) of all nodes of a JSON tree that have both; arrays count up to `most` elements."""
    todo = [(tree, 0)]
    while todo:
        node, at = todo.pop()
        if at > depth:
            continue
        if isinstance(node, list):
            todo += [(x, at + 1) for x in reversed(node[:most])]
        elif isinstance(node, dict):
            name = next((node[k] for k in ("name", "title", "productName", "displayName") if isinstance(node.get(k), str)), None)
            price = next((node[k] for k in ("currentPrice", "offerPrice", "price") if isinstance(node.get(k), (int, float, str)) and not isinstance(node.get(k), bool)), None)
            if name and price is not None:
                yield name, str(price)
            todo += [(x, at + 1) for x in reversed(list(node.values())) if isinstance(x, (dict, list))]


def json_products(pages: DataFrame, id_col: str, json_col: str, depth: int = 10, most: int = 800) -> DataFrame:
    """Products found anywhere in JSON texts: the id, name and price as written. Broken or null JSON has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["json"]):
                try:
                    rows += [(i, n, p) for n, p in products_in(json.loads(text or "null"), depth, most)]
                except ValueError:
                    pass
            yield pd.DataFrame(rows, columns=["id", "name", "price"])

    found = pages.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("json")).mapInPandas(run, "id long, name string, price string")
    return found.withColumnRenamed("id", id_col)


def replace_slices(df: DataFrame, path: str, by: str = "store") -> None:
    """Writes the frame's slices in place of those of equal `by`; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
