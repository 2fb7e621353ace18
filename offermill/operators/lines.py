"""Rows in a line order: carried values, context, pairs of start and end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last known value up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def context(df: DataFrame, keys: list[str], order: list[str], text: Column, before: int, after: int, name: str) -> DataFrame:
    """The texts of the rows around each row, in order, one line each."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn(name, F.array_join(F.collect_list(text).over(w), "\n"))


def looked_back(df: DataFrame, keys: list[str], order: list[str], valid: Column, value: Column, back: int, name: str) -> DataFrame:
    """The value of the nearest valid row at most `back` rows before, the row itself included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, 0)
    return df.withColumn(name, F.last(F.when(valid, value), ignorenulls=True).over(w))


def paired(df: DataFrame, keys: list[str], order: list[str], start: Column, end: Column, at: str) -> DataFrame:
    """Each start row with the next end row before the next start of its key: started, ended (null if there is none)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.where(start | end).withColumn("_ends", F.lead(end).over(w)).withColumn("_at", F.lead(at).over(w))
    return marked.where(start).select(*keys, F.col(at).alias("started"), F.when(F.col("_ends"), F.col("_at")).alias("ended"))


def adjacent_prices(words: DataFrame, line: list[str], order: str, word: str, least: float = 1.04, most: float = 1.22) -> DataFrame:
    """line, place, net and gross (cents): a word "1,23*" and a price in brackets of the next one to three words, joined.

    The first such bracket counts, and only if it is above the net price by a
    share that taxes have.
    """
    w = Window.partitionBy(*line).orderBy(order)
    nxt = [F.coalesce(F.lead(word, i).over(w), F.lit("")) for i in (1, 2, 3)]
    cents = lambda c, p: (F.replace(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit(","), F.lit("")).cast("long"))
    rows = words.select(*line, F.col(order).alias("place"), cents(F.col(word), r"^(\d{1,3},\d{2})\*$").alias("net"), *(F.concat(*nxt[:i]).alias(f"_g{i}") for i in (1, 2, 3))).where("net is not null")
    gross = F.coalesce(*(cents(F.col(f"_g{i}"), r"^\((\d{1,3},\d{2})\)$") for i in (1, 2, 3)))
    return rows.select(*line, "place", "net", gross.alias("gross")).where((F.col("gross") > F.col("net")) & (F.col("gross") / F.col("net")).between(least, most))
