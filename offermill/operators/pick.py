"""One row of each key, and ranked choices. Orders must be total: end them with a column that tells rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Ranks above one are dropped before the shuffle where Spark can."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def later_wins(sources: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """The union of the sources; of rows with equal keys the one of the latest source stays."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_per(out, keys, [F.desc("_source"), *order]).drop("_source")


def best_and_other_store(df: DataFrame, keys: list[str], store: str, order: list[Column]) -> DataFrame:
    """For each key the best row and the best one of a different store: columns best and second (structs).

    One aggregation: the best row of each store first, then the least two of these.
    """
    rows = first_per(df, [*keys, store], order)
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_place", F.row_number().over(w)).where("_place <= 2")
    fields = F.struct(*(c for c in df.columns if c not in keys))
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("_place") == 1, fields)).alias("best"), F.max(F.when(F.col("_place") == 2, fields)).alias("second"))
