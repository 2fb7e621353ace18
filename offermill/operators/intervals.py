"""Ranges of days: which one holds a day, or was the last before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days in a bucket by which ranges and days meet.
BUCKET = 8


def in_range(day: Column, begin: Column, end: Column) -> Column:
    """Whether a day lies in a range, both ends included; an open end (null) holds all days."""
    return (begin.isNull() | (day >= begin)) & (end.isNull() | (day <= end))


def range_of(rows: DataFrame, day: str, ranges: DataFrame, scope: list[str], id_col: str, begin: str, end: str) -> DataFrame:
    """rows with range_id, range_begin, range_end and `current`: of each row's day the range of its scope that holds it, else the last that ended before.

    Of several the one that begins last, then ends last, then of the greatest
    id counts. Ranges without a begin or end are left out. Only the distinct days of
    a scope meet ranges, by buckets of days; a range is in as many buckets as it is long.
    """
    r = ranges.where(F.col(begin) <= F.col(end)).select(*scope, F.struct(F.to_date(begin).alias("range_begin"), F.to_date(end).alias("range_end"), F.col(id_col).alias("range_id")).alias("r"))
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / BUCKET)
    days = rows.select(*scope, F.to_date(day).alias("d")).where("d is not null").distinct()
    spread = r.select(*scope, "r", F.explode(F.sequence(number(F.col("r.range_begin")), number(F.col("r.range_end")))).alias("b"))
    met = days.withColumn("b", number(F.col("d"))).join(spread, [*scope, "b"]).where(in_range(F.col("d"), F.col("r.range_begin"), F.col("r.range_end")))
    holding = met.groupBy(*scope, "d").agg(F.max("r").alias("held"))

    # the last that ended before: days and ends in one order
    last_end = F.max(F.struct(F.col("r.range_end"), F.col("r"))).alias("e")
    ends = r.groupBy(*scope, F.col("r.range_end").alias("d")).agg(last_end).select(*scope, "d", F.lit(1).alias("late"), F.col("e.r").alias("r"))
    line = days.select(*scope, "d", F.lit(0).alias("late"), F.lit(None).cast(r.schema["r"].dataType).alias("r")).unionByName(ends)
    before = line.withColumn("before", F.last("r", ignorenulls=True).over(Window.partitionBy(*scope).orderBy("d", "late"))).where("late = 0").select(*scope, "d", "before")

    known = before.join(holding, [*scope, "d"], "left").withColumn("x", F.coalesce("held", "before")).withColumn("current", F.col("held").isNotNull())
    known = known.toDF(*(f"{c}__" if c in (*scope, "d") else c for c in known.columns))
    on = [F.col(s).eqNullSafe(F.col(f"{s}__")) for s in scope] + [F.to_date(day) == F.col("d__")]
    return rows.join(known, on, "left").select(*rows.columns, "x.range_id", "x.range_begin", "x.range_end", F.coalesce("current", F.lit(False)).alias("current"))


def labelled(rows: DataFrame, label_begin: str, label_end: str) -> DataFrame:
    """rows of range_of with `accepted`: whether the range that they were labelled with is just the one found, which holds the day."""
    same = F.to_date(label_begin).eqNullSafe(F.col("range_begin")) & F.to_date(label_end).eqNullSafe(F.col("range_end"))
    return rows.withColumn("accepted", F.col("current") & same)
