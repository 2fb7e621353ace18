"""What a run of imports says about itself: the status of sources, of the run and of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that a file may be older than the run's begin, or newer than now.
SLACK = 5


def is_current(stamped: Column, begun: Column, now: Column) -> Column:
    """Whether data is of this run: stamped between its begin and now, give or take SLACK seconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.coalesce(micros(stamped).between(micros(begun) - SLACK * 1_000_000, micros(now) + SLACK * 1_000_000), F.lit(False))


def source_status(sources: DataFrame, results: DataFrame, starts: DataFrame, on: list[str]) -> DataFrame:
    """Each source with its result's status and count; without one it was an error if it was started, else it was skipped."""
    r = results.select(*on, F.col("status").alias("_status"), F.col("count").alias("_count"))
    joined = sources.join(r, on, "left").join(starts.select(*on, F.col("started")), on, "left")
    status = F.coalesce("_status", F.when(F.col("started").isNotNull(), "error").otherwise("skipped"))
    return joined.select(*sources.columns, status.alias("status"), F.coalesce("_count", F.lit(0)).cast("long").alias("count"), "started")


def run_summary(statuses: DataFrame, failed: Column, *counts: str) -> DataFrame:
    """One row: how many sources have each status, errors of any kind, and how the run ended."""
    names = counts or ("ok", "no_data", "login_required", "credentials_missing", "auth_error", "error", "skipped")
    n = statuses.agg(F.count("*").alias("sources"), *(F.count_if(F.col("status") == s).alias(s) for s in names))
    errors = sum((F.col(s) for s in names if s in ("error", "auth_error")), F.lit(0))
    return n.withColumn("errors", errors.cast("long")).withColumn("run", F.when(failed | (F.col("errors") > 0), "failed").otherwise("completed"))


def overall(retailers: DataFrame, failed_imports: Column) -> DataFrame:
    """One row of retailers (status): recovery is required where any is stale or imports failed; partial then, or where any has no data."""
    n = retailers.agg(F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "no_data").alias("red"), F.count_if(F.col("status") == "fresh").alias("fresh"))
    rows = n.withColumn("recovery_required", (F.col("stale") > 0) | failed_imports)
    return rows.withColumn("run_status", F.when(F.col("recovery_required") | (F.col("red") > 0), "partial").otherwise("completed"))


def settled_status(sources: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """Sources (status) after the checks: ok where rows are left; one that was ok and has none left has no data."""
    joined = sources.join(counts.select(*on, F.col("n").alias("_n")), on, "left")
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return joined.select(*on, F.when(n > 0, "ok").when(F.col("status") == "ok", "no_data").otherwise(F.col("status")).alias("status"), n.alias("count"))
