"""Price history rebuilt from dated snapshots of the whole offer table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from offermill.operators.history import MAX_GAP_DAYS


def revision_offers(revisions: DataFrame, revision: str, at: str, body: str, offer: StructType, field: str = "offers", write: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """The offers of JSON snapshots with their revision, time and place in it, and (revision, time, readable, offers) of each snapshot.

    A snapshot that is no JSON document with that field is not readable and
    has no offers; its revision stays in the log. Where both results are used, or one more than
    once, `write` keeps the parsed snapshots, so that these are made and parsed once.
    """
    schema = StructType().add(field, ArrayType(offer)).add("_broken", "string")
    parsed = revisions.select(F.col(revision).alias("revision"), F.col(at).alias("at"), F.from_json(F.coalesce(body, F.lit("")), schema, {"columnNameOfCorruptRecord": "_broken"}).alias("doc"))
    readable = F.col("doc").isNotNull() & F.col("doc._broken").isNull() & F.col(f"doc.{field}").isNotNull()
    parsed = write(parsed.select("revision", "at", F.coalesce(readable, F.lit(False)).alias("readable"), F.col(f"doc.{field}").alias("o")))
    log = parsed.select("revision", "at", "readable", F.coalesce(F.size("o"), F.lit(0)).alias("offers"))
    rows = parsed.where("readable").select("revision", "at", F.posexplode("o").alias("place", "offer"))
    return rows.where("offer is not null").select("revision", "at", "place", "offer.*"), log


def judged(rows: DataFrame, series: list[str], values: list[str], reason: Column, allowed: Column, dated: list[str], order: list[str], at: str = "at", gap_days: float = MAX_GAP_DAYS) -> DataFrame:
    """Rows with fate: what a pass over all of them in order does with each.

    `rejected` where there is a reason; `merged` where the row before of its
    series has the same values and is no further away than the gap, or one of
    the `dated` values is there; else it begins an event, `inserted` if its
    place is allowed and `archived` if not. Events also get their number `run`.
    """
    own = Window.partitionBy("_taken", *series).orderBy(at, *order)
    rows = rows.withColumn("_taken", reason.isNull())
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(own))
    days = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(own).cast("timestamp"))) / 86_400_000_000
    lasting = F.lit(False)
    for d in dated:
        lasting = lasting | F.col(d).isNotNull()
    begins = F.row_number().over(own).eqNullSafe(1) | ~same | ~(lasting | (days <= gap_days))
    fate = F.when(~F.col("_taken"), "rejected").when(~F.col("_begins"), "merged").when(F.coalesce(allowed, F.lit(False)), "inserted").otherwise("archived")
    numbered = rows.withColumn("_begins", begins).withColumn("run", F.sum(F.col("_begins").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("fate", fate).drop("_taken", "_begins")


def events_of(fated: DataFrame, series: list[str], values: list[str], at: str = "at") -> DataFrame:
    """The events that judged rows make: series, values, archived, first_seen, last_seen and observations."""
    taken = fated.where("fate <> 'rejected'")
    return taken.groupBy(*series, *values, "run").agg(F.bool_or(F.col("fate") == "archived").alias("archived"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("observations")).drop("run")


def counted(fated: DataFrame, keys: list[str]) -> DataFrame:
    """raw, inserted, merged, archived and rejected of each key; raw is the sum of the others."""
    n = lambda f: F.count_if(F.col("fate") == f).alias(f)
    return fated.groupBy(*keys).agg(F.count("*").alias("raw"), n("inserted"), n("merged"), n("archived"), n("rejected"))


def changes(rows: DataFrame, log: DataFrame, key: list[str], value: str, write: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """revision, added, gone, changed and same: each readable snapshot against the readable one before.

    A snapshot holds a key once or more; its least value counts. Keys are
    followed through the numbers of the snapshots that have them, so neighbours
    are not joined with each other. What is read more than once is kept by `write`.
    """
    numbered = log.where("readable").groupBy("revision").agg(F.min("at").alias("at"))
    numbered = numbered.select("revision", F.row_number().over(Window.orderBy("at", "revision")).alias("n"))  # one row a revision
    numbered = write(numbered)
    held = rows.groupBy("revision", *key).agg(F.min(value).alias("v")).join(numbered, "revision")
    w = Window.partitionBy(*key).orderBy("n")
    before = F.lag("n").over(w).eqNullSafe(F.col("n") - 1)
    kind = F.when(~before, "added").when(F.lag("v").over(w).eqNullSafe(F.col("v")), "same").otherwise("changed")
    seen = write(held.select("n", kind.alias("kind"), (~F.lead("n").over(w).eqNullSafe(F.col("n") + 1)).alias("ends")))
    counts = seen.groupBy("n").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "changed", "same")))
    gone = seen.where("ends").groupBy((F.col("n") + 1).alias("n")).agg(F.count("*").alias("gone"))
    out = numbered.join(counts, "n", "left").join(gone, "n", "left")  # after the last snapshot nothing is gone
    return out.select("revision", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "gone", "changed", "same")))
