"""Price events, last events, backfill and price ratings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP_DAYS = 8


def _micros(c: Column) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros(c.cast("timestamp"))


def price_events(observations: DataFrame, series: list[str], values: list[str], at: str, tie: str, dated: Column | None = None, gap_days: float = MAX_GAP_DAYS) -> DataFrame:
    """Runs of equal values in each series: series, values, first_seen, last_seen and observations.

    In order of time a run ends when a value differs from the row before, or
    after a gap of more than `gap_days` unless the row is `dated` (its values
    hold a validity period). Null values equal each other.
    """
    w = Window.partitionBy(*series).orderBy(at, tie)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    late = _micros(F.col(at)) - _micros(F.lag(at).over(w)) > int(gap_days * 86_400_000_000)
    if dated is not None:
        late = late & ~dated
    begins = F.when(F.lag(at).over(w).isNull() | ~same | late, 1).otherwise(0)
    runs = observations.withColumn("_run", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*series, *values, "_run").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("observations")).drop("_run")


def extended(events: DataFrame, batch: DataFrame, series: list[str], values: list[str], at: str, tie: str, gap_days: float = MAX_GAP_DAYS) -> DataFrame:
    """The event table after a later batch of observations: what price_events gives for all observations together.

    Only the last event of each series can go on, so it is put before the
    batch as two observations; all other events stay as they are.
    """
    w = Window.partitionBy(*series).orderBy(F.desc("last_seen"), F.desc("first_seen"))
    ranked = events.withColumn("_place", F.row_number().over(w))
    last = ranked.where("_place = 1").drop("_place")
    kept = ranked.where("_place > 1").drop("_place")
    old = last.select(*series, *values, F.col("last_seen").alias(at), F.col("first_seen").alias("_first"), F.col("observations").alias("_n"), F.lit(None).cast(batch.schema[tie].dataType).alias(tie))
    new = batch.select(*series, *values, at, F.lit(None).cast(batch.schema[at].dataType).alias("_first"), F.lit(1).cast("long").alias("_n"), tie)
    order = Window.partitionBy(*series).orderBy(at, F.col(tie).asc_nulls_first())
    rows = old.unionByName(new)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(order))
    late = _micros(F.col(at)) - _micros(F.lag(at).over(order)) > int(gap_days * 86_400_000_000)
    begins = F.when(F.lag(at).over(order).isNull() | ~same | late, 1).otherwise(0)
    runs = rows.withColumn("_run", F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grown = runs.groupBy(*series, *values, "_run").agg(F.min(F.coalesce("_first", at)).alias("first_seen"), F.max(at).alias("last_seen"), F.sum("_n").alias("observations")).drop("_run")
    return kept.unionByName(grown)


def last_event(events: DataFrame, series: list[str], at: str, tie: str, columns: list[str]) -> DataFrame:
    """The latest row of each series, by partial aggregation: no sort."""
    top = F.max(F.struct(at, tie, *columns)).alias("t")
    return events.groupBy(*series).agg(top).select(*series, "t.*")


def typical_range(df: DataFrame, keys: list[str], value: Column, least: int = 5, carry: dict[str, Column] | None = None) -> DataFrame:
    """keys, n, n_kept, median, low and high of each key's values without outliers; null values don't count.

    Hinges are the medians of the lower floor(n/2) and the upper values from
    ceil(n/2) on; values beyond 1.5 hinge ranges of them go, unless there are
    fewer than `least` or the range is none. Ranks within one sort give all of
    it: nothing of a key is held in memory, however many rows it has.
    `carry` are expressions over the rows of a key that come along.
    """
    whole, ranked = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last())
    at = lambda place, v="_v": F.max(F.when(F.col("_i") == place, F.col(v)))
    half = F.floor(F.col("n") / 2)
    first = F.col("n") - half  # values before the upper half
    rows = df.withColumn("_v", value)
    rows = rows.select(*keys, "_v", *(c.over(whole).alias(name) for name, c in (carry or {}).items()), F.row_number().over(ranked).alias("_i"), F.count("_v").over(whole).alias("n"))
    low, high = F.floor((half + 1) / 2), F.floor(half / 2) + 1
    rows = rows.withColumns({"_q1": (at(low).over(whole) + at(high).over(whole)) / 2, "_q3": (at(first + low).over(whole) + at(first + high).over(whole)) / 2})
    width = F.col("_q3") - F.col("_q1")
    inside = (F.col("n") < least) | (width <= 0) | F.col("_v").between(F.col("_q1") - 1.5 * width, F.col("_q3") + 1.5 * width)
    rows = rows.withColumn("_k", F.when(F.coalesce(inside, F.lit(False)), F.col("_v")))
    rows = rows.withColumns({"_m": F.count("_k").over(whole), "_f": F.min(F.when(F.col("_k").isNotNull(), F.col("_i"))).over(whole)})
    middle = (at(F.col("_f") + F.floor((F.col("_m") - 1) / 2), "_k") + at(F.col("_f") + F.floor(F.col("_m") / 2), "_k")) / 2
    return rows.groupBy(*keys).agg(*(F.first(name).alias(name) for name in (carry or {})), F.first("n").alias("n"), F.count("_k").alias("n_kept"), middle.alias("median"), F.min("_k").alias("low"), F.max("_k").alias("high"))


def rating(df: DataFrame, keys: list[str], value: Column, current: Column, recent: Column, least: int = 4) -> DataFrame:
    """n, typical, low, high, change_percent and status of the current price of each key.

    Recent values count if there are `least` or more, else all; outliers go;
    fewer than `least` left are insufficient. A price within 0.005 of the
    least is `low` unless all are alike, then hot (-15 % and below), good
    (-5 %), high (over 5 %) or normal against the median.
    """
    whole = Window.partitionBy(*keys)
    good = value > 0
    rows = df.withColumn("_fresh", F.count_if(good & recent).over(whole))
    used = F.when(good & ((F.col("_fresh") < least) | recent), value)
    rows = typical_range(rows, keys, used, carry={"current": current})
    rows = rows.select(*keys, "current", F.col("n_kept").alias("n"), F.col("median").alias("typical"), "low", "high")
    change = (F.col("current") / F.col("typical") - 1) * 100
    status = (
        F.when(F.col("n") < least, "insufficient")
        .when((F.col("high") - F.col("low") > 0.005) & (F.col("current") <= F.col("low") + 0.005), "low")
        .when(change <= -15, "hot")
        .when(change <= -5, "good")
        .when(change > 5, "high")
        .otherwise("normal")
    )
    return rows.select(*keys, "n", "current", "typical", "low", "high", change.alias("change_percent"), status.alias("status"))


def observed(offers: DataFrame, at: Column, least_confidence: float = 0.8) -> DataFrame:
    """Offers as observations of prices, with `reason` for those that history does not take.

    Uncertain ones (confidence below the least, without an article number)
    and such without identity, store, price or base price are not taken. A
    product id that is missing is made of store, name and size. Prices have
    four decimals; a regular price is that of an offer only where it is said.
    """
    from offermill.functions.money import price_metric
    from offermill.functions.text import slug

    rows = offers.withColumn("_base", price_metric(F.col("unit"), F.col("price")))
    made = slug(F.concat_ws("|", F.coalesce("store", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("size", F.lit(""))))
    missing = F.coalesce("product_id", "canonical_id").isNull() | F.col("store").isNull() | ~F.coalesce((F.col("price") > 0) & (F.col("_base") > 0), F.lit(False))
    reason = F.when((F.coalesce("confidence", F.lit(0.0)) < least_confidence) & F.col("gtin").isNull(), "uncertain").when(missing, "invalid")
    money = lambda c: F.round(c, 4)
    return rows.select(
        F.coalesce("product_id", F.nullif(made, F.lit("")), "canonical_id").alias("product_id"), "canonical_id", "gtin", "store", "market", "organic", "unit_label", "is_offer",
        F.coalesce(money(F.col("regular")), F.when(~F.col("is_offer"), money(F.col("price")))).alias("regular_price"), F.when(F.col("is_offer"), money(F.coalesce("offered", "price"))).alias("offer_price"),
        money(F.col("price")).alias("effective_price"), money(F.col("_base")).alias("base_price"), at.alias("observed_at"), reason.alias("reason"),
        F.when(F.col("gtin").isNotNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(least_confidence), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"),
    )


def active_and_archived(events: DataFrame, allowed: Column, id_col: str, at: str) -> DataFrame:
    """Events with archived: those of places that are not allowed (any more). Of equal ids the first stays, by time."""
    w = Window.partitionBy(id_col).orderBy(F.col(at).asc_nulls_first())
    rows = events.withColumn("archived", ~F.coalesce(allowed, F.lit(False))).withColumn("_place", F.row_number().over(w))
    return rows.where(~F.col("archived") | (F.col("_place") == 1)).drop("_place")


def of_offer(offers: DataFrame, events: DataFrame, id_col: str, values: list[str]) -> DataFrame:
    """Offers with the events of their product: the concrete id where an offer has one, else the canonical one; organic and unit equal.

    Two equi-joins, by which of both ids an offer goes. What `values` are can
    be left to summed_of_offer, where offers need no event for itself.
    """
    same = ["organic", "unit_label"]
    return _of_offer(offers, lambda key: events.select(F.col(key).alias("_key"), *(F.col(c) for c in (*same, *values))), id_col)


def _of_offer(offers: DataFrame, events_by: Callable[[str], DataFrame], id_col: str) -> DataFrame:
    same = ["organic", "unit_label"]
    o = lambda rows, key: rows.select(id_col, F.col(key).alias("_key"), *same)
    known = F.coalesce(F.col("product_id"), F.lit("")) != ""
    concrete = o(offers.where(known), "product_id").join(events_by("product_id"), ["_key", *same])
    general = o(offers.where(~known), "canonical_id").join(events_by("canonical_id"), ["_key", *same])
    return concrete.unionByName(general).drop("_key")


def summed_of_offer(offers: DataFrame, events: DataFrame, id_col: str, value: str) -> DataFrame:
    """For each offer that has any the number and least value of the events of its product (see of_offer).

    Events are summed by key before offers meet them: a key that many offers
    and many events have makes no pairs.
    """
    summed = lambda key: events.groupBy(F.col(key).alias("_key"), "organic", "unit_label").agg(F.count("*").alias("_n"), F.min(value).alias("_least"))
    return _of_offer(offers, summed, id_col).groupBy(id_col).agg(F.sum("_n").alias("matched"), F.min("_least").alias("least"))


def _index(offers: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    ean, own = F.concat(F.lit("ean:"), F.col("gtin")), F.concat(F.lit("id:"), F.col("product_id"))
    return offers.select(id_col, F.coalesce(ean, own).alias("_key")), F.array_compact(F.array(ean, own))


def indexed(offers: DataFrame, events: DataFrame, id_col: str, values: list[str]) -> DataFrame:
    """Offers with the events reached by their article number, if they have one, else by their product id."""
    asked, keys = _index(offers, id_col)
    return asked.join(events.select(F.explode(keys).alias("_key"), *values), "_key").drop("_key")


def summed_indexed(offers: DataFrame, events: DataFrame, id_col: str) -> DataFrame:
    """For each offer that reaches any the number of events reached (see indexed), counted by key before offers meet them."""
    asked, keys = _index(offers, id_col)
    counts = events.select(F.explode(keys).alias("_key")).groupBy("_key").agg(F.count("*").alias("_n"))
    return asked.join(counts, "_key").groupBy(id_col).agg(F.sum("_n").alias("reached"))


def migrated(events: DataFrame) -> DataFrame:
    """Events of the first format in the second: what was not asked for then is filled in from what was.

    A product id is made of store, name and size, else it is the canonical
    one; the effective price is the price; the observation was when the event
    was first, else last seen; its source is the history that there was.
    """
    from offermill.functions.text import slug

    made = F.nullif(slug(F.concat_ws("|", F.coalesce("store", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("size", F.lit("")))), F.lit(""))
    return events.withColumns({
        "product_id": F.coalesce("product_id", made, "canonical_id"),
        "effective_price": F.round(F.coalesce("effective_price", "price"), 4),
        "observed_at": F.coalesce("observed_at", "first_seen", "last_seen"),
        "source_type": F.coalesce("source_type", F.lit("existing_history")),
    })
