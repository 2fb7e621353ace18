"""Queries on stored tables: versions, streams, and history rebuilt from snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offermill.operators import backfill, history
from offermill.plans.series import ISLANDS, OBSERVATIONS, SERIES, observations
from offermill.sources.tables import kept, read, read_stream, shared_top
from offermill.sources.versions import VersionedTable
from offermill.streaming.series import keep_series


def _own_folder(spark: SparkSession) -> str:
    """A folder of this run below the shared one, deleted when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_top(spark)}/offermill-store-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return str(path)


def price_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events read as a stream, with a state for each series, into a versioned table."""
    folder, whole = _own_folder(spark), observations(spark, sf_dir)
    stream = read_stream(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") / 100).cast("long").alias("price"))
    table = VersionedTable(spark, f"{folder}/table", SERIES, buckets=16)
    keep_series(stream, table, f"{folder}/checkpoint", SERIES, ["price"], "ts", "event_id", delay="1 hour").awaitTermination()
    events = table.read() if table.versions() else history.price_events(whole, SERIES, ["price"], "ts", "event_id")
    return events.select(*SERIES, "price", "first_seen", "last_seen", "observations")


PRICE_EVENTS = f"with o as (select * from {OBSERVATIONS} x), {ISLANDS} select * from e"


def price_events_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by four batches in order of time, each a version of the table in which only its series' buckets are new."""
    o = observations(spark, sf_dir)
    table = VersionedTable(spark, f"{_own_folder(spark)}/table", SERIES, buckets=16)
    args = (SERIES, ["price"], "ts", "event_id")
    ends = [F.lit(f"2024-01-{day}").cast("timestamp") for day in ("06", "16", "24")]
    for i in range(4):
        batch = o
        if i:
            batch = batch.where(F.col("ts") >= ends[i - 1])
        if i < 3:
            batch = batch.where(F.col("ts") < ends[i])
        table.write(batch, lambda old, new: history.price_events(new, *args) if old is None else history.extended(old, new, *args), mark=str(i))
    table.vacuum(keep=1)
    return table.read()


#: Weeks of line items as snapshots: offers of suppliers' parts, prices in steps, so that many stay as they were.
_OFFER = StructType().add("part", "long").add("supplier", "long").add("price", "double").add("flag", "string").add("until", "string").add("sure", "double")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """revision, at, part and body: each week's line items in JSON documents of some hundred orders; every 13th document is cut short."""
    li = read(spark, sf_dir, "lineitem")
    week, part = F.floor(F.datediff("l_shipdate", F.lit("1990-01-01")) / 7).cast("int"), F.floor(F.col("l_orderkey") / 500)
    offer = F.struct(
        (F.col("l_partkey") % 40).alias("part"), (F.col("l_suppkey") % 5).alias("supplier"), (F.floor(F.col("l_extendedprice") / 40000) + F.lit(0.5)).alias("price"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linenumber") == 7, F.date_format("l_shipdate", "yyyy-MM")).alias("until"), ((F.col("l_quantity") + 25) / 50).alias("sure"),
    )
    docs = li.groupBy(week.alias("week"), part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", offer.alias("offer")))).alias("o"))
    text = F.to_json(F.struct(F.col("o.offer").alias("offers")))
    body = F.when((F.col("week") + F.col("part")) % 13 == 5, F.expr("substring(j, 1, cast(length(j) / 2 as int))")).otherwise(F.col("j"))
    return docs.withColumn("j", text).select("week", "part", F.date_add(F.lit("1990-01-01"), F.col("week") * 7).cast("timestamp").alias("at"), body.alias("body"))


_SERIES, _VALUES = ["part", "supplier", "flag"], ["price", "until"]


def _fated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = backfill.revision_offers(revisions(spark, sf_dir).withColumn("revision", F.struct("week", F.col("part").alias("doc"))), "revision", "at", "body", _OFFER)
    rows = rows.select("revision.week", "revision.doc", "at", "place", *_OFFER.fieldNames())
    reason = F.when(F.col("sure") < 0.8, "uncertain").when(~F.coalesce(F.col("price") > 1, F.lit(False)), "invalid")
    return backfill.judged(rows, _SERIES, _VALUES, reason, F.col("supplier") != 3, ["until"], ["doc", "place"])


def backfill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of history rebuilt from all readable snapshots."""
    return backfill.events_of(_fated(spark, sf_dir), _SERIES, _VALUES)


def backfill_by_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the offers of each week: raw is the sum of the others."""
    return backfill.counted(_fated(spark, sf_dir), ["week"])


_BACKFILL = """
l as (select *, cast(floor((cast(l_shipdate as date) - date '1990-01-01') / 7.0) as integer) as week, cast(floor(l_orderkey / 500) as bigint) as doc from lineitem),
o as (select week, doc, date '1990-01-01' + week * 7 as day, l_orderkey, l_linenumber, l_partkey % 40 as part, l_suppkey % 5 as supplier, l_returnflag as flag, floor(l_extendedprice / 40000) + 0.5e0 as price,
    case when l_linenumber = 7 then strftime(l_shipdate, '%Y-%m') end as until, (l_quantity + 25) / 50 as sure from l where (week + doc) % 13 <> 5),
j as (select *, sure < 0.8e0 or not price > 1 as bad from o),
w as (select *, case when bad then null when lag(day) over s is null or price is distinct from lag(price) over s or until is distinct from lag(until) over s or (until is null and day - lag(day) over s > 8) then 1 else 0 end as begins,
    from j window s as (partition by bad, part, supplier, flag order by day, doc, l_orderkey, l_linenumber, part, supplier, price)),
f as (select *, case when bad then 'rejected' when begins = 0 then 'merged' when supplier <> 3 then 'inserted' else 'archived' end as fate,
    sum(begins) over (partition by bad, part, supplier, flag order by day, doc, l_orderkey, l_linenumber, part, supplier, price rows unbounded preceding) as run from w)"""

BACKFILL_EVENTS = f"""with {_BACKFILL}
select part, supplier, flag, price, until, bool_or(fate = 'archived') as archived, min(cast(day as timestamp)) as first_seen, max(cast(day as timestamp)) as last_seen, count(*) as observations
from f where not bad group by part, supplier, flag, price, until, run"""

BACKFILL_BY_REVISION = f"""with {_BACKFILL}
select week, count(*) as raw, count(*) filter (fate = 'inserted') as inserted, count(*) filter (fate = 'merged') as merged, count(*) filter (fate = 'archived') as archived, count(*) filter (fate = 'rejected') as rejected from f group by week"""


def revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week's snapshot against the one before: offers added, gone, changed and the same."""
    rows, log = backfill.revision_offers(revisions(spark, sf_dir), "week", "at", "body", _OFFER, write=kept)
    log = log.groupBy("revision").agg(F.min("at").alias("at"), F.bool_or("readable").alias("readable"))
    return backfill.changes(rows, log, ["part", "supplier", "flag"], "price", kept)


REVISION_CHANGES = f"""with {_BACKFILL},
n as (select week, row_number() over (order by week) as n from (select distinct week from o) x),
h as (select n.week, n.n, part, supplier, flag, min(price) as v from o join n using (week) group by all),
s as (select *, lag(n) over k as bn, lag(v) over k as bv, lead(n) over k as an from h window k as (partition by part, supplier, flag order by n)),
c as (select n, count(*) filter (bn is distinct from n - 1) as added, count(*) filter (bn = n - 1 and bv <> v) as changed, count(*) filter (bn = n - 1 and bv = v) as same from s group by n),
g as (select n + 1 as n, count(*) as gone from s where an is distinct from n + 1 group by n)
select n.week as revision, coalesce(added, 0) as added, coalesce(gone, 0) as gone, coalesce(changed, 0) as changed, coalesce(same, 0) as same from n left join c using (n) left join g using (n)"""


def _old_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events of the first format: some without a product id, an effective price, an observation or a source."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    day = F.col("l_shipdate")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("product_id"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("canonical_id"),
        F.concat(F.lit("Store "), F.col("l_suppkey").cast("string")).alias("store"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 != 0, F.concat(F.col("p_size").cast("string"), F.lit(" g"))).alias("size"),
        (F.col("l_extendedprice") / 7).alias("price"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice") / 9).alias("effective_price"),
        F.when(F.col("l_returnflag") == "R", day).alias("observed_at"), F.when(F.col("l_returnflag") != "A", F.date_sub(day, 3).cast(li.schema["l_shipdate"].dataType)).alias("first_seen"), day.alias("last_seen"), F.when(F.col("l_linestatus") == "O", "live_import").alias("source_type"),
    )


def events_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the first format in a versioned table, read and, where their bucket changed, written in the second."""
    old = kept(_old_events(spark, sf_dir))
    path = f"{_own_folder(spark)}/table"
    VersionedTable(spark, path, ["l_orderkey"], buckets=8).write(old, lambda _, new: new)
    table = VersionedTable(spark, path, ["l_orderkey"], buckets=8, upgrades=(history.migrated,))
    table.write(table.read().where("l_orderkey % 7 = 0"), lambda before, _: before)  # their buckets are now of the second format
    return table.read().select("l_orderkey", "l_linenumber", "product_id", F.col("effective_price").cast("double").alias("effective_price"), "observed_at", "source_type")


EVENTS_MIGRATED = """
select l_orderkey, l_linenumber, case when l_linenumber <> 2 then 'p' || l_partkey else regexp_replace(lower('store ' || l_suppkey || ' ' || p_name || case when p_size % 3 <> 0 then ' ' || p_size || ' g' else '' end), '[^a-z0-9]+', '-', 'g') end as product_id,
    round(case when l_linenumber % 2 = 0 then l_extendedprice / 9 else l_extendedprice / 7 end, 4) as effective_price,
    case when l_returnflag = 'R' then l_shipdate when l_returnflag <> 'A' then l_shipdate - interval 3 days else l_shipdate end as observed_at, case when l_linestatus = 'O' then 'live_import' else 'existing_history' end as source_type
from lineitem join part on l_partkey = p_partkey"""

QUERIES = {
    "price_events_stream": (price_events_stream, PRICE_EVENTS),
    "price_events_versions": (price_events_versions, PRICE_EVENTS),
    "backfill_events": (backfill_events, BACKFILL_EVENTS),
    "backfill_by_revision": (backfill_by_revision, BACKFILL_BY_REVISION),
    "revision_changes": (revision_changes, REVISION_CHANGES),
    "events_migrated": (events_migrated, EVENTS_MIGRATED),
}
