"""Queries on time, order and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.functions import numbers
from offermill.operators import history, lines, market
from offermill.sources.tables import read, spread


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as price observations: a series of each user and type, its price the value's coarse step."""
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") / 100).cast("long").alias("price"))


OBSERVATIONS = "(select event_id, ts, user_id, event_type, cast(floor(value / 100) as bigint) as price from events)"
SERIES = ["user_id", "event_type"]

ISLANDS = """
g as (select *, case when lag(ts) over w is null or price is distinct from lag(price) over w or ts - lag(ts) over w > interval 8 days then 1 else 0 end as b from o window w as (partition by user_id, event_type order by ts, event_id)),
r as (select *, sum(b) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as run from g),
e as (select user_id, event_type, price, min(ts) as first_seen, max(ts) as last_seen, count(*) as observations from r group by user_id, event_type, price, run)"""


def price_events_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.price_events(observations(spark, sf_dir), SERIES, ["price"], "ts", "event_id")


PRICE_EVENTS_ISLANDS = f"with o as (select * from {OBSERVATIONS} x), {ISLANDS} select * from e"


def price_events_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two steps: events up to a day, then the later observations put to them."""
    o = observations(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp")
    old = history.price_events(o.where(F.col("ts") < cut), SERIES, ["price"], "ts", "event_id")
    return history.extended(old, o.where(F.col("ts") >= cut), SERIES, ["price"], "ts", "event_id")


def price_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_event(observations(spark, sf_dir), SERIES, "ts", "event_id", ["price"])


PRICE_LAST_EVENT = f"select user_id, event_type, ts, event_id, price from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as place from {OBSERVATIONS} x) r where place = 1"


def history_backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rebuild from all observations inserts, merges and rejects: together all of them."""
    o = read(spark, sf_dir, "events").withColumn("price", F.floor(F.col("value") / 100).cast("long"))
    good = F.col("value") >= 25
    events = history.price_events(o.where(good), SERIES, ["price"], "ts", "event_id")
    total = o.groupBy("event_type").agg(F.count("*").alias("raw"), F.count_if(~good).alias("rejected"))
    made = events.groupBy("event_type").agg(F.count("*").alias("inserted"), F.count_distinct("user_id").alias("series"), F.min("first_seen").alias("oldest"))
    return total.join(made, "event_type").select("event_type", "raw", "rejected", "inserted", (F.col("raw") - F.col("rejected") - F.col("inserted")).alias("merged"), "series", "oldest")


HISTORY_BACKFILL_COUNTS = f"""
with o as (select event_id, ts, user_id, event_type, cast(floor(value / 100) as bigint) as price from events where value >= 25), {ISLANDS},
t as (select event_type, count(*) as raw, count(*) filter (where not value >= 25) as rejected from events group by 1),
m as (select event_type, count(*) as inserted, count(distinct user_id) as series, min(first_seen) as oldest from e group by 1)
select t.event_type, raw, rejected, inserted, raw - rejected - inserted as merged, series, oldest from t join m on t.event_type = m.event_type"""


def carry_forward_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase's value up to each event of a user."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return lines.carried(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase").select("event_id", "user_id", "last_purchase")


CARRY_FORWARD_RANGE = "select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events"


def context_window_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns around each turn, two before and one after, and the nearest user turn before it."""
    c, order = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["turn", "role", "text"]
    out = lines.context(c, ["conv_id"], order, F.col("text"), 2, 1, "around")
    out = lines.looked_back(out, ["conv_id"], order, F.col("role") == "user", F.col("turn"), 10, "user_turn")
    return out.select("conv_id", "turn", F.md5("around").alias("around_md5"), "user_turn")


CONTEXT_WINDOW_LINES = """
select conv_id, turn, md5(coalesce(string_agg(text, chr(10)) over (w rows between 2 preceding and 1 following), '')) as around_md5,
last_value(case when role = 'user' then turn end ignore nulls) over (w rows between 10 preceding and current row) as user_turn
from conversations window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)"""


def context_window_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the nine rows before to the five after each row, in one order of all rows, and the nearest user turn."""
    c, order = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["turn", "role", "text"]
    out = lines.context(c, ["conv_id"], order, F.col("text"), 9, 5, "around")
    out = lines.looked_back(out, ["conv_id"], order, F.col("role") == "user", F.col("turn"), 10, "user_turn")
    return out.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), F.md5("around").alias("around_md5"), "user_turn")


CONTEXT_WINDOW_TURNS = """
select conv_id, turn, role, md5(text) as text_md5, md5(coalesce(string_agg(text, chr(10)) over (w rows between 9 preceding and 5 following), '')) as around_md5,
last_value(case when role = 'user' then turn end ignore nulls) over (w rows between 10 preceding and current row) as user_turn
from conversations window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)"""


def log_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's signups with the next purchase before another signup."""
    e = read(spark, sf_dir, "events")
    return lines.paired(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase", "ts")


LOG_PAIRING = """
select user_id, ts as started, case when lead(event_type) over w = 'purchase' then lead(ts) over w end as ended, event_type
from events where event_type in ('signup', 'purchase') window w as (partition by user_id order by ts, event_id)"""
LOG_PAIRING = f"select user_id, started, ended from ({LOG_PAIRING}) p where event_type = 'signup'"


def berlin_schedule_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(read(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    return e.select("event_id", numbers.next_slot(F.col("ts"), "Europe/Berlin", [6, 9, 12, 15, 18, 21]).alias("next_run"), F.hour(F.from_utc_timestamp("ts", "Europe/Berlin")).alias("berlin_hour"))


#: events lie in January, when Berlin is an hour ahead: the slots are 5, 8, 11, 14, 17 and 20 UTC.
BERLIN_SCHEDULE_SLOTS = """
with h as (select event_id, ts, cast(extract(hour from ts) as int) as u, cast(cast(ts as date) as timestamp) as d from events),
n as (select *, case when u < 5 then 5 when u < 8 then 8 when u < 11 then 11 when u < 14 then 14 when u < 17 then 17 when u < 20 then 20 else 29 end as s from h)
select event_id, d + to_hours(s) as next_run, cast((u + 1) % 24 as int) as berlin_hour from n"""


def week_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    monday, saturday = numbers.monday_to_saturday(F.col("o_orderdate"))
    return read(spark, sf_dir, "orders").select("o_orderkey", monday.alias("valid_from"), saturday.alias("valid_to"))


WEEK_VALIDITY = "select o_orderkey, cast(date_trunc('week', o_orderdate) as date) as valid_from, cast(cast(date_trunc('week', o_orderdate) as date) + 5 as date) as valid_to from orders"


def drop_guard_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority, 1996 against 1997: which slice shrank too much."""
    o = read(spark, sf_dir, "orders").withColumn("store", F.concat_ws("-", "o_orderpriority", (F.col("o_custkey") % 40).cast("string")))
    count = lambda y: o.where(F.year("o_orderdate") == y).groupBy("store").agg(F.count("*").alias("n"))
    return market.drop_guard(count(1996), count(1997), "store", "n")


DROP_GUARD_SNAPSHOT = """
with o as (select o_orderpriority || '-' || cast(o_custkey % 40 as varchar) as store, extract(year from o_orderdate) as y from orders),
p as (select store, count(*) as n from o where y = 1996 group by 1), c as (select store, count(*) as n from o where y = 1997 group by 1)
select coalesce(p.store, c.store) as store, coalesce(p.n, 0) as previous, coalesce(c.n, 0) as current, coalesce(p.n, 0) >= 5 and coalesce(c.n, 0) < coalesce(p.n, 0) * 0.7 as keep_previous from p full outer join c on p.store = c.store"""


def refresh_status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale, fresh or without data, for every nation, by its latest order."""
    last = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    joined = read(spark, sf_dir, "nation").join(last, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "no_data").when(F.col("last") < F.lit("2001-07-25").cast("timestamp"), "stale").otherwise("fresh")
    return joined.select("n_name", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


REFRESH_STATUS_LADDER = """
with l as (select c_nationkey, max(o_orderdate) as last, count(*) as n from customer join orders on c_custkey = o_custkey group by 1)
select n_name, coalesce(n, 0) as n, case when coalesce(n, 0) = 0 then 'no_data' when last < timestamp '2001-07-25' then 'stale' else 'fresh' end as status from nation left join l on n_nationkey = c_nationkey"""


def branch_fanout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products at branches: nations of a region are the branches; a third is regional, the others by address or market, else as they say."""
    b = read(spark, sf_dir, "nation").where("n_regionkey < 4").select("n_nationkey", F.col("n_regionkey").alias("store"), F.col("n_name").alias("address"), (F.col("n_nationkey") % 3).cast("string").alias("market"))
    k = F.col("p_partkey")
    address = F.when(k % 2 == 0, F.lit("FRANCE")).when(k % 7 == 1, F.lit("Kenya, Road 1"))
    o = read(spark, sf_dir, "part").select("p_partkey", (k % 5).cast("int").alias("store"), address.alias("address"), (k % 4).cast("string").alias("market"))
    allowed = market.allowed_area(F.col("address"), F.col("market"), ["kenya", "france"]).isNotNull()
    out = market.fan_out(o, b, "store", "address", "market", F.col("p_partkey") % 3 == 0, ["n_nationkey"], allowed)
    return out.select("p_partkey", "branch_address", "branch_market")


BRANCH_FANOUT_JOIN = """
with b as (select n_nationkey, n_regionkey as store, n_name as address, cast(n_nationkey % 3 as varchar) as market from nation where n_regionkey < 4),
o as (select p_partkey, p_partkey % 5 as store, case when p_partkey % 2 = 0 then 'FRANCE' when p_partkey % 7 = 1 then 'Kenya, Road 1' end as address, cast(p_partkey % 4 as varchar) as market, p_partkey % 3 = 0 as regional from part),
a as (select *, store in (select store from b) as has_branches, coalesce(regexp_matches(lower(address), '(^|[^a-z])(kenya|france)([^a-z]|$)'), false) as allowed from o),
wide as (select p_partkey, b.address as branch_address, b.market as branch_market from a join b on a.store = b.store where regional),
one as (select a.*, (select min(n_nationkey) from b where b.store = a.store and b.address = a.address) as x, (select min(n_nationkey) from b where b.store = a.store and b.market = a.market) as y from a where not (regional and has_branches))
select * from wide union all
select p_partkey, case when coalesce(x, y) is null then one.address else b.address end, case when coalesce(x, y) is null then one.market else b.market end
from one left join b on b.n_nationkey = coalesce(x, y) where coalesce(x, y) is not null or allowed"""


def prioritised_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's best source among its region's: the one of its own nation, else the first."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("store"))
    src = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("store"), F.col("n_nationkey").alias("source_nation"), F.col("n_name").alias("source"))
    rank = F.when(F.col("source_nation") == F.col("s_nationkey"), 0).when(F.col("source_nation").isNotNull(), 1)
    return market.prioritised(s, src, ["s_suppkey"], ["store"], rank, [F.col("source_nation")]).select("s_suppkey", "source")


PRIORITISED_SOURCE_JOIN = """
with s as (select s_suppkey, s_nationkey, n_regionkey as store from supplier join nation on s_nationkey = n_nationkey),
c as (select n_regionkey as store, n_nationkey as source_nation, n_name as source from nation where n_nationkey % 2 = 0),
j as (select s.s_suppkey, c.source, row_number() over (partition by s.s_suppkey order by case when c.source_nation = s.s_nationkey then 0 else 1 end, c.source_nation) as place from s left join c on s.store = c.store)
select s_suppkey, source from j where place = 1"""


def guard_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a customer: there have to be none; those of a cut-off customer table show."""
    c = read(spark, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"))
    return market.unmatched(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "o_custkey")


GUARD_ANTI_JOIN = "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey <> 3)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    address = F.when(k % 50 == 0, F.concat(F.lit("Road "), (k % 1000).cast("string"))).when(k % 50 == 1, F.lit(""))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (48.0 + (k * 7919 % 1000) / 10000.0).alias("lat"), (11.5 + (k * 104729 % 1000) / 10000.0).alias("lon"), address.alias("address"))


def haversine_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a nation that lie within 800 metres, or have one address."""
    return market.near_duplicates(places(spark, sf_dir), "c_custkey", "c_nationkey", "lat", "lon", 0.8, "address", digits=6)


HAVERSINE_NEAR_DUPLICATES = """
with p as (select c_custkey as id, c_nationkey as g, 48.0e0 + (c_custkey * 7919 % 1000) / 10000.0e0 as lat, 11.5e0 + (c_custkey * 104729 % 1000) / 10000.0e0 as lon, case when c_custkey % 50 = 0 then 'Road ' || (c_custkey % 1000) end as address from customer),
j as (select a.id as a, b.id as b, coalesce(a.address = b.address, false) as same, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) as q from p a join p b on a.g = b.g and a.id < b.id)
select a, b, round(2 * 6371 * atan2(sqrt(q), sqrt(1 - q)), 6) as km from j where same or 2 * 6371 * atan2(sqrt(q), sqrt(1 - q)) < 0.8"""


def spatial_nearest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price boxes and title blocks made from keys: forty to a page."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 40).alias("page"), (k * 37 % 500).cast("double").alias("x1"), (k * 53 % 700).cast("double").alias("y1"))
    box = p.select("id", "page", "x1", "y1", (F.col("x1") + 60).alias("x2"), (F.col("y1") + 20).alias("y2"), F.lit(600.0).alias("page_width"))
    out = market.nearest_box(box.where("id % 4 = 0"), box.where("id % 4 <> 0"), "page", 275.0)
    return out.select("id", "block", F.round("score", 4).alias("score"))


SPATIAL_NEAREST_BOX = """
with p as (select p_partkey as id, cast(floor(p_partkey / 40) as bigint) as page, cast(p_partkey * 37 % 500 as double) as x1, cast(p_partkey * 53 % 700 as double) as y1 from part),
b as (select *, x1 + 60 as x2, y1 + 20 as y2 from p),
j as (select a.id, b.id as block, 1.25e0 * case when b.y2 < a.y1 then a.y1 - b.y2 else 0.45e0 * abs((b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2) end + 0.38e0 * abs((a.x1 + a.x2) / 2 - 95 - (b.x1 + b.x2) / 2) - case when b.x2 <= a.x1 + 15 then 18 else 0 end as score
from b a join b on a.page = b.page and a.id % 4 = 0 and b.id % 4 <> 0 and b.y1 between a.y1 - 225 and a.y2 + 24 and b.x1 between a.x1 - 230 and least(600, a.x2 + 25)),
r as (select *, row_number() over (partition by id order by score, block) as place from j)
select id, block, round(score, 4) as score from r where place = 1 and score <= 275"""


def upsert_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three slices keyed by customer and day: the later slice wins, then the greater order."""
    from offermill.operators.pick import later_wins

    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")
    slices = [o.where(F.col("o_orderkey") % 3 == i) for i in range(3)]
    return later_wins(slices, ["o_custkey", "day"], [F.desc("o_orderkey")])


UPSERT_PRIORITY_UNION = "select o_custkey, day, o_orderkey from (select o_custkey, cast(o_orderdate as date) as day, o_orderkey, row_number() over (partition by o_custkey, cast(o_orderdate as date) order by o_orderkey % 3 desc, o_orderkey desc) as place from orders) r where place = 1"


def json_tree_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of foreign JSON, by path in a variant."""
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


JSON_TREE_EXTRACT = "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events"


def json_tree_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products at any node of foreign JSON, by the recursive search."""
    from offermill.sources.landed import json_products

    return json_products(read(spark, sf_dir, "events"), "event_id", "props")


QUERIES = {
    "price_events_islands": (price_events_islands, PRICE_EVENTS_ISLANDS),
    "price_events_extended": (price_events_extended, PRICE_EVENTS_ISLANDS),
    "price_last_event": (price_last_event, PRICE_LAST_EVENT),
    "history_backfill_counts": (history_backfill_counts, HISTORY_BACKFILL_COUNTS),
    "carry_forward_range": (carry_forward_range, CARRY_FORWARD_RANGE),
    "context_window_lines": (context_window_lines, CONTEXT_WINDOW_LINES),
    "log_pairing": (log_pairing, LOG_PAIRING),
    "berlin_schedule_slots": (berlin_schedule_slots, BERLIN_SCHEDULE_SLOTS),
    "week_validity": (week_validity, WEEK_VALIDITY),
    "drop_guard_snapshot": (drop_guard_snapshot, DROP_GUARD_SNAPSHOT),
    "refresh_status_ladder": (refresh_status_ladder, REFRESH_STATUS_LADDER),
    "branch_fanout_join": (branch_fanout_join, BRANCH_FANOUT_JOIN),
    "prioritised_source_join": (prioritised_source_join, PRIORITISED_SOURCE_JOIN),
    "guard_anti_join": (guard_anti_join, GUARD_ANTI_JOIN),
    "haversine_near_duplicates": (haversine_near_duplicates, HAVERSINE_NEAR_DUPLICATES),
    "spatial_nearest_box": (spatial_nearest_box, SPATIAL_NEAREST_BOX),
    "upsert_priority_union": (upsert_priority_union, UPSERT_PRIORITY_UNION),
    "json_tree_extract": (json_tree_extract, JSON_TREE_EXTRACT),
    "json_tree_products": (json_tree_products, None),
    "context_window_turns": (context_window_turns, CONTEXT_WINDOW_TURNS),
}
