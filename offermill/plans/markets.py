"""Queries on places, sources, runs and histories. Customers are places, suppliers sources, nations branches, orders what is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.functions import identity, money, numbers, text
from offermill.operators import history, lines, market, runs, staples
from offermill.plans import offers as shape
from offermill.plans.offers import NORMAL
from offermill.sources.tables import read

#: Areas of the test tables, by address and by name.
AREAS = [("north", r"\b1\d* main", "^north"), ("south", r"\b2\d* main", "^south")]


def market_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places: their area, whether it counts, what their catalog is worth, and how far they are at most 20 km from a point."""
    k = F.col("c_custkey")
    places = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 4 > 0, F.concat((k % 30).cast("string"), F.lit(" Main-Straße"))).alias("address"), F.when(k % 8 == 0, "North City").when(k % 8 == 4, "Süd-South").alias("name"),
        F.when(k % 5 == 0, "full_catalog").when(k % 5 == 1, "odd").alias("known"), F.when(k % 3 == 0, "partial").when(k % 3 == 1, "login_required").alias("import_status"), F.when(k % 7 == 0, "http://x").alias("url"),
        (48.0 + (k * 7919 % 1000) / 2000.0).alias("lat"), (11.5 + (k * 104729 % 1000) / 2000.0).alias("lon"),
    )
    rows = market.with_policy(market.within(places, "lat", "lon", (48.2, 11.7), 20.0), "address", "name", AREAS)
    return rows.select("c_custkey", "allowed_area", "active", market.catalog_status(F.col("known"), F.col("import_status"), F.col("url")).alias("catalog_status"), F.round("distance_km", 2).alias("distance_km"))


MARKET_POLICY = """
with p as (select c_custkey as k, 48.0e0 + (c_custkey * 7919 % 1000) / 2000.0e0 as lat, 11.5e0 + (c_custkey * 104729 % 1000) / 2000.0e0 as lon from customer),
q as (select *, pow(sin(radians(lat - 48.2e0) / 2), 2) + cos(radians(48.2e0)) * cos(radians(lat)) * pow(sin(radians(lon - 11.7e0) / 2), 2) as h from p),
d as (select *, 2 * 6371 * atan2(sqrt(h), sqrt(1 - h)) as km from q),
a as (select *, case when k % 4 > 0 then (case when k % 30 = 1 or k % 30 between 10 and 19 then 'north' when k % 30 = 2 or k % 30 between 20 and 29 then 'south' end) when k % 8 = 0 then 'north' end as area from d where km <= 20)
select k as c_custkey, area as allowed_area, area is not null as active, case when k % 5 = 0 then 'full_catalog' when k % 3 = 1 then 'login_required' when k % 7 = 0 or k % 3 = 0 then 'offers_only' else 'unavailable' end as catalog_status, round(km, 2) as distance_km from a"""


def source_rebinding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources: those of market scope at the branch of their name or address, others at the nearest of their region."""
    s = F.col("s_suppkey")
    nation = read(spark, sf_dir, "nation")
    sources = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        s.alias("source"), F.col("n_regionkey").alias("store"), F.when(s % 2 == 0, "market").otherwise("regional").alias("scope"),
        F.when(s % 4 == 0, F.concat(F.lit("M"), (F.col("s_nationkey") % 4).cast("string"))).alias("market"), F.when(s % 4 == 2, F.lower("n_name")).alias("address"),
    )
    k = F.col("n_nationkey")
    branches = nation.select(k, F.col("n_regionkey").alias("store"), F.concat(F.lit("M"), (k % 6).cast("string")).alias("market"), F.col("n_name").alias("address"), F.when(k % 5 > 0, (k * 7 % 11).cast("double")).alias("distance"))
    return market.rebound(sources, branches, "store", "market", "address", "distance", ["n_nationkey"])


SOURCE_REBINDING = """
with s as (select s_suppkey as source, n_regionkey as store, s_suppkey % 2 = 0 as bound, case when s_suppkey % 4 = 0 then 'M' || s_nationkey % 4 end as market, case when s_suppkey % 4 = 2 then lower(n_name) end as address from supplier join nation on s_nationkey = n_nationkey),
b as (select n_nationkey, n_regionkey as store, 'M' || n_nationkey % 6 as market, n_name as address, coalesce(case when n_nationkey % 5 > 0 then n_nationkey * 7 % 11 end, 999) as far from nation),
j as (select s.source, b.market as branch_market, b.address as branch_address, count(*) over (partition by s.source) as branches, not bound or coalesce(s.market = b.market, false) or coalesce(s.address = lower(b.address), false) as fits, far, n_nationkey from s join b on s.store = b.store),
r as (select *, row_number() over (partition by source order by far, n_nationkey) as place from j where fits)
select source, branch_market, branch_address, branches from r where place = 1"""


def address_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a supplier and a nation of its region whose addresses are one."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("own")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey", F.when(F.col("s_suppkey") % 3 == 0, (F.col("s_suppkey") % 5).cast("string")).alias("zip"), F.concat(F.initcap("own"), F.lit(" 5")).alias("street"))
    b = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") % 5).cast("string")).alias("zip_b"), F.col("n_name").alias("street_b"))
    return s.join(b, "n_regionkey").where(market.same_address(F.col("zip"), F.col("zip_b"), F.col("street"), F.col("street_b"))).select("s_suppkey", "n_nationkey")


ADDRESS_MATCH = """
select s_suppkey, b.n_nationkey from supplier join nation n on s_nationkey = n.n_nationkey join nation b on b.n_regionkey = n.n_regionkey
where (s_suppkey % 3 <> 0 or b.n_nationkey % 2 <> 0 or s_suppkey % 5 = b.n_nationkey % 5) and (instr(lower(n.n_name) || ' 5', lower(b.n_name)) > 0 or instr(lower(b.n_name), lower(n.n_name) || ' 5') > 0)"""


def observations_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers as observations: what history takes, of what kind, and what it leaves."""
    rows = shape.normal(spark, sf_dir).withColumns({"market": F.lit("m"), "regular": F.when(F.col("id") % 3 == 0, F.col("price") + 7), "offered": F.when(F.col("id") % 4 == 0, F.col("price") - 1), "store": F.when(F.col("id") % 31 > 0, F.col("store")), "price": F.when(F.col("id") % 37 > 0, F.col("price")).otherwise(0)})
    out = history.observed(rows, F.lit("2026-01-05").cast("timestamp"))
    return out.groupBy("reason", "is_offer").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("products"), F.sum("regular_price").cast("long").alias("regular"), F.sum("offer_price").cast("long").alias("offered"), F.sum("effective_price").cast("long").alias("effective"), F.round(F.min("confidence"), 2).alias("least_confidence"))


OBSERVATIONS_TAKEN = f"""with {NORMAL},
r as (select n.* exclude (price, store, unit), unit, case when id % 37 > 0 then price else 0 end as price, price as full, case when id % 31 > 0 then store end as store, case when id % 3 = 0 then price + 7 end as regular, case when id % 4 = 0 then price - 1 end as offered from n),
x as (select *, case when confidence < 0.8 and gtin is null then 'uncertain' when store is null or price <= 0 or coalesce(case when unit > 0 then unit end, price) <= 0 then 'invalid' end as reason from r)
select reason, is_offer, count(*) as n, count(distinct product_id) as products, cast(sum(coalesce(regular, case when not is_offer then price end)) as bigint) as regular, cast(sum(case when is_offer then coalesce(offered, price) end) as bigint) as offered, cast(sum(price) as bigint) as effective,
round(min(case when gtin is not null then 1.0e0 else greatest(0.8e0, confidence) end), 2) as least_confidence from x group by 1, 2"""


def history_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For offers of one store the number and least price of their product's events at the others, by both ways to reach them."""
    rows = shape.normal(spark, sf_dir)
    offers = rows.where("store = 'Store 0'").withColumn("product_id", F.when(F.col("p_partkey") % 2 == 0, F.col("product_id")))
    events = rows.where("store <> 'Store 0'")
    one = history.summed_of_offer(offers, events, "id", "price")
    two = history.summed_indexed(rows.where("store = 'Store 0'"), events, "id")
    return one.join(two, "id", "full_outer").select("id", "matched", "least", "reached")


HISTORY_MATCHES = f"""with {NORMAL},
a as (select *, case when p_partkey % 2 = 0 then product_id end as concrete from n where store = 'Store 0'), e as (select * from n where store <> 'Store 0'),
x as (select a.id, count(*) as matched, min(e.price) as least from a join e on a.organic = e.organic and a.unit_label = e.unit_label and case when a.concrete is not null then a.concrete = e.product_id else a.canonical_id = e.canonical_id end group by 1),
y as (select a.id, count(*) as reached from a join e on case when a.gtin is not null then a.gtin = e.gtin else a.product_id = e.product_id end group by 1)
select coalesce(x.id, y.id) as id, matched, least, reached from x full outer join y on x.id = y.id"""


def events_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of types that do not count any more go to the archive, once for each id there."""
    e = read(spark, sf_dir, "events").withColumn("key", F.concat_ws("-", "user_id", "event_type"))
    out = history.active_and_archived(e, F.col("event_type") != "error", "key", "ts")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("archived").alias("archived"))


EVENTS_ARCHIVED = """
with r as (select *, event_type = 'error' as archived, row_number() over (partition by user_id, event_type order by ts) as place from events)
select event_type, count(*) as n, count(*) filter (where archived) as archived from r where not archived or place = 1 group by 1"""


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources of a run: their status from orders that name them, then the run's and the data's."""
    s = F.col("s_suppkey")
    sources = read(spark, sf_dir, "supplier").select(s)
    results = sources.where("s_suppkey % 5 < 3").select(s, F.when(s % 5 == 0, "ok").when(s % 5 == 1, "no_data").otherwise("auth_error").alias("status"), (s * 3).alias("count"))
    starts = sources.where("s_suppkey % 2 = 0").select(s, F.lit(1).alias("started"))
    status = runs.source_status(sources, results, starts, ["s_suppkey"])
    settled = runs.settled_status(status, sources.where("s_suppkey % 10 > 0").select(s, (s % 4).alias("n")), ["s_suppkey"])
    current = runs.is_current(F.lit("2026-01-05 10:00:00").cast("timestamp"), F.lit("2026-01-05 10:00:05").cast("timestamp"), F.lit("2026-01-05 11:00:00").cast("timestamp"))
    now = runs.run_summary(status, ~current).select(F.lit("run").alias("what"), "sources", "ok", "no_data", "errors", "skipped", "run")
    after = runs.run_summary(settled, F.lit(False)).select(F.lit("settled").alias("what"), "sources", "ok", "no_data", "errors", "skipped", "run")
    shops = sources.select(F.when(s % 9 == 0, "no_data").otherwise("fresh").alias("status"))
    o = runs.overall(shops, F.lit(False)).select(F.lit("data").alias("what"), (F.col("stale") + F.col("red") + F.col("fresh")).alias("sources"), F.col("fresh").alias("ok"), F.col("red").alias("no_data"), F.lit(0).cast("long").alias("errors"), F.col("stale").alias("skipped"), F.col("run_status").alias("run"))
    return now.unionByName(after).unionByName(o)


RUN_STATUS = """
with s as (select s_suppkey as k, case when s_suppkey % 5 = 0 then 'ok' when s_suppkey % 5 = 1 then 'no_data' when s_suppkey % 5 = 2 then 'auth_error' when s_suppkey % 2 = 0 then 'error' else 'skipped' end as status, case when s_suppkey % 10 > 0 then s_suppkey % 4 else 0 end as n from supplier),
t as (select k, case when n > 0 then 'ok' when status = 'ok' then 'no_data' else status end as status from s),
u as (select 'run' as what, status from s union all select 'settled', status from t),
v as (select what, count(*) as sources, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'no_data') as no_data, count(*) filter (where status in ('error', 'auth_error')) as errors, count(*) filter (where status = 'skipped') as skipped from u group by 1)
select *, case when errors > 0 then 'failed' else 'completed' end as run from v
union all select 'data', count(*), count(*) filter (where k % 9 > 0), count(*) filter (where k % 9 = 0), 0, 0, 'partial' from s"""


def butter_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products named after butter in turn: how near each is to butter, and how many of each tier."""
    names = ("Butterkekse", "Kräuterbutter", "Irische Butter", "Buttermilch", "Erdnussbutter", "Milch", "Butter-Brezel", "Süßrahmbutter")
    points = staples.tier_score(text.fold(F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8 + 1).cast("int"))))
    rows = read(spark, sf_dir, "part").select("p_brand", points.alias("score"))
    tier = F.when(F.col("score") >= 100, "butter").when(F.col("score") >= 70, "near").when(F.col("score") > 0, "name only")
    return rows.groupBy("p_brand", tier.alias("tier")).agg(F.count("*").alias("n"), F.max("score").cast("long").alias("score"))


BUTTER_TIERS = """
with r as (select p_brand, ([20, 70, 100, 20, 50, 0, 20, 100])[p_partkey % 8 + 1] as score from part)
select p_brand, case when score >= 100 then 'butter' when score >= 70 then 'near' when score > 0 then 'name only' end as tier, count(*) as n, cast(max(score) as bigint) as score from r group by 1, 2"""


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their place by type, brand, size and key."""
    return staples.numbered(read(spark, sf_dir, "part"), [F.asc("p_type"), F.asc("p_brand"), F.desc("p_size"), F.asc("p_partkey")]).select("p_partkey", "row_id")


ROW_NUMBERS = "select p_partkey, row_number() over (order by p_type, p_brand, p_size desc, p_partkey) as row_id from part"


def flyer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of labels written from the orders' dates, with and without years, and whether a day lies within."""
    d = F.to_date("o_orderdate")
    label = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format(d, "dd.MM."), F.lit(" - "), F.date_format(F.date_add(d, 6), "dd.MM."))).otherwise(F.concat(F.date_format(d, "dd.MM.yyyy"), F.lit(" bis "), F.date_format(F.date_add(d, 6), "dd.MM.yyyy")))
    first, last = numbers.flyer_range(label, F.year(d))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), first.alias("first_day"), last.alias("last_day"))
    return rows.select("o_orderkey", "first_day", "last_day", F.date_add("d", F.pmod(F.col("o_orderkey"), F.lit(9)).cast("int")).between(F.col("first_day"), F.col("last_day")).alias("within"), numbers.days_between(F.col("first_day").cast("timestamp"), F.col("last_day").cast("timestamp")).alias("days"))


FLYER_RANGES = "select o_orderkey, cast(o_orderdate as date) as first_day, cast(o_orderdate as date) + 6 as last_day, o_orderkey % 9 <= 6 as within, 6.0e0 as days from orders"


def base_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base prices, savings, cents and repaired decimals of texts written from prices."""
    c = F.round(F.col("p_retailprice") * 100).cast("long")
    euros = lambda x: F.concat(F.floor(x / 100).cast("string"), F.lit(","), F.lpad((x % 100).cast("string"), 2, "0"))
    k = F.col("p_partkey")
    note = F.when(k % 4 == 0, F.concat(F.lit("1 kg = "), euros(c))).when(k % 4 == 1, F.concat(F.lit("100 g "), euros(c))).when(k % 4 == 2, F.concat(F.lit("1 l = "), euros(c), F.lit(" - "), euros(c + 50)))
    spaced = F.concat(F.floor(c / 100).cast("string"), F.lit(". "), F.lpad((c % 100).cast("string"), 2, "0"))
    saving = money.saving_percent(c, F.when(k % 5 > 0, c + k % 5 * 10_000))
    return read(spark, sf_dir, "part").select(
        "p_partkey", (money.base_price(note) * 1000).cast("long").alias("base_thousandths"), money.repaired_decimals(spaced).alias("decimals"), saving.cast("long").alias("saving"),
        (money.cents(c) * 100).cast("long").alias("cents"), (money.unit_price(money.cents(c), F.when(k % 2 == 0, F.lit(2).cast("decimal(10,2)"))) * 1000).cast("long").alias("unit_thousandths"),
        identity.gtin_from_url(F.concat(F.lit("https://x.de/p/"), F.lpad((k * 7919 + 4_000_000_000_000).cast("string"), 13, "0"), F.lit("-a.html"))).alias("gtin"),
        identity.canonical_id(F.when(k % 6 == 0, F.lit("40")), F.col("p_type"), F.col("p_brand"), F.when(k % 3 > 0, F.lit("1 kg"))).alias("canonical_id"), text.clean(F.concat(F.lit("  a   b"), F.lit("\t"), F.col("p_name"), F.lit(" "))).alias("cleaned"),
    )


_SUM = " + ".join(f"cast(substring(code, {i + 1}, 1) as int) * {1 if i % 2 == 0 else 3}" for i in range(13))
BASE_PRICES = f"""
with p as (select *, cast(round(p_retailprice * 100) as bigint) as c, lpad(cast(p_partkey * 7919 + 4000000000000 as varchar), 13, '0') as code from part)
select p_partkey, case p_partkey % 4 when 0 then c * 10 when 1 then c * 100 when 2 then c * 10 end as base_thousandths, c // 100 || '.' || lpad(cast(c % 100 as varchar), 2, '0') as decimals,
case when p_partkey % 5 > 0 then cast(round((1 - c / (c + p_partkey % 5 * 10000.0e0)) * 100) as bigint) end as saving, c as cents, case when p_partkey % 2 = 0 then cast(round(c * 5) as bigint) end as unit_thousandths,
case when ({_SUM}) % 10 = 0 then code end as gtin, case when p_partkey % 6 = 0 then 'gtin-40' else lower(p_type) || '-' || replace(lower(p_brand), '#', '-') || case when p_partkey % 3 > 0 then '-1-kg' else '-groesse-unbekannt' end end as canonical_id, 'a b ' || p_name as cleaned from p"""


def adjacent_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages in line order: a net price, and within the next three words a gross price in brackets that fits it."""
    k = F.col("p_partkey")
    net = F.round(F.col("p_retailprice") * 10).cast("long")
    gross = F.round(net * F.element_at(F.array(F.lit(1.07), F.lit(1.19), F.lit(1.02), F.lit(1.3)), (k % 4 + 1).cast("int"))).cast("long")
    euros = lambda x: F.concat(F.floor(x / 100).cast("string"), F.lit(","), F.lpad((x % 100).cast("string"), 2, "0"))
    words = F.array(F.lit("Preis"), F.concat(euros(net), F.lit("*")), F.when(k % 3 == 0, F.lit("(")), F.concat(F.when(k % 3 > 0, F.lit("(")).otherwise(F.lit("")), euros(gross), F.lit(")")), F.lit("kg"))
    rows = read(spark, sf_dir, "part").select(k.alias("line"), F.posexplode(F.array_compact(words)).alias("place", "word"))
    return lines.adjacent_prices(rows, ["line"], "place", "word").select("line", "net", "gross")


ADJACENT_PRICES = """
with p as (select p_partkey as line, cast(round(p_retailprice * 10) as bigint) as net, p_partkey % 4 as m from part),
g as (select *, cast(round(net * ([1.07e0, 1.19e0, 1.02e0, 1.3e0])[m + 1]) as bigint) as gross from p)
select line, net, gross from g where m < 2"""

QUERIES = {
    "market_policy": (market_policy, MARKET_POLICY),
    "source_rebinding": (source_rebinding, SOURCE_REBINDING),
    "address_match": (address_match, ADDRESS_MATCH),
    "observations_taken": (observations_taken, OBSERVATIONS_TAKEN),
    "history_matches": (history_matches, HISTORY_MATCHES),
    "events_archived": (events_archived, EVENTS_ARCHIVED),
    "run_status": (run_status, RUN_STATUS),
    "butter_tiers": (butter_tiers, BUTTER_TIERS),
    "row_numbers": (row_numbers, ROW_NUMBERS),
    "flyer_ranges": (flyer_ranges, FLYER_RANGES),
    "base_prices": (base_prices, BASE_PRICES),
    "adjacent_prices": (adjacent_prices, ADJACENT_PRICES),
}
