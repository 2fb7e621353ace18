"""Queries on offers and prices. lineitem is the offer, part the product, supplier the store.

Money is decimal until the last step; amounts come out as doubles of rounded
decimals, so that no result hangs on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.functions import money
from offermill.operators import history, pick, quality
from offermill.sources.tables import read




def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices as whole thousandths, which compare exactly."""
    units = F.round(F.round(F.col("l_extendedprice") * 100).cast("long") * 10 / F.round("l_quantity").cast("long")).cast("long")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_discount", units.alias("unit"))


OFFERS = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_discount, cast(round(cast(round(l_extendedprice * 100) as bigint) * 10 / cast(round(l_quantity) as bigint)) as bigint) as unit from lineitem)"


def unit_price_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    metric = money.price_metric(F.when(F.col("l_discount") < 0.09, F.col("unit")), F.lit(0))
    return o.select("l_orderkey", "l_linenumber", "unit", metric.cast("long").alias("metric"))


UNIT_PRICE_NORMALIZE = f"select l_orderkey, l_linenumber, unit, cast(coalesce(case when l_discount < 0.09 and unit > 0 then unit end, 0) as bigint) as metric from {OFFERS}"


def compare_cheapest_next_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest offer of every product and the next price at another store.

    Rows shrink to one a product and store by partial aggregation before
    anything is ranked; the store's name is joined last, to two rows a product.
    """
    o = offers(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.min("unit").alias("unit"))
    ranked = pick.top_per(o, ["l_partkey"], [F.asc("unit"), F.asc("l_suppkey")], 2)
    two = ranked.groupBy("l_partkey").agg(*(F.max(F.when(F.col("place") == k, F.col(c))).alias(n) for k, c, n in ((1, "unit", "best_unit"), (1, "l_suppkey", "best_store"), (2, "unit", "next_unit"), (2, "l_suppkey", "next_store"))))
    store = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    named = two.join(store.withColumnsRenamed({"s_suppkey": "best_store", "s_name": "best_name"}), "best_store", "left").join(store.withColumnsRenamed({"s_suppkey": "next_store", "s_name": "next_name"}), "next_store", "left")
    return named.select("l_partkey", "best_unit", "best_name", "next_unit", "next_name")


COMPARE_CHEAPEST_NEXT_STORE = f"""
with s as (select l_partkey, l_suppkey, min(unit) as unit from {OFFERS} o group by l_partkey, l_suppkey),
r as (select *, row_number() over (partition by l_partkey order by unit, l_suppkey) as place from s)
select a.l_partkey, a.unit as best_unit, x.s_name as best_name, b.unit as next_unit, y.s_name as next_name
from (select * from r where place = 1) a left join (select * from r where place = 2) b on a.l_partkey = b.l_partkey
left join supplier x on x.s_suppkey = a.l_suppkey left join supplier y on y.s_suppkey = b.l_suppkey"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    return quality.with_reason(o, [("no_unit", F.col("unit").isNull()), ("unit_price_too_low", F.col("unit") < 1_000_000), ("unit_price_too_high", F.col("unit") > 1_900_000), ("deep_discount", F.col("l_discount") > 0.095)])


REASON = "case when unit is null then 'no_unit' when unit < 1000000 then 'unit_price_too_low' when unit > 1900000 then 'unit_price_too_high' when l_discount > 0.095 then 'deep_discount' end"


def reject_reason_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).where("reason is not null").select("l_orderkey", "l_linenumber", "reason")


REJECT_REASON_FIRST = f"select l_orderkey, l_linenumber, {REASON} as reason from {OFFERS} o where {REASON} is not null"


def quality_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.funnel(checked(spark, sf_dir))


QUALITY_FUNNEL = f"select coalesce({REASON}, 'kept') as reason, count(*) as n from {OFFERS} o group by 1"


def price_unit_swap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if every seventh line had its amount where its unit price belongs."""
    amount = F.round("l_quantity").cast("double")
    price = F.floor(F.col("l_extendedprice") / 100)
    unit = F.when(F.col("l_orderkey") % 7 == 0, amount).otherwise(F.floor(price / amount) + 0.5)
    p, u, repaired = quality.swapped_repair(price.cast("double"), unit, amount)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("price"), u.cast("double").alias("unit"), repaired.alias("repaired"))


PRICE_UNIT_SWAP_REPAIR = """
with x as (select l_orderkey, l_linenumber, cast(round(l_quantity) as double) as amount, cast(floor(l_extendedprice / 100) as double) as price from lineitem),
y as (select *, case when l_orderkey % 7 = 0 then amount else floor(price / amount) + 0.5 end as unit from x),
z as (select *, abs(unit - amount) <= greatest(0.015, 0.06 * amount) and price > 0.3 and amount > 0 as repaired from y)
select l_orderkey, l_linenumber, case when repaired then price * amount else price end as price, cast(case when repaired then price else unit end as double) as unit, repaired from z"""


def _deduped(order, sf: tuple[SparkSession, str]) -> DataFrame:
    return pick.first_per(offers(*sf), ["l_partkey", "l_suppkey"], order).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "unit")


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped([F.asc("l_orderkey"), F.asc("l_linenumber")], (spark, sf_dir))


def dedupe_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped([F.asc("unit"), F.asc("l_orderkey"), F.asc("l_linenumber")], (spark, sf_dir))


def dedupe_best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.when(F.col("l_discount") >= 0.05, 2).otherwise(0) + F.when(F.col("unit") > 1_200_000, 1).otherwise(0)
    return _deduped([points.desc(), F.asc("l_orderkey"), F.asc("l_linenumber")], (spark, sf_dir))


def _deduped_sql(order: str) -> str:
    return f"select l_partkey, l_suppkey, l_orderkey, l_linenumber, unit from (select *, row_number() over (partition by l_partkey, l_suppkey order by {order}) as place from {OFFERS} o) r where place = 1"


def iqr_filtered_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = history.typical_range(offers(spark, sf_dir), ["l_partkey"], F.col("unit"))
    return o.select("l_partkey", "n", "n_kept", "median")


_HINGES = """
h as (select *, len(a) as n, a[1:len(a) // 2] as lo, a[(len(a) + 1) // 2 + 1:len(a)] as hi from g),
q as (select *, (lo[(len(lo) + 1) // 2] + lo[len(lo) // 2 + 1]) / 2.0 as q1, (hi[(len(hi) + 1) // 2] + hi[len(hi) // 2 + 1]) / 2.0 as q3 from h),
k as (select *, case when n < 5 or q3 - q1 <= 0 then a else list_filter(a, lambda x: x >= q1 - 1.5 * (q3 - q1) and x <= q3 + 1.5 * (q3 - q1)) end as kept from q)"""

IQR_FILTERED_MEDIAN = f"""
with g as (select l_partkey, list(unit order by unit) as a from {OFFERS} o group by l_partkey), {_HINGES}
select l_partkey, cast(n as bigint) as n, cast(len(kept) as bigint) as n_kept, (kept[(len(kept) + 1) // 2] + kept[len(kept) // 2 + 1]) / 2.0 as median from k"""


def price_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price of every product against its recent ones: six months before 1998-06-01, if four are that new."""
    now = F.lit("1998-06-01").cast("timestamp")
    o = offers(spark, sf_dir)
    current = F.max_by("unit", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    r = history.rating(o, ["l_partkey"], F.col("unit"), current, F.col("l_shipdate") >= F.add_months(now, -6))
    return r.select("l_partkey", "n", "current", "typical", "low", "high", "status")


PRICE_ASSESSMENT = f"""
with o as (select *, l_shipdate >= timestamp '1997-12-01' as recent from {OFFERS} o1),
c as (select l_partkey, unit as current from (select l_partkey, unit, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as place from o) p where place = 1),
u as (select l_partkey, sum(case when recent then 1 else 0 end) as fresh from o group by l_partkey),
g as (select o.l_partkey, list(unit order by unit) as a from o join u on o.l_partkey = u.l_partkey where u.fresh < 4 or o.recent group by o.l_partkey), {_HINGES},
m as (select k.l_partkey, cast(len(kept) as bigint) as n, c.current, (kept[(len(kept) + 1) // 2] + kept[len(kept) // 2 + 1]) / 2.0 as typical, kept[1] as low, kept[len(kept)] as high from k join c on k.l_partkey = c.l_partkey)
select l_partkey, n, current, typical, low, high, case when n < 4 then 'insufficient' when high - low > 0.005 and current <= low + 0.005 then 'low'
when (current / typical - 1) * 100 <= -15 then 'hot' when (current / typical - 1) * 100 <= -5 then 'good' when (current / typical - 1) * 100 > 5 then 'high' else 'normal' end as status from m"""


def staples_price_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain median, and -5 % and +8 %."""
    o = offers(spark, sf_dir).groupBy("l_partkey").agg(F.median("unit").alias("usual"), F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "unit"))["unit"].alias("current"))
    change = (F.col("current") / F.col("usual") - 1) * 100
    return o.select("l_partkey", "usual", "current", F.when(change <= -5, "cheap").when(change >= 8, "dear").otherwise("usual").alias("status"))


STAPLES_PRICE_ASSESSMENT = f"""
with c as (select l_partkey, unit as current from (select l_partkey, unit, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as place from {OFFERS} o) p where place = 1),
m as (select l_partkey, median(unit) as usual from {OFFERS} o group by l_partkey)
select c.l_partkey, cast(usual as double) as usual, current, case when (current / usual - 1) * 100 <= -5 then 'cheap' when (current / usual - 1) * 100 >= 8 then 'dear' else 'usual' end as status from c join m on c.l_partkey = m.l_partkey"""


def top_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six greatest savings, one of each store and product."""
    o = offers(spark, sf_dir).withColumn("saving", F.round(F.col("l_discount") * 100).cast("long")).where("saving > 0")
    one = o.groupBy("l_suppkey", "l_partkey").agg(F.max(F.struct("saving", (-F.col("unit")).alias("u"))).alias("m")).select("l_suppkey", "l_partkey", "m.saving", (-F.col("m.u")).alias("unit"))
    return one.orderBy(F.desc("saving"), "unit", "l_suppkey", "l_partkey").limit(6)


TOP_DEALS = f"""
with o as (select l_suppkey, l_partkey, unit, cast(round(l_discount * 100) as bigint) as saving from {OFFERS} o1),
r as (select *, row_number() over (partition by l_suppkey, l_partkey order by saving desc, unit) as place from o where saving > 0)
select l_suppkey, l_partkey, saving, unit from r where place = 1 order by saving desc, unit, l_suppkey, l_partkey limit 6"""


def shopping_list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum and the number of stores of a list of products at their cheapest."""
    wanted = spark.createDataFrame([(k, n) for k, n in ((1, 2), (7, 1), (19, 3), (42, 1), (101, 5))], "l_partkey long, pieces long")
    cheapest = pick.first_per(offers(spark, sf_dir).join(F.broadcast(wanted), "l_partkey"), ["l_partkey"], [F.asc("unit"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return cheapest.agg(F.sum(F.col("unit") * F.col("pieces")).alias("total"), F.count_distinct("l_suppkey").alias("stores"), F.count("*").alias("products"))


SHOPPING_LIST_TOTAL = f"""
with w as (select * from (values (1, 2), (7, 1), (19, 3), (42, 1), (101, 5)) t(k, pieces)),
r as (select o.*, w.pieces, row_number() over (partition by l_partkey order by unit, l_orderkey, l_linenumber) as place from {OFFERS} o join w on o.l_partkey = w.k)
select cast(sum(unit * pieces) as bigint) as total, count(distinct l_suppkey) as stores, count(*) as products from r where place = 1"""


def merge_survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offermill.operators.entity import merged

    o = offers(spark, sf_dir).withColumn("is_offer", F.col("l_discount") >= 0.05).withColumn("regular", F.when(F.col("l_orderkey") % 3 == 0, F.col("unit") + 5000))
    return merged(o, ["l_partkey"], "unit", "is_offer", ["l_suppkey"], "regular")


MERGE_SURVIVORSHIP = f"""
with o as (select *, l_discount >= 0.05 as is_offer, case when l_orderkey % 3 = 0 then unit + 5000 end as regular from {OFFERS} o1),
b as (select l_partkey, l_suppkey, min(unit) as p, min(case when is_offer then unit end) as o, max(regular) as r, max(case when not is_offer then unit end) as n, count(*) as c from o group by 1, 2),
t as (select l_partkey, min(o) as offer_price, min(p) as least, max(greatest(r, n)) as top, count(*) as branch_count, cast(sum(c) as bigint) as merged_from from b group by 1)
select l_partkey, coalesce(offer_price, least) as current_price, offer_price, case when top >= coalesce(offer_price, least) then top when offer_price is null then least end as regular_price, branch_count, merged_from from t"""


def staple_best_second_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every product type the cheapest offer, the next at another store, and the number of stores."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    o = offers(spark, sf_dir).join(part, "l_partkey").groupBy("p_type", "l_suppkey").agg(F.min("unit").alias("unit"))
    two = pick.best_and_other_store(o, ["p_type"], "l_suppkey", [F.asc("unit"), F.asc("l_suppkey")])
    stores = o.groupBy("p_type").agg(F.count("*").alias("stores"))
    return two.join(stores, "p_type").select("p_type", F.col("best.unit").alias("best_unit"), F.col("best.l_suppkey").alias("best_store"), F.col("second.unit").alias("next_unit"), F.col("second.l_suppkey").alias("next_store"), "stores")


STAPLE_BEST_SECOND_SELLERS = f"""
with s as (select p_type, l_suppkey, min(unit) as unit from {OFFERS} o join part on p_partkey = l_partkey group by 1, 2),
r as (select *, row_number() over (partition by p_type order by unit, l_suppkey) as place, count(*) over (partition by p_type) as stores from s)
select p_type, max(case when place = 1 then unit end) as best_unit, max(case when place = 1 then l_suppkey end) as best_store, max(case when place = 2 then unit end) as next_unit, max(case when place = 2 then l_suppkey end) as next_store, max(stores) as stores from r group by p_type"""

QUERIES = {
    "unit_price_normalize": (unit_price_normalize, UNIT_PRICE_NORMALIZE),
    "compare_cheapest_next_store": (compare_cheapest_next_store, COMPARE_CHEAPEST_NEXT_STORE),
    "reject_reason_first": (reject_reason_first, REJECT_REASON_FIRST),
    "quality_funnel": (quality_funnel, QUALITY_FUNNEL),
    "price_unit_swap_repair": (price_unit_swap_repair, PRICE_UNIT_SWAP_REPAIR),
    "dedupe_keep_first": (dedupe_keep_first, _deduped_sql("l_orderkey, l_linenumber")),
    "dedupe_cheapest": (dedupe_cheapest, _deduped_sql("unit, l_orderkey, l_linenumber")),
    "dedupe_best_score": (dedupe_best_score, _deduped_sql("(case when l_discount >= 0.05 then 2 else 0 end + case when unit > 1200000 then 1 else 0 end) desc, l_orderkey, l_linenumber")),
    "iqr_filtered_median": (iqr_filtered_median, IQR_FILTERED_MEDIAN),
    "price_assessment": (price_assessment, PRICE_ASSESSMENT),
    "staples_price_assessment": (staples_price_assessment, STAPLES_PRICE_ASSESSMENT),
    "top_deals": (top_deals, TOP_DEALS),
    "shopping_list_total": (shopping_list_total, SHOPPING_LIST_TOTAL),
    "merge_survivorship": (merge_survivorship, MERGE_SURVIVORSHIP),
    "staple_best_second_sellers": (staple_best_second_sellers, STAPLE_BEST_SECOND_SELLERS),
}
