"""Queries on imports: pages as nodes, tiles, upserts, ranges of days, and the counters of quality passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.operators import intervals, quality
from offermill.operators.upsert import upserted
from offermill.sources import landed, nodes
from offermill.sources.tables import kept, read, spread


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page's navigation, by a selector."""
    table = kept(nodes.nodes(spread(read(spark, sf_dir, "pages"), "page_id"), "page_id", "html"))
    links = nodes.selected(table, "nav li a[href]")
    text = nodes.texts_below(table, links)
    return links.join(text.withColumnRenamed("text", "said"), ["id", "node"]).select(F.col("id").alias("page_id"), "node", F.col("attrs")["href"].alias("href"), F.col("said").alias("text"))


def tile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as HTML tiles, twenty to a page: of two shapes; every third page repeats ids, every fifth has no prices."""
    k, page = F.col("p_partkey"), F.floor(F.col("p_partkey") / 20)
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    euro = lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"), F.lit(" €"))
    price = F.when(page % 5 == 4, F.lit("ausverkauft")).otherwise(euro(cents))
    key = F.when(page % 3 == 1, F.floor(k / 2)).otherwise(k).cast("string")
    old = F.when((k % 3 == 0) & (page % 5 != 4), F.concat(F.lit("<del>"), euro(cents + 250), F.lit("</del>"))).otherwise(F.lit(""))
    link = F.concat(F.lit('<a class="link to" data-id="'), key, F.lit('">'), F.initcap("p_name"), F.lit("</a>"))
    size = F.concat(F.lit("<p>ca. "), F.col("p_size").cast("string"), F.lit(" g"))
    one = F.concat(F.lit('<div class="tile"><h3>'), link, F.lit('</h3><div class="box"><span>'), price, F.lit("</span>"), old, F.lit("</div>"), size, F.lit("</div>"))
    two = F.concat(F.lit('<section><ul><li>neu<li>'), link, F.lit("</ul><br><b>"), price, F.lit("</b>"), old, F.lit("</section>"))
    tile = F.struct(k.alias("k"), F.when(k % 4 < 2, one).otherwise(two).alias("html"))
    rows = read(spark, sf_dir, "part").groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(tile)).alias("t"))
    return rows.select("page", F.concat(F.lit("<html><head><script>'1,00 €'</script></head><body><main>"), F.array_join("t.html", ""), F.lit("</main></body></html>")).alias("html"))


def tiles_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = kept(nodes.nodes(spread(tile_pages(spark, sf_dir), "page"), "page", "html"))
    return nodes.tiles(table, "main a.link", "data-id").select(F.col("id").alias("page"), F.col("key").cast("long").alias("key"), "name", F.col("price").cast("double").alias("price"), F.col("regular").cast("double").alias("regular"), "size")


TILES_MAPPED = """
with t as (select *, p_partkey // 20 as page, case when p_partkey // 20 % 3 = 1 then p_partkey // 2 else p_partkey end as key, round(p_retailprice * 100) / 100 as price from part where p_partkey // 20 % 5 <> 4),
l as (select * from t qualify row_number() over (partition by page, key order by p_partkey desc) = 1)
select page, key, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as name, price, case when p_partkey % 3 = 0 then round(price + 2.5e0, 2) end as regular, case when p_partkey % 4 < 2 then p_size || ' g' end as size from l"""


def json_tree_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products at any depth of JSON trees: orders as nested documents, some products with other names for name and price."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"])
    price = F.round(F.col("l_extendedprice")).cast("long")
    blank = F.lit(None).cast("string")
    odd = F.col("l_linenumber") % 2 == 1
    product = F.struct(
        F.when(odd, F.col("p_name")).otherwise(blank).alias("name"), F.when(~odd, F.col("p_name")).otherwise(blank).alias("title"), F.when(odd, price).alias("price"), F.when(~odd & (F.col("l_linenumber") != 4), price.cast("string")).alias("offerPrice"),
        F.struct(F.col("p_brand").alias("name"), F.array(F.col("p_type")).alias("tags")).alias("brand"),
    )
    deep = F.struct(F.struct(F.array(F.struct(product.alias("item"))).alias("list")).alias("more"))
    docs = rows.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") < 4, product)).alias("products"), F.collect_list(F.when(F.col("l_linenumber") >= 4, deep)).alias("blocks"))
    found = landed.json_products(docs.select("l_orderkey", F.to_json(F.struct(F.struct("products").alias("data"), "blocks")).alias("j")), "l_orderkey", "j")
    return found.groupBy("l_orderkey", "name", F.col("price").cast("long").alias("price")).agg(F.count("*").alias("n"))


JSON_TREE_ORDERS = """
select l_orderkey, p_name as name, cast(round(l_extendedprice) as bigint) as price, count(*) as n from lineitem join part on l_partkey = p_partkey where l_linenumber <> 4 group by all"""

_KEYS = [["number"], ["canonical"], ["priority", "cents"]]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 100).alias("store"), F.when(k % 3 != 1, k % 17).alias("number"), F.when(k % 5 < 3, F.col("o_custkey") % 11).alias("canonical"),
        F.when(k % 7 != 2, F.col("o_orderpriority")).alias("priority"), F.floor(F.col("o_totalprice") / 50000).cast("long").alias("cents"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
    )


def orders_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth order put to the others by falling keys: it replaces what was pending or is dearer."""
    o = _orders(spark, sf_dir)
    replace = (F.col("old.status") == "P") | (F.col("new.price") < F.col("old.price"))
    return upserted(o.where("id % 4 <> 0"), o.where("id % 4 = 0"), ["store"], _KEYS, "id", replace).select("id", "fate", "target")


ORDERS_UPSERTED = """
with o as (select o_orderkey as id, o_custkey % 100 as store, case when o_orderkey % 3 <> 1 then o_orderkey % 17 end as number, case when o_orderkey % 5 < 3 then o_custkey % 11 end as canonical,
    case when o_orderkey % 7 <> 2 then o_orderpriority || '|' || cast(floor(o_totalprice / 50000) as bigint) end as named, o_orderstatus as status, o_totalprice as price from orders),
c as (select *, row_number() over (partition by store, coalesce('0:' || number, '1:' || canonical, '2:' || named, 'id:' || id) order by id) = 1 as alone from o where id % 4 = 0),
m as (select c.id as new_id, b.id as old_id, case when c.number is not null and b.number is not null then 0 when c.canonical is not null and b.canonical is not null then 1 else 2 end as first,
    b.status = 'P' or c.price < b.price as ok, c.number = b.number as e0, c.canonical = b.canonical as e1, c.named = b.named as e2
    from c join o b on b.store = c.store and b.id % 4 <> 0 where c.alone),
f as (select *, case when e0 then 0 when e1 then 1 when e2 then 2 end as rank from m where case first when 0 then e0 when 1 then e1 else e2 end),
t as (select * from f qualify row_number() over (partition by new_id order by rank, old_id) = 1),
w as (select *, ok and row_number() over (partition by old_id order by new_id) = 1 as acts from t)
select c.id, case when not c.alone then 'ignored' when w.old_id is null then 'inserted' when w.acts then 'replacing' else 'ignored' end as fate, case when w.acts then w.old_id end as target from c left join w on w.new_id = c.id
union all select o.id, case when w.acts then 'replaced' else 'kept' end, null from o left join w on w.old_id = o.id and w.acts where o.id % 4 <> 0"""


def flyers_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flyer that holds each line item's day, or the last before it; labels that name another range are refused."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    day = F.to_date("o_orderdate")
    flyers = o.where("o_orderkey % 20 = 3").select(F.col("o_orderkey").alias("flyer"), (F.col("o_custkey") % 6).alias("store"), day.alias("begins"), F.date_add(day, (F.col("o_orderkey") % 11).cast("int")).alias("ends"))
    own = F.to_date("l_shipdate")
    rows = li.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 6).alias("store"), own.alias("day"), F.date_sub(own, F.col("l_linenumber") - 1).alias("says_from"), F.date_add(own, 7 - F.col("l_linenumber")).alias("says_to"))
    out = intervals.labelled(intervals.range_of(rows, "day", flyers, ["store"], "flyer", "begins", "ends"), "says_from", "says_to")
    return out.select("l_orderkey", "l_linenumber", F.col("range_id").alias("flyer"), "current", "accepted")


FLYERS_BY_DAY = """
with f as (select o_orderkey as flyer, o_custkey % 6 as store, cast(o_orderdate as date) as b, cast(o_orderdate as date) + cast(o_orderkey % 11 as integer) as e from orders where o_orderkey % 20 = 3),
l as (select l_orderkey, l_linenumber, l_suppkey % 6 as store, cast(l_shipdate as date) as day from lineitem),
d as (select distinct store, day from l),
h as (select d.store, d.day, max({'b': b, 'e': e, 'flyer': flyer}) as x from d join f on f.store = d.store and d.day between b and e group by all),
p as (select d.store, d.day, max({'e': e, 'b': b, 'flyer': flyer}) as x from d join f on f.store = d.store and e < d.day group by all)
select l_orderkey, l_linenumber, coalesce(h.x.flyer, p.x.flyer) as flyer, h.x is not null as current, coalesce(h.x.b = l.day - (l_linenumber - 1) and h.x.e = l.day + (7 - l_linenumber), false) as accepted
from l left join h on h.store = l.store and h.day = l.day left join p on p.store = l.store and p.day = l.day"""


def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two passes over all line items as offers count while the rows that they leave are written: one job."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    n, price, amount = F.col("l_linenumber"), F.col("l_extendedprice") / 500, F.col("p_size") / 10
    unit = F.when(n % 3 == 0, price / amount).when(n % 3 == 1, amount)
    offers = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.when(n != 5, F.col("p_name")).alias("name"), F.concat(F.lit("S"), (F.col("l_suppkey") % 9).cast("string")).alias("store"), price.alias("price"), unit.alias("unit"), amount.alias("amount"), F.when(n % 2 == 0, "€/Packung").otherwise("€/kg").alias("label"))

    def swaps(df: DataFrame) -> DataFrame:
        new_price, new_unit, swapped = quality.swapped_repair(F.col("price"), F.col("unit"), F.col("amount"))
        return df.withColumns({"price": new_price, "unit": new_unit, "repaired": swapped.cast("int")})

    def units(df: DataFrame) -> DataFrame:
        new = quality.derived_unit(F.col("price"), F.col("unit"), F.col("label"), F.col("amount"), F.lit("€/kg"))
        return df.withColumns({"unit": new, "repaired": (~new.eqNullSafe(F.col("unit"))).cast("int")})

    passes = [
        ("prices", swaps, quality.offer_checks(F.col("name"), F.col("store"), F.col("price"), F.col("unit"))),
        ("units", units, [("no_unit", F.col("unit").isNull()), ("unit_too_high", F.col("unit") > 100)]),
    ]
    left, found = quality.observed_passes(offers, passes)
    left.write.format("noop").mode("overwrite").save()
    rows = [(name, reason, found[name].get.get(reason)) for name, _, checks in passes for reason in ("before", "after", "rejected", "repaired", *dict.fromkeys(r for r, _ in checks))]
    return spark.createDataFrame(rows, "pass string, counter string, n long")


QUALITY_COUNTERS = """
with o as (select l_linenumber as n, case when l_linenumber <> 5 then p_name end as name, l_extendedprice / 500 as price, p_size / 10e0 as amount, case when l_linenumber % 3 = 0 then l_extendedprice / 500 / (p_size / 10e0) when l_linenumber % 3 = 1 then p_size / 10e0 end as unit from lineitem join part on l_partkey = p_partkey),
s as (select *, coalesce(abs(unit - amount) <= greatest(0.015e0, 0.06e0 * amount) and price > 0.3e0 and amount > 0, false) as sw from o),
a as (select n, name, amount, sw, case when sw then price * amount else price end as price, case when sw then price else unit end as unit from s),
r as (select *, case when name is null or length(trim(name)) < 3 then 'missing_name' when length(name) > 140 then 'name_too_long' when not regexp_matches(name, '[a-zA-Z]{3,}') then 'name_without_letters'
    when price is null or price <= 0.05 then 'invalid_price' when price > 150 then 'price_too_high' when unit <= 0 then 'invalid_unit_price' when unit > 800 then 'unit_price_too_high' end as reason from a),
b as (select *, round(price / nullif(amount, 0), 3) as own from r where reason is null),
u as (select *, case when own is not null and (unit is null or n % 2 = 0 or abs(unit - own) > 0.08e0 * own) then own else unit end as nu from b),
v as (select *, case when nu is null then 'no_unit' when nu > 100 then 'unit_too_high' end as why from u)
select 'prices' as pass, unnest(['before', 'after', 'rejected', 'repaired', 'missing_name', 'name_too_long', 'name_without_letters', 'missing_store', 'invalid_price', 'price_too_high', 'invalid_unit_price', 'unit_price_too_high']) as counter,
    unnest([count(*), count(*) filter (reason is null), count(reason), count(*) filter (sw), count(*) filter (reason = 'missing_name'), count(*) filter (reason = 'name_too_long'), count(*) filter (reason = 'name_without_letters'), 0,
    count(*) filter (reason = 'invalid_price'), count(*) filter (reason = 'price_too_high'), count(*) filter (reason = 'invalid_unit_price'), count(*) filter (reason = 'unit_price_too_high')]) as n from r
union all select 'units', unnest(['before', 'after', 'rejected', 'repaired', 'no_unit', 'unit_too_high']), unnest([count(*), count(*) filter (why is null), count(why), count(*) filter (nu is distinct from unit), count(*) filter (why = 'no_unit'), count(*) filter (why = 'unit_too_high')]) from v"""

QUERIES = {
    "page_links": (page_links, None),
    "tiles_mapped": (tiles_mapped, TILES_MAPPED),
    "json_tree_orders": (json_tree_orders, JSON_TREE_ORDERS),
    "orders_upserted": (orders_upserted, ORDERS_UPSERTED),
    "flyers_by_day": (flyers_by_day, FLYERS_BY_DAY),
    "quality_counters": (quality_counters, QUALITY_COUNTERS),
}
