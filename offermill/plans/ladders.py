"""Queries on price ladders, decision lists, sizes that are ranges, and the orders and modes of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.functions import money
from offermill.functions.rules import Rule, decided
from offermill.operators import ladders, market, staples
from offermill.sources.tables import read, spread


def _euro(c: Column) -> Column:
    return F.concat(F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of text for each order; every line item is a line in one of seven forms, some of which hold two prices."""
    cents = F.col("l_partkey") * 37 % 60000 + 3
    now, before = _euro(cents), _euro(cents + 150)
    lines = [
        [F.lit("App-Preis von "), now, F.lit(" €")], [F.lit("Aktionspreis "), now, F.lit(" €")], [F.lit("heute nur "), now], [now, F.lit(" €")],
        [F.lit("statt "), before, F.lit(" € jetzt "), now], [F.col("p_name"), F.lit(" ab "), now, F.lit(" €")], [F.lit("UVP "), before, F.lit(" €, nur "), now],
    ]
    line = F.element_at(F.array(*(F.concat(*x) for x in lines)), F.col("l_linenumber"))
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = spread(rows.select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line")), "l_orderkey", times=4)
    block = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "line")))
    return rows.groupBy("l_orderkey").agg(F.array_join(block["line"], "\n").alias("text"))


def price_forms_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price of the blocks, with its form and place."""
    found = ladders.price_forms(order_blocks(spark, sf_dir), "l_orderkey", "text")
    return found.select("l_orderkey", "kind", "begins", "ends", F.col("price").cast("double").alias("price"), F.col("regular").cast("double").alias("regular"))


_FORMS = """
with x as (select l_orderkey, l_linenumber as n, l_partkey as pk, p_name, l_partkey * 37 % 60000 + 3 as c from lineitem join part on l_partkey = p_partkey),
e as (select *, c // 100 || ',' || lpad(cast(c % 100 as varchar), 2, '0') as a, (c + 150) // 100 || ',' || lpad(cast((c + 150) % 100 as varchar), 2, '0') as b from x),
l as (select *, case n when 1 then 'App-Preis von ' || a || ' €' when 2 then 'Aktionspreis ' || a || ' €' when 3 then 'heute nur ' || a when 4 then a || ' €' when 5 then 'statt ' || b || ' € jetzt ' || a when 6 then p_name || ' ab ' || a || ' €' else 'UVP ' || b || ' €, nur ' || a end as line from e),
p as (select *, coalesce(sum(length(line) + 1) over (partition by l_orderkey order by n, pk rows between unbounded preceding and 1 preceding), 0) as pos from l),
f as (select l_orderkey, case n when 1 then 'app' when 2 then 'fixed' when 3 then 'only' when 4 then 'line' when 5 then 'reduced' when 6 then 'euro' else 'only' end as kind,
    cast(pos + case n when 3 then 6 when 6 then length(p_name) + 4 when 7 then 8 + length(b) else 0 end as bigint) as begins, cast(pos + length(line) as bigint) as ends, c / 100e0 as price, case when n = 5 then (c + 150) / 100e0 end as regular from p
    union all select l_orderkey, 'euro', cast(pos + 4 as bigint), cast(pos + 6 + length(b) as bigint), (c + 150) / 100e0, null from p where n = 7)"""
PRICE_FORMS_ORDERS = _FORMS + " select * from f"


def price_ladder_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price that counts in each block, the regular one, and whether it holds in the app only."""
    found = ladders.price_forms(order_blocks(spark, sf_dir), "l_orderkey", "text")
    out = ladders.counted_price(found, "l_orderkey")
    return out.select("l_orderkey", "kind", F.col("price").cast("double").alias("price"), F.col("regular").cast("double").alias("regular"), "app", "prices")


PRICE_LADDER_ORDERS = _FORMS + """,
r as (select *, row_number() over (partition by l_orderkey order by list_position(['app', 'fixed', 'only', 'line', 'reduced', 'euro'], kind), begins) as place from f where price > 0.05 and price < 500),
a as (select l_orderkey, max(regular) as before, count(*) as prices from f group by 1)
select l_orderkey, kind, price, coalesce(case when regular > price then regular end, case when before > price then before end) as regular, kind = 'app' as app, prices from r join a using (l_orderkey) where place = 1"""


def priced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their whole texts with a line of two prices in the middle."""
    n, half = F.col("doc_id") % 600, F.expr("cast(char_length(text) div 2 as int)")
    line = F.concat(F.lit("statt "), (n + 1).cast("string"), F.lit(",99 € nur "), n.cast("string"), F.lit(",49"))
    text = F.concat_ws("\n", F.substring("text", F.lit(1), half), line, F.substring("text", half + 1, F.char_length("text")))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def document_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price in the whole texts of all documents, and in a line that each is given."""
    found = ladders.price_forms(priced_documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", "kind", "begins", "ends", F.col("price").cast("double").alias("price"), F.col("regular").cast("double").alias("regular"))


def range_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as ranges: the larger end counts, in kg, l or pieces."""
    k, low = F.col("p_partkey"), F.col("p_size") * 5
    ends = F.when(k % 4 == 0, low.cast("string")).when(k % 4 == 1, F.concat(low.cast("string"), F.lit("-"), (low + 50).cast("string"))).when(k % 4 == 2, F.concat(low.cast("string"), F.lit(",5 – "), (low + 1).cast("string"), F.lit(",5"))).otherwise(F.concat((low + 20).cast("string"), F.lit(" - "), low.cast("string")))
    unit = F.element_at(F.array(*map(F.lit, (" g", "ml", " Stück"))), (k % 3 + 1).cast("int"))
    size = F.concat(F.initcap("p_name"), F.lit(" ca. "), ends, unit)
    return read(spark, sf_dir, "part").select("p_partkey", money.larger_quantity(size).cast("double").alias("amount"), money.unit_label(size).alias("label"))


RANGE_SIZES = """
select p_partkey, case p_partkey % 4 when 0 then p_size * 5e0 when 1 then p_size * 5e0 + 50 when 2 then p_size * 5e0 + 1.5e0 else p_size * 5e0 + 20 end / case when p_partkey % 3 < 2 then 1000e0 else 1e0 end as amount,
    case p_partkey % 3 when 0 then '€/kg' when 1 then '€/l' else '€/Stk.' end as label from part"""

ADJECTIVES, NOUNS = ("small", "red", "large", "hot", "old", "blue", "new", "cold"), ("ring", "bolt", "gear", "gizmo", "anvil", "widget", "plate", "rod")


def goods_rules() -> list[Rule]:
    """A rule for every pair of words, with vetoes, cases, templates and scopes by their places; then one for each noun, the last of them without a veto."""
    pairs = [
        Rule(
            rf"\b{a} {n}\b", product=None if j % 3 == 0 else f"{n} {{color}} {{size}}", kind=f"{n}s", veto=r"\bpromo\b" if i % 2 == 0 else None, scope="brand#1" if j == 4 else None,
            cases=(Rule("large|medium", f"{n} XL {{size}}", confidence=0.95), Rule("economy", f"{n} basic", kind="basics", veto="hot|old")),
        )
        for i, a in enumerate(ADJECTIVES) for j, n in enumerate(NOUNS)
    ]
    return pairs + [Rule(rf"\b{n}\b", f"any {n} {{unknown}}", kind=f"{n}s", confidence=0.6, veto="standard" if j < 7 else None) for j, n in enumerate(NOUNS)]


def goods_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list of some two hundred leaves says of every product."""
    told = {"size": F.col("p_size"), "color": F.when(F.col("p_size") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(1)))}
    d = decided(F.concat_ws(" ", "p_name", "p_type"), goods_rules(), F.col("p_brand"), told).alias("d")
    return read(spark, sf_dir, "part").select("p_partkey", d).select("p_partkey", F.col("d.kind").alias("kind"), F.col("d.product").alias("product"), F.col("d.confidence").alias("confidence"))


GOODS_DECIDED = f"""
with w as (select *, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as n, lower(p_type) as t, lower(p_brand) as brand from part),
x as (select *, list_position({list(ADJECTIVES)}, a) - 1 as i, list_position({list(NOUNS)}, n) - 1 as j from w),
g as (select *, not (i % 2 = 0 and t = 'promo') and (j <> 4 or starts_with(brand, 'brand#1')) as held, t in ('large', 'medium') or a = 'large' as big, t = 'economy' and a not in ('hot', 'old', 'cold') as basic from x),
s as (select *, case when held and big then 'xl' when held and basic then 'basic' when held and j % 3 <> 0 then 'own' when j = 7 or t <> 'standard' then 'any' end as leaf from g)
select p_partkey, case leaf when 'basic' then 'basics' when 'xl' then n || 's' when 'own' then n || 's' when 'any' then n || 's' end as kind,
    case leaf when 'xl' then n || ' XL ' || p_size when 'basic' then n || ' basic' when 'own' then n || case when p_size % 2 = 0 then ' ' || a else '' end || ' ' || p_size when 'any' then 'any ' || n end as product,
    case leaf when 'xl' then 0.95e0 when 'basic' then 0.9e0 when 'own' then 0.9e0 when 'any' then 0.6e0 end as confidence from s"""


def list_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every product in each order that a list can be shown in."""
    k = F.col("p_partkey")
    price = F.when(k % 9 != 5, F.round(F.col("p_retailprice") * 100).cast("long"))
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 13 != 7, F.col("p_name")).alias("name"), price.alias("price"), F.when(k % 7 != 2, F.floor(price / F.col("p_size"))).alias("unit"),
        F.when(k % 3 == 0, (k % 40).cast("int")).alias("saving"), F.when(k % 5 != 1, F.col("p_size") % 2 == 0).alias("organic"), (k % 4 == 0).alias("offer"),
    )
    placed = [staples.numbered(rows, staples.view_order(s, k), "place").select(F.lit(s).alias("sort"), "p_partkey", F.col("place").cast("long").alias("place")) for s in staples.SORTS]
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


LIST_SORTS = """
with r as (select p_partkey as k, case when p_partkey % 13 <> 7 then p_name end as name, case when p_partkey % 9 <> 5 then cast(round(p_retailprice * 100) as bigint) end as price, p_size, p_partkey % 3 = 0 as saves,
    p_partkey % 40 as save, coalesce(p_partkey % 5 <> 1 and p_size % 2 = 0, false) as organic, p_partkey % 4 = 0 as offer from part),
u as (select *, case when k % 7 <> 2 then price // p_size end as unit, case when saves then save else 0 end as saving from r)
select 'price' as sort, k as p_partkey, row_number() over (order by price nulls last, k) as place from u
union all select 'unit', k, row_number() over (order by unit nulls last, k) from u
union all select 'saving', k, row_number() over (order by saving desc, price nulls last, k) from u
union all select 'name', k, row_number() over (order by coalesce(name, ''), k) from u
union all select 'smart', k, row_number() over (order by organic desc, offer desc, saving desc, unit nulls last, k) from u"""


def staple_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode and search of a page of staples shows: brands as staples, their cheapest product on shelf as the best."""
    p = read(spark, sf_dir, "part")
    best = F.min(F.when(F.col("p_size") > 40, F.struct(F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("k"), F.initcap("p_name").alias("name"))))
    results = p.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("name")).agg(best.alias("b")).select("name", F.col("b.name").alias("best_name"), (F.col("b.k") % 2 == 0).alias("best_offer"))
    out = [staples.shown(results, term, mode).select(F.lit(mode).alias("mode"), F.lit(term).alias("term"), "name") for mode in ("all", "offer", "missing") for term in ("", " RING ", "promo")]
    shown = out[0]
    for o in out[1:]:
        shown = shown.unionByName(o)
    return shown


STAPLE_MODES = """
with r as (select p_brand || ' ' || p_type as name, min({'price': p_retailprice, 'k': p_partkey, 'name': p_name}) filter (p_size > 40) as b from part group by 1),
m as (select * from r, (select unnest(['all', 'offer', 'missing']) as mode), (select unnest(['', ' RING ', 'promo']) as term))
select mode, term, name from m where (mode = 'all' or mode = 'offer' and b is not null and b.k % 2 = 0 or mode = 'missing' and b is null) and (contains(lower(name), lower(trim(term))) or contains(coalesce(b.name, ''), lower(trim(term))))"""


def counts_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by status, flag and year, in one pass; some have no flag."""
    rows = read(spark, sf_dir, "lineitem").select("l_linestatus", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("flag"), F.year("l_shipdate").alias("year"))
    return market.counts_by(rows, ["l_linestatus", "flag", "year"])


COUNTS_BY_COLUMN = """
select 'l_linestatus' as "column", l_linestatus as value, count(*) as n from lineitem group by all
union all select 'flag', case when l_linenumber <> 3 then l_returnflag end as value, count(*) from lineitem group by all
union all select 'year', cast(year(l_shipdate) as varchar) as value, count(*) from lineitem group by all"""

QUERIES = {
    "price_forms_orders": (price_forms_orders, PRICE_FORMS_ORDERS),
    "price_ladder_orders": (price_ladder_orders, PRICE_LADDER_ORDERS),
    "document_prices": (document_prices, None),
    "range_sizes": (range_sizes, RANGE_SIZES),
    "goods_decided": (goods_decided, GOODS_DECIDED),
    "list_sorts": (list_sorts, LIST_SORTS),
    "staple_modes": (staple_modes, STAPLE_MODES),
    "counts_by_column": (counts_by_column, COUNTS_BY_COLUMN),
}
