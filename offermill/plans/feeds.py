"""Queries on landed answers, made of the tables: orders are pages of an API, documents texts with prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.operators import market
from offermill.sources import feeds, landed
from offermill.sources.tables import read


def paged_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each supplier as pages of 50 products, of which 8 are asked for at most."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.pmod(F.col("l_orderkey"), F.lit(20)) + 1).alias("page")).agg(F.array_sort(F.collect_list(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("products"))
    out = feeds.paged(rows.withColumn("total", F.lit(50) * (F.pmod(F.col("l_suppkey"), F.lit(12)) + 1)), "l_suppkey", "page", "products", F.col("total"), 50, 8)
    return out.select("l_suppkey", "page", "place", "product")


PAGED_PRODUCTS = """
with r as (select l_suppkey, l_orderkey % 20 + 1 as page, l_orderkey * 10 + l_linenumber as product from lineitem),
f as (select distinct l_suppkey from r where page = 1)
select l_suppkey, page, cast(row_number() over (partition by l_suppkey, page order by product) - 1 as int) as place, product from r where l_suppkey in (select l_suppkey from f) and page <= least(l_suppkey % 12 + 1, 8)"""


def pages_until_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders of a customer as pages: those before the third empty one in a row."""
    c = F.col("c_custkey")
    pages = read(spark, sf_dir, "customer").select(c, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page")).withColumn("n", F.pmod(c * F.col("page"), F.lit(7)) * (F.pmod(F.col("page"), F.lit(5)) > 1).cast("int") * F.pmod(c, F.lit(3)))
    return feeds.until_empty(pages, "c_custkey", "page", "n", streak=2, most=11).select("c_custkey", "page", "n")


PAGES_UNTIL_EMPTY = """
with p as (select c_custkey, page, (c_custkey * page % 7) * (case when page % 5 > 1 then 1 else 0 end) * (c_custkey % 3) as n from customer, range(1, 12) t(page)),
e as (select *, n = 0 and lag(n) over (partition by c_custkey order by page) = 0 as ends from p),
s as (select c_custkey, min(page) as stop from e where ends group by 1)
select p.c_custkey, p.page, p.n from p left join s on p.c_custkey = s.c_custkey where p.page <= coalesce(stop, 99)"""


def price_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of unit prices with at most 2000 lines each, by halving."""
    prices = read(spark, sf_dir, "lineitem").select((F.round("l_extendedprice") / 100).alias("price"))
    return feeds.price_windows(prices, "price", 0.0, 2000.0, most=2000)


def better_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one year in place of those of the year before, where a customer has five or more, or more than before."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    return feeds.better_slice(o.where("y = 1996"), o.where("y = 1997"), "o_custkey", least=5).select("o_orderkey", "o_custkey", "y")


BETTER_SLICES = """
with o as (select o_orderkey, o_custkey, extract(year from o_orderdate) as y from orders), c as (select o_custkey, count(*) filter (where y = 1997) as n, count(*) filter (where y = 1996) as b from o group by 1),
t as (select o_custkey from c where n > 0 and (n >= 5 or n > b))
select o_orderkey, o_custkey, y from o where (y = 1996 and o_custkey not in (select o_custkey from t)) or (y = 1997 and o_custkey in (select o_custkey from t))"""


def guarded_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of 1997 by priority and customer group, but those of 1996 where too few are left; what is kept is marked."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("-", "o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("store"), F.year("o_orderdate").alias("y"))
    return market.guarded(o.where("y = 1996"), o.where("y = 1997"), "store")


GUARDED_SLICES = """
with o as (select o_orderkey, o_orderpriority || '-' || cast(o_custkey % 40 as varchar) as store, extract(year from o_orderdate) as y from orders),
k as (select store from o group by 1 having count(*) filter (where y = 1996) >= 5 and count(*) filter (where y = 1997) < 0.7 * count(*) filter (where y = 1996))
select store, o_orderkey, y, false as stale_retained from o where y = 1997 and store not in (select store from k) union all select store, o_orderkey, y, true from o where y = 1996 and store in (select store from k)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidate lines and priced lines with a name each document has."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    some = landed.markdown_candidates(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("candidates"))
    priced = feeds.priced_lines(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("priced"), F.min("price").alias("least"))
    return docs.select("doc_id").join(some, "doc_id", "left").join(priced, "doc_id", "left").select("doc_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("priced", F.lit(0)).alias("priced"), "least")


def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of class "ad" of every page."""
    return feeds.cards(read(spark, sf_dir, "pages"), "page_id", "html", "ad")


QUERIES = {
    "paged_products": (paged_products, PAGED_PRODUCTS),
    "pages_until_empty": (pages_until_empty, PAGES_UNTIL_EMPTY),
    "price_windows": (price_windows, None),
    "better_slices": (better_slices, BETTER_SLICES),
    "guarded_slices": (guarded_slices, GUARDED_SLICES),
    "document_lines": (document_lines, None),
    "page_cards": (page_cards, None),
}
