"""Queries on duplicates: products are records, their type the store, and a third of their keys the branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.operators import catalogs
from offermill.sources.tables import kept, read


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_type").alias("store"), F.concat(F.lit("B"), (k % 3).cast("string")).alias("market"), F.concat(F.lit("Angebot "), F.initcap("p_name")).alias("name"),
        F.when(k % 3 > 0, F.col("p_brand")).alias("brand"), F.concat((F.col("p_size") % 9).cast("string"), F.lit(" Gramm")).alias("size"), F.when(k % 4 == 0, F.concat(F.lit("g"), (k % 5).cast("string"))).alias("gtin"),
        F.when(k % 10 == 3, F.array(F.concat(F.lit("s"), (k % 40).cast("string")))).alias("source_ids"), F.lit(None).cast("string").alias("family"), (k % 7 == 0).alias("organic"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("price"), (k % 2 == 0).alias("is_offer"), F.when(k % 6 == 0, F.round(F.col("p_retailprice") * 100).cast("long") + 500).alias("regular"),
        F.when(k % 2 == 0, "official_offer").otherwise("official_catalog").alias("source_type"), F.lit(None).cast("string").alias("image"),
    )


RECORDS = """
d as (select p_partkey as id, p_type as store, 'B' || p_partkey % 3 as market, p_name as nm, coalesce(case when p_partkey % 3 > 0 then p_brand end, '') as brand, p_size % 9 as sz, case when p_partkey % 4 = 0 then 'g' || p_partkey % 5 end as gtin,
case when p_partkey % 10 = 3 then 's' || p_partkey % 40 end as source_id, p_partkey % 7 = 0 as organic, cast(round(p_retailprice * 100) as bigint) as price, p_partkey % 2 = 0 as is_offer from part)"""


def _clusters(name: str, scope: str) -> str:
    """Every pair of records of a place by the rule, and what chains of them reach."""
    return f"""
{name}e as (select a.id as a, b.id as b from d a join d b on {scope} and a.id <> b.id and a.organic = b.organic and a.sz = b.sz
and (a.gtin = b.gtin or a.source_id = b.source_id or a.brand = b.brand)
and case when a.gtin is not null and b.gtin is not null then a.gtin = b.gtin when a.source_id = b.source_id then true when a.brand <> '' and b.brand <> '' and a.brand <> b.brand then false else a.nm = b.nm end),
{name}r(id, c) as (select id, id from d union select e.b, r.c from {name}r r join {name}e e on e.a = r.id),
{name} as (select id, min(c) as cluster from {name}r group by id)"""


def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each record within its branch, and for display within its store."""
    r = records(spark, sf_dir)
    branch = catalogs.clustered(r, "id", ["store", "market"], kept).select("id", F.col("cluster").alias("branch_cluster"))
    return branch.join(catalogs.clustered(r, "id", ["store"], kept).select("id", F.col("cluster").alias("store_cluster")), "id")


DUPLICATE_CLUSTERS = f"with recursive {RECORDS}, {_clusters('x', 'a.store = b.store and a.market = b.market')}, {_clusters('y', 'a.store = b.store')} select x.id, x.cluster as branch_cluster, y.cluster as store_cluster from x join y on x.id = y.id"


def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return catalogs.duplicate_audit(catalogs.clustered(r, "id", ["store", "market"], kept), catalogs.clustered(r, "id", ["store"], kept))


DUPLICATE_AUDIT = f"""select count(*) as input_count, count(distinct branch_cluster) as branch_unique, count(distinct store_cluster) as display_unique, count(*) - count(distinct branch_cluster) as branch_duplicates,
greatest(0, count(distinct branch_cluster) - count(distinct store_cluster)) as cross_branch from ({DUPLICATE_CLUSTERS}) c"""


def duplicates_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products for display: the clusters of a store, merged."""
    c = catalogs.clustered(records(spark, sf_dir), "id", ["store"], kept)
    out = catalogs.merged_records(c, ["cluster"], "id", ["market"])
    return out.select("cluster", F.lower("name").alias("name"), F.coalesce("brand", F.lit("")).alias("brand"), "gtin", "price", "regular_price", "offer_price", "market", F.array_join("source_types", ",").alias("source_types"), "branch_count", "merged_from")


DUPLICATES_MERGED = f"""with recursive {RECORDS}, {_clusters('y', 'a.store = b.store')},
m as (select d.*, y.cluster, case when d.id % 6 = 0 then price + 500 end as regular, case when is_offer then 'official_offer' else 'official_catalog' end as source_type,
case when is_offer then 40 else 0 end + case when gtin is not null then 12 else 0 end + case when brand <> '' then 4 else 0 end + case when is_offer then 8 else 5 end + least(8, (1 + len(string_split(nm, ' '))) / 2.0) as worth from d join y on d.id = y.id),
b as (select cluster, nm, brand from (select *, row_number() over (partition by cluster order by worth desc, id) as place from m) r where place = 1),
o as (select cluster, price as offer_price, market as offer_market from (select *, row_number() over (partition by cluster order by price, id) as place from m where is_offer) r where place = 1),
p as (select cluster, price as least, market as least_market from (select *, row_number() over (partition by cluster order by price, id) as place from m) r where place = 1),
g as (select cluster, max(gtin) as gtin, max(greatest(coalesce(regular, 0), case when not is_offer then price else 0 end)) as top, string_agg(distinct source_type, ',' order by source_type) as source_types, count(distinct market) as branch_count, count(*) as merged_from from m group by 1)
select g.cluster, 'angebot ' || nm as name, brand, gtin, coalesce(offer_price, least) as price, case when top >= coalesce(offer_price, least) then top when offer_price is null then least end as regular_price, offer_price,
coalesce(offer_market, least_market) as market, source_types, branch_count, merged_from from g join b on b.cluster = g.cluster join p on p.cluster = g.cluster left join o on o.cluster = g.cluster"""


def unit_prices_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without those priced by the package of which another of the name has a unit price."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 40 == 1, "€/kg").when(F.col("p_partkey") % 5 == 2, "€/Stk.").otherwise("€/Packung").alias("label"))
    return catalogs.unit_priced_preferred(rows, "p_name", "label")


UNIT_PRICES_PREFERRED = """
with r as (select p_partkey, p_name, case when p_partkey % 40 = 1 then '€/kg' when p_partkey % 5 = 2 then '€/Stk.' else '€/Packung' end as label from part)
select * from r where label <> '€/Packung' or lower(p_name) not in (select lower(p_name) from r where label in ('€/kg', '€/l'))"""


def bulk_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").withColumn("cents", F.round(F.col("p_retailprice") * 100).cast("long"))
    return catalogs.bulk_prices(rows, ["p_name", "p_size"], "cents")


BULK_PRICES = "select p_name, p_size, max(c) as main_price, case when min(c) < max(c) then min(c) end as bulk_price, count(*) as n from (select *, cast(round(p_retailprice * 100) as bigint) as c from part) p group by 1, 2"


def catalog_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, (k % 50).cast("string")).alias("ean"), "p_brand", "p_name", F.when(k % 2 == 0, F.col("p_size").cast("string")).alias("size"))
    return catalogs.catalog_unique(rows, "ean", "p_brand", F.col("p_name"), F.col("size"), [F.asc("p_partkey")])


CATALOG_UNIQUE = """
with r as (select p_partkey, case when p_partkey % 3 = 0 then cast(p_partkey % 50 as varchar) end as ean, p_brand, p_name, case when p_partkey % 2 = 0 then cast(p_size as varchar) end as size from part)
select p_partkey, ean, p_brand, p_name, size from (select *, row_number() over (partition by coalesce('ean:' || ean, p_brand || '|' || p_name || '|' || coalesce(size, '')) order by p_partkey) as place from r) x where place = 1"""

QUERIES = {
    "duplicate_clusters": (duplicate_clusters, DUPLICATE_CLUSTERS),
    "duplicate_audit": (duplicate_audit, DUPLICATE_AUDIT),
    "duplicates_merged": (duplicates_merged, DUPLICATES_MERGED),
    "unit_prices_preferred": (unit_prices_preferred, UNIT_PRICES_PREFERRED),
    "bulk_prices": (bulk_prices, BULK_PRICES),
    "catalog_unique": (catalog_unique, CATALOG_UNIQUE),
}


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with names of more or fewer words: of name, type and brand, so that some hold others."""
    k = F.col("p_partkey")
    words = F.concat_ws(" ", F.when(k % 5 == 4, F.lit("HiPP")), "p_name", F.when(k % 3 > 0, F.lower("p_type")), F.when(k % 3 > 1, F.col("p_brand")), F.when(k % 7 == 0, F.lit("neu")))
    return read(spark, sf_dir, "part").select("p_partkey", words.alias("name"), (F.col("p_size") % 4).alias("size"), (k % 2 == 0).alias("app"), "p_retailprice")


def names_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which products a pass by price keeps, if it drops names that hold or are held by kept ones."""
    from offermill.operators.greedy import without_contained

    return without_contained(_offers(spark, sf_dir), "p_partkey", "name", ["size", "app"], "p_retailprice", kept).select("p_partkey", "name", "kept")


def varied_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with families, canonical ids, longer names and fewer brands, so that names alike but not equal decide."""
    k, r = F.col("id"), records(spark, sf_dir)
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_name", "p_size")
    more = F.concat_ws(" ", "p_name", F.lower("p_type"), F.when(k % 3 == 0, F.lit("neue sorte")), F.when(k % 4 == 0, F.lit("mild")), F.when(k % 11 == 0, F.lit("3,5 %")))
    return r.drop("name", "family", "size", "brand").join(p, "id").select(
        *(c for c in r.columns if c not in ("name", "family", "size", "brand")), more.alias("name"), F.when(k % 5 < 2, F.concat(F.lit("f"), (F.col("p_size") % 3).cast("string"))).alias("family"),
        F.when(k % 6 != 5, F.concat((F.col("p_size") % 4).cast("string"), F.lit(" g"))).alias("size"), F.when(k % 4 == 1, F.concat(F.lit("marke"), (F.col("p_size") % 2).cast("string"))).alias("brand"),
        F.when(k % 13 == 0, F.concat(F.lit("c"), (F.col("p_size") % 7).cast("string"))).when(k % 13 == 1, F.lit("gtin-1")).alias("canonical_id"),
    )


def duplicates_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products that a pass over the records in order leaves within each store."""
    from offermill.operators.greedy import merged_in_order

    out = merged_in_order(varied_records(spark, sf_dir), "id", ["store"], kept)
    return out.withColumn("source_types", F.array_join("source_types", ","))


QUERIES |= {"names_contained": (names_contained, None), "duplicates_in_order": (duplicates_in_order, None)}
