"""Queries on offers as one shape: part is the product, its offers are the cheapest line of each product and store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.functions import attributes, text
from offermill.operators import offers as op
from offermill.operators import staples
from offermill.plans.catalog import _FOLD
from offermill.sources.tables import read, spread

#: Kinds of the products that the tables name.
KINDS = (
    {"pattern": "widget", "kind": "Widget", "group": "Widgets", "product": "Widget", "department": "Tools", "category": "Parts", "section": "A", "critical": ["fatContent"]},
    {"pattern": r"blue bolt|bolt.*größe", "kind": "Bolt", "group": "Bolts", "product": "Bolt", "department": "Tools", "category": "Parts", "section": "B", "critical": ["diaperSize", "processing"]},
    {"pattern": "ring", "group": "Rings", "product": "Ring", "department": "Jewels", "category": "Rings", "section": "C", "confidence": 0.95},
    {"pattern": "gear|rod", "group": "Milch", "product": "Gear", "department": "Tools", "category": "Parts", "section": "A", "confidence": 0.9},
)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with the names, sizes and numbers that offers have."""
    k = F.col("p_partkey")
    suffix = F.element_at(F.array(*map(F.lit, (" bio", " 3,5 %", " Größe 4", " Angebot", ""))), (k % 5 + 1).cast("int"))
    size = F.element_at(F.array(F.lit("500 g"), F.lit("1 kg"), F.lit("6 x 250 ml"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    amount = F.element_at(F.array(F.lit(500), F.lit(1000), F.lit(1500), F.lit(None).cast("int")), (k % 4 + 1).cast("int"))
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", F.concat("p_name", suffix).alias("name"), F.when(k % 3 > 0, F.col("p_brand")).alias("brand"), size.alias("size"), amount.alias("amount"),
        F.when(k % 4 == 0, F.lpad((k * 7919 + 4_000_000_000_000).cast("string"), 13, "0")).alias("code"),
        F.when(k % 13 == 0, F.concat_ws("|label:", "p_type", "p_brand")).when(k % 13 == 1, F.lit("gtin:123")).alias("own_key"), F.initcap("p_type").alias("own_category"),
        F.when(k % 4 < 2, "€/kg").when(k % 4 == 2, "€/l").otherwise("€/Packung").alias("unit_label"),
    )


def offered(spark: SparkSession, sf_dir: str, goods: DataFrame) -> DataFrame:
    """The cheapest line of each product at each of seven stores."""
    cents = F.round("l_extendedprice").cast("long")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), (F.col("l_suppkey") % 7).alias("s")).agg(F.min(cents).alias("price"), F.bool_or(F.col("l_discount") >= 0.09).alias("is_offer"))
    unit = F.round(F.col("price") * 1000 / F.col("amount")).cast("long")
    return lines.join(goods, "p_partkey").withColumns({"id": F.col("p_partkey") * 10 + F.col("s"), "store": F.concat(F.lit("Store "), F.col("s").cast("string")), "unit": unit}).drop("s", "amount")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offered(spark, sf_dir, products(spark, sf_dir))


BASE = """
l as (select l_partkey as k, l_suppkey % 7 as s, min(cast(round(l_extendedprice) as bigint)) as price, bool_or(l_discount >= 0.09) as is_offer from lineitem group by 1, 2),
b as (select k * 10 + s as id, k as p_partkey, 'Store ' || s as store, price, ([500, 1000, 1500, null])[k % 4 + 1] as amount, case when k % 4 < 2 then '€/kg' when k % 4 = 2 then '€/l' else '€/Packung' end as unit_label, is_offer,
p_name || ([' bio', ' 3,5 %', ' Größe 4', ' Angebot', ''])[k % 5 + 1] as name, case when k % 3 > 0 then p_brand end as brand, (['500 g', '1 kg', '6 x 250 ml', null])[k % 4 + 1] as size,
case when k % 4 = 0 then lpad(cast(k * 7919 + 4000000000000 as varchar), 13, '0') end as code,
case when k % 13 = 0 then p_type || '|label:' || p_brand when k % 13 = 1 then 'gtin:123' end as own_key, upper(p_type[1]) || lower(p_type[2:]) as own_category from l join part on p_partkey = k),
o as (select *, cast(round(price * 1000 / amount) as bigint) as unit from b)"""


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of normalized products: names are read once a product, before the offers of all stores are joined."""
    goods = op.normalized(products(spark, sf_dir), KINDS, "own_category", exact_key="own_key")
    return offered(spark, sf_dir, op.identified(goods, F.col("code")))


def _slug(c: str) -> str:
    return f"regexp_replace(substring(replace({_FOLD.replace('lower(text)', f'lower({c})')}, ' ', '-'), 1, 140), '-+$', '')"


_CODE_SUM = " + ".join(f"cast(substring(code, {i + 1}, 1) as int) * {1 if i % 2 == 0 else 3}" for i in range(13))
NORMAL = f"""{BASE},
c as (select *, case when regexp_matches(name, 'widget') then 1 when regexp_matches(name, 'blue bolt|bolt.*Größe') then 2 when regexp_matches(name, 'ring') then 3 when regexp_matches(name, 'gear|rod') then 4 else 5 end as cl,
case when name like '%3,5 \\%' escape '\\' then '3.5' end as fat, case when name like '%Größe 4' then '4' end as dia, name like '% bio' as organic,
trim(regexp_replace(replace(replace(name, ' bio', ''), ' Angebot', ''), ' +', ' ', 'g'))[1:55] as own from o),
g as (select *, (['Widget', 'Bolt', null, null, null])[cl] as kind, (['Widgets', 'Bolts', 'Rings', 'Milch', own])[cl] as grp, (['Widget', 'Bolt', 'Ring', 'Gear', own])[cl] as product, ([0.99e0, 0.99e0, 0.95e0, 0.9e0, 0.58e0])[cl] as confidence,
([ 'Parts', 'Parts', 'Rings', 'Parts', own_category])[cl] as category, case cl when 1 then 'widget|fatContent:' || coalesce(replace(fat, '.', '-'), '?') when 2 then 'bolt|diaperSize:' || coalesce(dia, '?') || '|processing:?' end as comparison_key from c),
h as (select *, case when kind is not null then 'semantic:' || comparison_key else grp || '|' || product end as similarity_key,
case when kind is not null then 'semantic:' || comparison_key else grp || '|' || product || case when grp = 'Milch' and fat is not null then '|fat:' || fat else '' end || case when dia is not null then '|size:' || dia else '' end end as made from g),
i as (select *, {_slug("coalesce(comparison_key, made)")} as canonical_id, case when grp = 'Milch' then grp else product end as bundle_key, case when own_key like '%|label:%' then own_key else made end as first_key,
case when code is not null and ({_CODE_SUM}) % 10 = 0 then code end as gtin, coalesce(brand, name) as label from h),
n as (select *, case when gtin is not null then 'gtin:' || gtin else similarity_key || '|label:' || {_slug("label")} || '|size:' || coalesce({_slug("size")}, 'groesse-unbekannt') end as exact_key,
case when gtin is not null then 'gtin-' || gtin else {_slug("concat_ws('|', label, coalesce(kind, product), product, case when cl = 1 then 'fatContent:' || coalesce(fat, '?') when cl = 2 then 'diaperSize:' || coalesce(dia, '?') || '|processing:?' end, size)")} end as product_id,
case when gtin is not null then 'gtin' when brand is not null then 'semantic_brand' else 'semantic_name' end as identity_source from i)"""


def offers_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, attributes, keys and identity of every offer."""
    n = normal(spark, sf_dir)
    return n.select("id", "kind", F.col("group").alias("product_group"), "product", "category", "confidence", "organic", F.col("attributes.fatContent").alias("fat"), F.col("attributes.diaperSize").alias("diaper_size"), "comparison_key", "similarity_key", "canonical_id", "bundle_key", "gtin", "exact_key", "product_id", "identity_source")


OFFERS_NORMALIZED = f"with {NORMAL} select id, kind, grp as product_group, product, category, confidence, organic, fat, dia as diaper_size, comparison_key, similarity_key, canonical_id, bundle_key, gtin, exact_key, product_id, identity_source from n"


def offer_keys_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact key before identity: a reliable one of the record's own is kept, any other made anew."""
    n = offered(spark, sf_dir, op.normalized(products(spark, sf_dir), KINDS, "own_category", exact_key="own_key"))
    return n.select("id", "own_key", "exact_key", op.stable_key(F.lit(None).cast("string"), F.when(F.col("id") % 2 == 0, F.col("exact_key")), F.col("store"), F.col("name"), F.col("size")).alias("stable_key"))


OFFER_KEYS_KEPT = f"with {NORMAL} select id, own_key, first_key as exact_key, case when id % 2 = 0 then first_key else store || '|' || name || '|' || coalesce(size, '') end as stable_key from n"


def comparison_other_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every offer the best interchangeable one of another store."""
    return op.comparisons(normal(spark, sf_dir), "id")


COMPARISON_OTHER_STORE = f"""with {NORMAL},
m as (select *, cast(coalesce(case when unit > 0 then unit end, price) as double) as metric from n),
j as (select a.id, a.organic, a.metric, b.id as candidate, b.store as candidate_store, b.metric as candidate_metric, cast(b.price as double) as price,
case when a.gtin = b.gtin or a.exact_key = b.exact_key then 0 when a.comparison_key = b.comparison_key or a.similarity_key = b.similarity_key then 1 end as rank
from m a join m b on a.store <> b.store and a.unit_label = b.unit_label and a.kind is not distinct from b.kind and a.comparison_key is not distinct from b.comparison_key and not b.organic
and (a.kind is null or case a.cl when 1 then a.fat is not distinct from b.fat else a.dia is not distinct from b.dia end) and (a.similarity_key = b.similarity_key or a.gtin = b.gtin)),
r as (select *, row_number() over (partition by id order by rank, candidate_metric, price, candidate) as place from j where rank is not null)
select id, case when organic then 'conventional' when candidate_metric < metric - 1e-9 then 'cheaper_elsewhere' else 'cheapest' end as outcome, candidate, candidate_store, candidate_metric, rank from r where place = 1"""


def offers_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of what a search for "red" shows: most relevant first, then organic, on offer, greater saving, cheaper."""
    score = staples.search_score(text.fold(F.col("name")), F.lit(""), text.fold(F.coalesce("brand", F.lit(""))), text.fold(F.col("category")), "red")
    rows = normal(spark, sf_dir).withColumns({"score": score, "active": F.col("p_partkey") % 9 > 0})
    left = op.shown(rows, F.col("score"), category="Parts", kind="offers")
    order = staples.smart_order(F.col("score"), F.col("organic"), F.col("is_offer"), F.col("p_partkey") % 4, F.col("unit"), F.col("id"))
    return op.page(left, order, 1).select("id", F.col("score").cast("long").alias("score"), "unit")


OFFERS_PAGE = f"""with {NORMAL},
f as (select *, {_FOLD.replace("lower(text)", "lower(name)")} as x, coalesce({_FOLD.replace("lower(text)", "lower(brand)")}, '') as y from n where category = 'Parts' and is_offer and p_partkey % 9 > 0),
s as (select *, case when x = 'red' then 5000 else 0 end + case when starts_with(x, 'red ') then 2600 else 0 end + case when regexp_matches(x, '(^| )red( |$)') then 2300 else 0 end + case when instr(x, 'red') > 0 then 900 else 0 end
+ case when instr(y, 'red') > 0 then 220 else 0 end + case when regexp_matches(x, '(^| )red( |$)') then 280 when instr(x, 'red') > 0 then 90 else 0 end as score from f)
select id, cast(score as bigint) as score, unit from s where score > 0 order by score desc, organic desc, is_offer desc, p_partkey % 4 desc, unit nulls last, id limit 32 offset 32"""


def offers_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many offers each choice of kind leaves at each store, and the three definitions of being on offer."""
    rows = normal(spark, sf_dir).withColumns({
        "active": F.when(F.col("p_partkey") % 9 > 0, F.col("p_partkey") % 9 > 1),
        "flag": F.when(F.col("p_partkey") % 2 == 0, F.col("is_offer")), "advertised": F.when(F.col("p_partkey") % 3 == 0, F.col("is_offer")),
        "offered": F.when(F.col("p_partkey") % 4 == 0, F.col("price")), "regular": F.when(F.col("p_partkey") % 8 == 0, F.col("price") + 10).otherwise(F.col("price")),
    })
    out = None
    for kind in ("all", "offers", "organic", "regular"):
        some = op.shown(rows, kind=kind).groupBy("store").agg(
            F.count("*").alias("n"), F.count_if(op.on_offer(F.col("flag"), F.col("offered"), F.col("regular"))).alias("display"),
            F.count_if(op.on_offer_for_staples(F.col("flag"), F.col("advertised"))).alias("staples"), F.count_if(op.on_offer_by_default(F.col("flag"), F.col("advertised"))).alias("merging"),
        ).withColumn("kind", F.lit(kind))
        out = some if out is None else out.unionByName(some)
    return out


OFFERS_SHOWN = f"""with {NORMAL},
r as (select *, case when p_partkey % 9 > 0 then p_partkey % 9 > 1 end as active, case when p_partkey % 2 = 0 then is_offer end as flag, case when p_partkey % 3 = 0 then is_offer end as advertised,
case when p_partkey % 4 = 0 then price end as offered, case when p_partkey % 8 = 0 then price + 10 else price end as regular from n),
k as (select *, unnest(['all', 'offers', 'organic', 'regular']) as choice from r where coalesce(active, true) and price is not null)
select store, choice as kind, count(*) as n, count(*) filter (where coalesce(flag, false) or coalesce(offered < regular, false)) as display,
count(*) filter (where coalesce(flag, false) or coalesce(advertised, false)) as staples, count(*) filter (where coalesce(flag, advertised, true)) as merging
from k where choice = 'all' or (choice = 'offers' and is_offer) or (choice = 'organic' and organic) or (choice = 'regular' and not is_offer) group by 1, 2"""


def offers_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 cheapest offers of each store: a cap that is the feature."""
    return op.capped(base(spark, sf_dir), ["store"], [F.asc("price"), F.asc("id")], 25).select("store", "id", "price")


OFFERS_CAPPED = f"with {BASE} select store, id, price from (select *, row_number() over (partition by store order by price, id) as place from o) r where place <= 25"


def product_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes read from names written out for every product."""
    k = F.col("p_partkey")
    names = ("Pants Gr. 4 8-14 kg", "Vollmilch 3,5 % haltbar", "Waschmittel Caps 40 WL", "Folgemilch 2", "Katzenfutter Menü", "Hundefutter Kroketten", "Schwimmwindeln Größe 5", "PRE Milchnahrung", "Waschpulver 100 Waschladungen", "Frische Vollmilch 1.5%", "Eier 10 Stück", "Gel flüssig")
    name = F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    told = attributes.attributes(F.concat_ws(" ", name, "p_name"), F.lit("1 kg"))
    folded = text.fold(F.concat_ws(" ", F.lit("Angebot"), F.col("p_name"), F.lit("Marke"), name, F.lower("p_brand")), keep="a-z0-9%,.-")
    brand = text.fold(F.col("p_brand"))
    return spread(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", *(c.alias(a) for a, c in told.items()), attributes.variant_signature(F.replace(folded, F.lit("grosse"), F.lit("groesse"))).alias("variant"), attributes.without_noise(text.fold(F.concat_ws(" ", F.lit("Angebot"), F.col("p_name"), F.col("p_brand"), F.lit("Marke"))), brand).alias("plain"))


PRODUCT_ATTRIBUTES = """
with p as (select p_partkey, cast(p_partkey % 12 as int) + 1 as i, p_name, lower(p_brand) as brand from part)
select p_partkey,
(['4', null, null, null, null, null, '5', null, null, null, null, null])[i] as "diaperSize",
(['8', null, null, null, null, null, null, null, null, null, null, null])[i] as "weightMinKg",
(['14', null, null, null, null, null, null, null, null, null, null, null])[i] as "weightMaxKg",
([null, '3.5', null, null, null, null, null, null, null, '1.5', null, null])[i] as "fatContent",
([null, null, '40', null, null, null, null, null, '100', null, null, null])[i] as "washLoads",
([null, null, null, null, null, null, null, null, null, null, '10', null])[i] as "packageCount",
([null, null, null, '2', null, null, null, 'PRE', null, null, null, null])[i] as "babyStage",
([null, null, null, null, 'Katze', 'Hund', null, null, null, null, null, null])[i] as animal,
([null, null, null, null, 'Nass', 'Trocken', null, null, null, null, null, null])[i] as "feedForm",
(['Pants', null, null, null, null, null, 'Schwimmwindel', null, null, null, null, null])[i] as "diaperForm",
([null, null, 'Caps', null, null, null, null, null, 'Pulver', null, null, 'Flüssig'])[i] as "detergentForm",
([null, 'haltbar', null, null, null, null, null, null, null, 'frisch', null, null])[i] as processing,
(['||8-14 kg', '3.5||', '||', '||', '||', '||', '|5|', '||', '||', '1.5||', '||', '||'])[i] as variant,
p_name as plain from p"""


QUERIES = {
    "offers_normalized": (offers_normalized, OFFERS_NORMALIZED),
    "offer_keys_kept": (offer_keys_kept, OFFER_KEYS_KEPT),
    "comparison_other_store": (comparison_other_store, COMPARISON_OTHER_STORE),
    "offers_page": (offers_page, OFFERS_PAGE),
    "offers_shown": (offers_shown, OFFERS_SHOWN),
    "offers_capped": (offers_capped, OFFERS_CAPPED),
    "product_attributes": (product_attributes, PRODUCT_ATTRIBUTES),
}
