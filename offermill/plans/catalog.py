"""Queries on products, texts, identity and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.functions import identity, money, rules, text
from offermill.operators import entity, staples
from offermill.sources.tables import kept, read, spread


def size_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written out from p_size, read back as kg, l or pieces."""
    unit = F.element_at(F.array(*map(F.lit, ("g", "kg", "ml", "l", "Stk."))), (F.col("p_partkey") % 5 + 1).cast("int"))
    size = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("3 x ")).otherwise(F.lit("")), F.col("p_size").cast("string"), F.lit(" "), unit)
    return read(spark, sf_dir, "part").select("p_partkey", size.alias("size")).select("p_partkey", "size", F.round(money.quantity(F.col("size")) * 1000).cast("long").alias("thousandths"), money.unit_label(F.col("size")).alias("label"))


SIZE_TEXT_PARSE = """
with s as (select p_partkey, (case when p_partkey % 3 = 0 then '3 x ' else '' end) || cast(p_size as varchar) || ' ' || (['g', 'kg', 'ml', 'l', 'Stk.'])[cast(p_partkey % 5 + 1 as int)] as size from part),
p as (select *, regexp_extract(size, '([0-9]+) (kg|g|ml|l|Stk)', 1) as n, regexp_extract(size, '([0-9]+) (kg|g|ml|l|Stk)', 2) as u, case when size like '3 x %' then 3 else 1 end as times from s)
select p_partkey, size, cast(n as bigint) * times * case when u in ('g', 'ml') then 1 else 1000 end as thousandths, case when u in ('g', 'kg') then '€/kg' when u in ('ml', 'l') then '€/l' else '€/Stk.' end as label from p"""


def locale_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals written the German and the English way, read back as cents."""
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, rest = F.floor(c / 100).cast("long"), F.lpad((c % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    written = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), rest)).otherwise(F.concat(grouped, F.lit("."), rest))
    return read(spark, sf_dir, "orders").select("o_orderkey", (money.locale_number(written) * 100).cast("long").alias("cents"))


LOCALE_NUMBER_PARSE = "select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents from orders"

#: An ordered rule table over product types.
TYPE_RULES = [("brass.*steel|steel.*brass", "alloy"), ("^promo", "campaign"), ("steel", "steel"), ("brass|copper|nickel", "metal"), ("tin", "tin"), ("^(small|medium|large)", "sized")]


def rule_classify_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_type", rules.first_match(F.col("p_type"), TYPE_RULES, "other").alias("category"))


RULE_CLASSIFY_FIRST_MATCH = "select p_partkey, p_type, case " + " ".join(f"when regexp_matches(lower(p_type), '{p}') then '{label}'" for p, label in TYPE_RULES) + " else 'other' end as category from part"


def text_fold_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document folded by built-in functions, for the letters of Latin alphabets."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded_md5"), text.slug(F.col("text")).alias("slug"))


_FOLD = f"trim(regexp_replace(replace(translate(lower(text), '{text.FOLD_FROM}', '{text.FOLD_TO}'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"
TEXT_FOLD_SLUG = f"select doc_id, md5({_FOLD}) as folded_md5, regexp_replace(substring(replace({_FOLD}, ' ', '-'), 1, 140), '-+$', '') as slug from documents"


def text_fold_slug_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document folded, whatever its language and script."""
    folded = read(spark, sf_dir, "documents").select("doc_id", text.fold_any(F.col("text")).alias("folded"))
    slug = F.regexp_replace(F.substring(F.replace("folded", F.lit(" "), F.lit("-")), 1, 140), "-+$", "")
    return folded.select("doc_id", F.md5("folded").alias("folded_md5"), slug.alias("slug"))


def gtin_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad((F.col("p_partkey") * 7919 + 4_000_000_000_000).cast("string"), 13, "0")
    return read(spark, sf_dir, "part").select("p_partkey", code.alias("code"), identity.gtin(code).alias("gtin"))


GTIN_CHECK_DIGIT = (
    "with c as (select p_partkey, lpad(cast(p_partkey * 7919 + 4000000000000 as varchar), 13, '0') as code from part), s as (select *, "
    + " + ".join(f"cast(substring(code, {i + 1}, 1) as int) * {1 if i % 2 == 0 else 3}" for i in range(13))
    + " as total from c) select p_partkey, code, case when total % 10 = 0 then code end as gtin from s"
)

#: Staple rules over product names; what a rule does not say is empty.
RULES = (
    {"rule": "one", "excluded": ["red"], "required_any": ["almond", "blue", "green"], "preferred": ["almond"]},
    {"rule": "two", "brand": "brand 1", "required_any": ["antique", "aquamarine", "azure", "beige", "part"], "organic_required": True},
    {"rule": "three", "required_all": ["part"], "required_groups": [["1", "2", "3"], ["part", "item"], []], "preferred": ["part"]},
    {"rule": "four", "kinds": ["brass", "plated tin"], "exact": True, "categories": ["econ", "small"]},
    {"rule": "five", "kinds": ["steel"], "organic_preferred": True},
    {"rule": "six", "required_any": ["part"], "active": False},
    {"rule": "seven", "required_any": ["part"], "undefined": True},
)
RULE_SCHEMA = "rule string, brand string, excluded array<string>, required_all array<string>, required_any array<string>, required_groups array<array<string>>, preferred array<string>, kinds array<string>, categories array<string>, exact boolean, active boolean, undefined boolean, organic_required boolean, organic_preferred boolean"


def staple_rules(spark: SparkSession) -> DataFrame:
    names = [c.split(" ")[0] for c in RULE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in RULES], RULE_SCHEMA)


def staple_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as offers: a third has no kind of its own, and every kind is the last words of the type."""
    kind = F.when(F.col("p_partkey") % 3 > 0, F.regexp_extract(F.lower("p_type"), r"^\S+ (.*)$", 1))
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.fold(F.concat_ws(" ", "p_name", "p_type")).alias("text"), text.fold(F.substring("p_brand", 1, 7)).alias("brand"),
        (F.col("p_size") % 2 == 0).alias("organic"), (F.col("p_partkey") % 4 == 0).alias("offer"),
        kind.alias("kind"), F.concat_ws(" ", kind, text.fold(F.col("p_brand"))).alias("family"), F.lower(F.substring_index("p_type", " ", 1)).alias("category"),
    )


def staple_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staples.matched(staple_offers(spark, sf_dir), staple_rules(spark)).select("p_partkey", "rule", F.col("score").cast("long").alias("score"))


def _staple_sql() -> str:
    """The matching rules as the reference states them, spelt out for each staple."""
    has = lambda t, c="text": f"instr(' ' || {c} || ' ', ' {t} ') > 0"
    any_of = lambda ts, c="text": "(" + " or ".join(has(t, c) for t in ts) + ")"
    parts = []
    for r in RULES:
        if r.get("active") is False or r.get("undefined"):
            continue
        g = r.get
        ok = [f"not {any_of(r['excluded'])}"] if g("excluded") else []
        ok += ["organic"] if g("organic_required") else []
        ok += [f"(brand = '{r['brand']}' or {has(r['brand'])})"] if g("brand") else []
        ok += [has(t) for t in g("required_all", [])] + ([any_of(r["required_any"])] if g("required_any") else [])
        ok += [any_of(x) for x in g("required_groups", []) if x]
        points = (50 if g("brand") else 0) + 8 * len(g("required_all", [])) + 10 * len(g("required_groups", [])) + (12 if g("required_any") else 0)
        extra = [f"case when {has(t)} then 4 else 0 end" for t in g("preferred", [])]
        if g("kinds"):
            ok.append(f"(kind = '' or {any_of(r['kinds'], 'kind')})")
            ok += [f"(kind = '' or {any_of(r['kinds'], 'family')})"] if g("exact") else []
            extra.append(f"case when {any_of(r['kinds'], 'family')} then 30 else 0 end")
        if g("categories"):
            ok.append("(" + " or ".join(f"instr(category, '{t}') > 0" for t in r["categories"]) + ")")
            points += 15
        extra += ["case when organic then 10 else 0 end"] * bool(g("organic_required")) + ["case when organic then 6 else 0 end"] * bool(g("organic_preferred"))
        wanted = "true" if g("organic_required") or g("organic_preferred") else "false"
        parts.append(f"select *, '{r['rule']}' as rule, {wanted} as organic_wanted, cast({' + '.join([str(points), 'case when offer then 1 else 0 end', *extra])} as bigint) as score from o where {' and '.join(ok)}")
    fold = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    kind = "case when p_partkey % 3 > 0 then regexp_extract(lower(p_type), '^[^ ]+ (.*)$', 1) else '' end"
    offers = (
        f"select p_partkey, p_retailprice, p_brand as own_brand, {fold(chr(39).join(['p_name || ', ' ', ' || p_type']))} as text, {fold('substring(p_brand, 1, 7)')} as brand, p_size % 2 = 0 as organic, p_partkey % 4 = 0 as offer, "
        f"{kind} as kind, trim({kind} || ' ' || {fold('p_brand')}) as family, lower(split_part(p_type, ' ', 1)) as category, p_size from part"
    )
    return f"with o as ({offers}), f as (" + " union all ".join(parts) + ")"


STAPLE_RULE_MATCH = _staple_sql() + " select p_partkey, rule, score from f"


def staple_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each staple the best offer, the next of another brand (the store here), the sellers and the cheapest that is not organic."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("store"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"), (F.col("p_size") * 10).cast("long").alias("amount"))
    offers = staple_offers(spark, sf_dir).join(p, "p_partkey").withColumn("unit", F.when(F.col("p_partkey") % 6 > 0, F.round(F.col("price") * 1000 / F.col("amount")).cast("long")))
    return staples.chosen(staples.matched(offers, staple_rules(spark)), "p_partkey")


STAPLE_RESULTS = _staple_sql() + """,
p as (select rule, p_partkey as id, own_brand as store, score, organic, organic_wanted, cast(round(p_retailprice * 100) as bigint) as price, p_size * 10 as amount from f),
u as (select *, case when id % 6 > 0 then cast(round(price * 1000 / amount) as bigint) end as unit, bool_or(organic) over (partition by rule) as bio from p),
m as (select *, count(unit) over (partition by rule) as units from u where not organic_wanted or not bio or organic),
r as (select *, case when units >= 2 then unit else price end as metric from m),
b as (select *, row_number() over (partition by rule order by metric nulls last, price, score desc, id) as place from r),
s as (select b.*, row_number() over (partition by b.rule order by b.metric nulls last, b.price, b.score desc, b.id) as next from b join (select rule, store from b where place = 1) t on t.rule = b.rule and t.store <> b.store),
c as (select rule, id, row_number() over (partition by rule order by coalesce(unit, price), id) as place from u where organic_wanted and not organic),
n as (select rule, count(distinct store) as sellers, max(units) as units from r group by rule)
select n.rule, b.id as best, s.id as second, sellers, case when n.units >= 2 then 'unit' else 'pack' end as basis, c.id as conventional
from n left join b on b.rule = n.rule and b.place = 1 left join s on s.rule = n.rule and s.next = 1 left join c on c.rule = n.rule and c.place = 1"""


#: Keys that relate two products, with what makes them compatible (fine).
IDENTITY = ["gtin", "group", "exact_key", "comparison_key", "similarity_key", "fine"]


def identities(spark: SparkSession, sf_dir: str, group: Column) -> DataFrame:
    """Products with numbers for their identity keys, written once.

    The last three keys relate compatible products only and begin with what makes
    them so: no two meet by such a key that it doesn't relate.
    """
    fine = identity.compatible_key(F.col("p_type"), [F.col("p_size") % 5])
    p = entity.numbered(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_size", group.alias("group"), fine.alias("fine")), "p_partkey", ["fine"])
    among = lambda key: F.concat("fine", F.lit("|"), key)
    keys = p.select(
        "p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.lit("4006381333931")).alias("gtin"), "group", "fine", (F.col("p_size") % 2 == 0).alias("organic"),
        among(F.concat_ws("|", "p_name", "p_size")).alias("exact_key"), among(F.concat_ws("|", "p_type", "p_size")).alias("comparison_key"), among(F.col("p_name")).alias("similarity_key"),
    )
    return kept(entity.numbered(keys, "p_partkey", IDENTITY[:-1]))


def related(products: DataFrame, key: str, nor: list[str]) -> DataFrame:
    """(a, b, relation) of the products of one key that share none of the keys `nor`."""
    side = lambda s: {k: F.col(f"{s}.{k}") for k in [*IDENTITY, "organic"]}
    pairs = entity.pairs_of_key(products.select("p_partkey", *IDENTITY, "organic", f"n_{key}"), "p_partkey", key)
    for k in nor:
        pairs = pairs.where(~F.coalesce(F.col(f"a.{k}") == F.col(f"b.{k}"), F.lit(False)))
    relation = identity.relation(side("a"), side("b"), F.col("a.fine") == F.col("b.fine"))
    return pairs.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), relation.alias("relation"))


def relation_pair_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each product relates to the others of its type and brand: keys made of its columns."""
    shelf = F.when(F.col("p_type").isNotNull() & F.col("p_brand").isNotNull(), F.to_json(F.struct("p_type", "p_brand")))
    return related(identities(spark, sf_dir, shelf), "group", [])


RELATION_PAIR_KIND = """
with p as (select p_partkey, p_type, p_name, p_brand, p_size, p_partkey % 11 = 0 as coded, p_size % 2 = 0 as organic from part),
j as (select a.p_partkey as a, b.p_partkey as b, a.coded and b.coded as same_code, a.organic as oa, b.organic as ob, a.p_size % 5 = b.p_size % 5 as fine, a.p_brand = b.p_brand as same_group,
a.p_name = b.p_name and a.p_size = b.p_size as exact, a.p_size = b.p_size as comparison, a.p_name = b.p_name as alike from p a join p b on a.p_type = b.p_type and a.p_brand = b.p_brand and a.p_partkey < b.p_partkey)
select a, b, case when same_code then (case when oa = ob then 'exact_match' when oa then 'conventional_alternative' else 'organic_alternative' end)
when not fine and same_group then 'same_group' when not fine then 'none'
when exact then (case when oa = ob then 'exact_match' when oa then 'conventional_alternative' else 'organic_alternative' end)
when comparison or alike then 'similar_product' when same_group then 'same_group' else 'none' end as relation from j"""


def relation_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All related pairs of products, whatever their type or place: they meet by the identity keys themselves."""
    p = identities(spark, sf_dir, F.col("p_brand"))
    # a pair counts at the first key that it shares
    return reduce(DataFrame.unionByName, (related(p, k, IDENTITY[:i]) for i, k in enumerate(IDENTITY[:-1])))


RELATION_PAIRS_ALL = """
with p as (select p_partkey, p_type, p_name, p_brand, p_size, p_partkey % 11 = 0 as coded, p_size % 2 = 0 as organic from part),
j as (select a.p_partkey as a, b.p_partkey as b, a.coded and b.coded as same_code, a.organic as oa, b.organic as ob, a.p_type = b.p_type and a.p_size % 5 = b.p_size % 5 as fine, a.p_brand = b.p_brand as same_group,
a.p_name = b.p_name and a.p_size = b.p_size as exact, a.p_type = b.p_type and a.p_size = b.p_size as comparison, a.p_name = b.p_name as alike from p a join p b on a.p_partkey < b.p_partkey),
r as (select a, b, case when same_code then (case when oa = ob then 'exact_match' when oa then 'conventional_alternative' else 'organic_alternative' end)
when not fine and same_group then 'same_group' when not fine then 'none'
when exact then (case when oa = ob then 'exact_match' when oa then 'conventional_alternative' else 'organic_alternative' end)
when comparison or alike then 'similar_product' when same_group then 'same_group' else 'none' end as relation from j)
select a, b, relation from r where relation <> 'none'"""


def bundle_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_type").alias("types"), F.count("*").alias("products")).where("types > 1")


BUNDLE_TYPE_CONFLICTS = "select p_name, count(distinct p_type) as types, count(*) as products from part group by p_name having count(distinct p_type) > 1"


def search_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    query = "red"
    score = staples.search_score(text.fold(F.col("p_name")), text.fold(F.col("p_type")), text.fold(F.col("p_brand")), F.lit(None).cast("string"), query)
    ranked = p.select("p_partkey", score.cast("long").alias("score")).where("score > 0")
    return ranked.orderBy(F.desc("score"), "p_partkey").limit(32)


SEARCH_RANK_TOPK = """
with f as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as n, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) as t, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) as b from part),
s as (select p_partkey, cast(case when n = 'red' then 5000 else 0 end + case when starts_with(n, 'red ') then 2600 else 0 end + case when regexp_matches(n, '(^| )red( |$)') then 2300 else 0 end + case when instr(n, 'red') > 0 then 900 else 0 end
+ case when instr(t, 'red') > 0 then 500 else 0 end + case when instr(b, 'red') > 0 then 220 else 0 end
+ case when instr(' ' || n || ' ', ' red ') > 0 then 280 when instr(n, 'red') > 0 then 90 else 0 end as bigint) as score from f)
select p_partkey, score from s where score > 0 order by score desc, p_partkey limit 32"""


def token_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alike names of products of one brand and size."""
    p = spread(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.concat_ws("|", "p_brand", "p_size").alias("block"), text.tokens(text.fold(F.concat_ws(" ", "p_name", "p_type"))).alias("t"))
    pairs = entity.similar_pairs(p, "p_partkey", "block", "t", 0.5)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


TOKEN_SIMILARITY_PAIRS = """
with p as (select p_partkey, p_brand, p_size, list_distinct(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ')) as t from part),
j as (select a.p_partkey as a, b.p_partkey as b, len(list_intersect(a.t, b.t)) as n_both, len(a.t) as la, len(b.t) as lb from p a join p b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey),
s as (select a, b, greatest(n_both * 1.0e0 / (la + lb - n_both), 0.94e0 * (n_both * 1.0e0 / least(la, lb))) as similarity from j)
select a, b, round(similarity, 6) as similarity from s where similarity >= 0.5"""


def cluster_dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of one brand grown into clusters in order of their keys: equal sizes and alike names join.

    Only products that chains of alike ones link are grown together in a task.
    """

    def blocks(r: dict) -> list:
        return [(r["p_size"], w) for w in r["p_name"].lower().split()]

    def alike(a: dict, b: dict) -> bool:
        x, y = set(a["p_name"].lower().split()), set(b["p_name"].lower().split())
        return a["p_size"] == b["p_size"] and bool(x & y) and max(len(x & y) / len(x | y), 0.94 * len(x & y) / min(len(x), len(y))) >= 0.82

    def merge(a: dict, b: dict) -> dict:
        return a | {"merged_from": a["merged_from"] + b["merged_from"], "p_retailprice": min(a["p_retailprice"], b["p_retailprice"])}

    columns = ["p_partkey", "p_brand", "p_name", "p_size", "p_retailprice", "merged_from"]
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_name", "p_size", "p_retailprice").fillna("")
    p = p.withColumn("t", F.when(F.col("p_size").isNotNull(), text.tokens(F.regexp_replace(F.lower("p_name"), r"\s+", " "))))
    # exact copies end in one cluster; products without words or size are like none
    own = F.when(F.coalesce(F.size("t"), F.lit(0)) <= 0, F.col("p_partkey"))
    same = p.groupBy("p_brand", "p_name", "p_size", own.alias("own")).agg(F.min("p_partkey").alias("p_partkey"), F.min("p_retailprice").alias("p_retailprice"), F.count("*").alias("merged_from"), F.first("t").alias("t"))
    same = kept(same.withColumn("block", F.concat_ws("|", "p_brand", "p_size")))
    pairs = kept(entity.similar_pairs(same, "p_partkey", "block", "t", 0.82).select("a", "b"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    parts = entity.linked_components(pairs, ids, kept).withColumnRenamed("id", "p_partkey")
    rows = same.join(parts, "p_partkey", "left").select(*columns, "component")
    grown = entity.greedy_clusters(rows.where("component is not null"), "component", ["p_partkey"], alike, merge, blocks, "p_partkey long, p_brand string, p_name string, p_size int, p_retailprice double, merged_from long, component long")
    out = grown.unionByName(rows.where("component is null"))
    return out.select("p_partkey", "p_brand", "merged_from", F.round("p_retailprice", 2).alias("least_price"))


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct products of every brand and type that are on offer, with totals; fewer than five are sparse."""
    offers = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    p = read(spark, sf_dir, "part").join(offers, "p_partkey", "left_semi")
    return p.rollup("p_type", "p_brand").agg(F.count("*").alias("products")).select(F.coalesce("p_type", F.lit("all")).alias("p_type"), F.coalesce("p_brand", F.lit("all")).alias("p_brand"), "products", (F.col("products") < 5).alias("sparse"))


COVERAGE_MATRIX = """
select coalesce(p_type, 'all') as p_type, coalesce(p_brand, 'all') as p_brand, count(*) as products, count(*) < 5 as sparse
from part where p_partkey in (select l_partkey from lineitem) group by rollup (p_type, p_brand)"""


def set_diff_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands new, gone and present between a fifth of the products and the rest."""
    p = read(spark, sf_dir, "part")
    sides = p.groupBy("p_brand").agg(F.bool_or(F.col("p_partkey") % 5 == 0).alias("old"), F.bool_or(F.col("p_partkey") % 5 > 0).alias("new"))
    return sides.select("p_brand", F.when(~F.col("old"), "new").when(~F.col("new"), "removed").otherwise("present").alias("status"))


SET_DIFF_BRANDS = """
with p as (select p_brand, max(case when p_partkey % 5 = 0 then 1 else 0 end) as o, max(case when p_partkey % 5 > 0 then 1 else 0 end) as n from part group by 1)
select p_brand, case when o = 0 then 'new' when n = 0 then 'removed' else 'present' end as status from p"""


def set_diff_brands_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands new, gone and present between even and odd sizes, which together are all sized products."""
    sides = read(spark, sf_dir, "part").where("p_size is not null").groupBy("p_brand").agg(F.bool_or(F.col("p_size") % 2 == 0).alias("old"), F.bool_or(F.col("p_size") % 2 != 0).alias("new"))
    return sides.select("p_brand", F.when(~F.col("old"), "new").when(~F.col("new"), "removed").otherwise("present").alias("status"))


SET_DIFF_BRANDS_ALL = """
with p as (select p_brand, count(*) filter (where p_size % 2 = 0) as o, count(*) filter (where p_size % 2 <> 0) as n from part where p_size is not null group by 1)
select p_brand, case when o = 0 then 'new' when n = 0 then 'removed' else 'present' end as status from p"""


def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and length of the visible words of every page, by the HTML parser of the sources."""
    from offermill.sources.html import page_parts

    return page_parts(read(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "title", F.size("blocks").cast("long").alias("n_blocks"))


QUERIES = {
    "size_text_parse": (size_text_parse, SIZE_TEXT_PARSE),
    "locale_number_parse": (locale_number_parse, LOCALE_NUMBER_PARSE),
    "rule_classify_first_match": (rule_classify_first_match, RULE_CLASSIFY_FIRST_MATCH),
    "text_fold_slug": (text_fold_slug, TEXT_FOLD_SLUG),
    "text_fold_slug_all": (text_fold_slug_all, None),
    "gtin_check_digit": (gtin_check_digit, GTIN_CHECK_DIGIT),
    "staple_rule_match": (staple_rule_match, STAPLE_RULE_MATCH),
    "staple_results": (staple_results, STAPLE_RESULTS),
    "relation_pair_kind": (relation_pair_kind, RELATION_PAIR_KIND),
    "relation_pairs_all": (relation_pairs_all, RELATION_PAIRS_ALL),
    "bundle_type_conflicts": (bundle_type_conflicts, BUNDLE_TYPE_CONFLICTS),
    "search_rank_topk": (search_rank_topk, SEARCH_RANK_TOPK),
    "token_similarity_pairs": (token_similarity_pairs, TOKEN_SIMILARITY_PAIRS),
    "cluster_dedupe_exact": (cluster_dedupe_exact, None),
    "coverage_matrix": (coverage_matrix, COVERAGE_MATRIX),
    "set_diff_brands": (set_diff_brands, SET_DIFF_BRANDS),
    "set_diff_brands_all": (set_diff_brands_all, SET_DIFF_BRANDS_ALL),
    "html_title_text": (html_title_text, None),
}
