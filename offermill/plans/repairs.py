"""Queries on the passes that check and mend offers. Products bear dirty names and numbers in turn, by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.operators import pick, quality
from offermill.sources.tables import read

#: Names in turn, and what each of three passes says of them (None: fine).
NAMES = (
    ("Gouda jung", None, None, None),
    ("ab", "name_length", "name", "name"),
    ("12 34 --", "name_no_letters", None, None),
    ("Bitte Filiale wählen", "navigation_or_ui", None, "ui"),
    ("Angebot", "generic_name", None, None),
    ("Preis 1,99 Milch", "price_as_name", None, None),
    ("1,99 Milch", "number_as_name", None, None),
    ("500 g Packung Butter", "quantity_as_name", None, None),
    ("je 3er Schale", "quantity_as_name", "quantity_or_discount", None),
    ("pro kg = 3,99 Milch", "baseprice_as_name", "quantity_or_discount", None),
    ("Butter 2,49 € / kg", "baseprice_as_name", None, None),
    ("Angebotspreis Angebotspreis Milch", "price_as_name", "concatenated_offer", None),
    ("30% billiger Milch", None, "quantity_or_discount", None),
    ("Milch ### Image 3", None, None, "markdown"),
    ("Akku Bohrer", None, None, "outside_scope"),
    ("Rasen", None, None, "not_relevant"),
    ("Newsletter Milch", "navigation_or_ui", "ui", "ui"),
)
_LETTERS_LATE = {"12 34 --": ("letters", "not_relevant")}


def _turn(values: list, k: Column, cast: str) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast(cast) for v in values)), (k % len(values) + 1).cast("int"))


PRICES, UNITS = [1.99, 0.05, 299.99, 300.0, None, 150.0, 150.01], [2.5, 0.0, 1999.0, 2000.0, 80.5, 600.5, 800.0, 800.5, None, 5.0, 7.0]


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", _turn([n for n, *_ in NAMES], k, "string").alias("name"), F.when(k % 23 > 0, F.col("p_type")).alias("key"), _turn(PRICES, k, "double").alias("price"), _turn(UNITS, k, "double").alias("unit"), F.when(k % 29 > 0, F.col("p_brand")).alias("store"), (k % 3 == 0).alias("produce"))


def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of each of three passes that a product's offer breaks."""
    name, price, unit = F.col("name"), F.col("price"), F.col("unit")
    one = quality.first_reason(quality.sanitize_checks(name, F.col("key"), price, unit, F.col("store"), F.col("store")))
    two = quality.first_reason(quality.second_checks(name, name, price, unit, F.col("produce")))
    relevant, outside = name.rlike("(?i)milch|gouda|butter|angebot|filiale|schale"), name.rlike("(?i)akku")
    three = quality.first_reason(quality.scope_checks(name, price, unit, relevant, outside))
    return dirty(spark, sf_dir).select("p_partkey", one.alias("first_pass"), two.alias("second_pass"), three.alias("third_pass"))


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + "]"


QUALITY_REASONS = f"""
with d as (select p_partkey, p_partkey % {len(NAMES)} + 1 as i, ({_list(PRICES)})[p_partkey % {len(PRICES)} + 1] as price, ({_list(UNITS)})[p_partkey % {len(UNITS)} + 1] as unit, p_partkey % 23 = 0 as no_key, p_partkey % 29 = 0 as no_store, p_partkey % 3 = 0 as produce from part)
select p_partkey,
coalesce(({_list([n[1] for n in NAMES])})[i], case when no_key then 'missing_key' when price is null or price <= 0.05 or price >= 300 then 'invalid_price' when unit is null or unit <= 0 or unit >= 2000 then 'invalid_unit' when no_store then 'missing_store' end) as first_pass,
coalesce(({_list([_LETTERS_LATE.get(n[0], (n[2],))[0] for n in NAMES])})[i], case when price is null or price <= 0.05 or price > 150 then 'price' when unit is null or unit <= 0 then 'unit' when produce and unit > 80 then 'produce_unit' when unit > 600 then 'unit_high' end) as second_pass,
coalesce(({_list([_LETTERS_LATE.get(n[0], (None, n[3]))[1] for n in NAMES])})[i], case when price is null or price <= 0.05 or price > 150 then 'price' when unit is null or unit <= 0 or unit > 800 then 'unit' end) as third_pass from d"""


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for each reason of the first pass, and the first fifty rejected products."""
    rows = quality.with_reason(dirty(spark, sf_dir), quality.sanitize_checks(F.col("name"), F.col("key"), F.col("price"), F.col("unit"), F.col("store"), F.col("store")))
    counts = quality.funnel(rows).withColumn("example", F.lit(None).cast("long"))
    some = quality.examples(rows, [F.asc("p_partkey")]).select("reason", F.lit(1).cast("long").alias("n"), F.col("p_partkey").cast("long").alias("example"))
    return counts.unionByName(some)


QUALITY_REPORT = f"""
with r as ({QUALITY_REASONS}) select coalesce(first_pass, 'kept') as reason, count(*) as n, cast(null as bigint) as example from r group by 1
union all select first_pass, 1, p_partkey from (select * from r where first_pass is not null order by p_partkey limit 50) x"""

#: What is mended, in turn: name, size, price, unit, label; then name, price, unit, label and repairs.
REPAIRS = (
    (("Bio Milch Bio Milch", "1 l", 0.99, 0.99, "€/l"), ("Bio Milch", 0.99, 0.99, "€/l", 2)),  # the unit is within 6 % of the amount: counted as changed places
    (("**Gouda** [jung](http://x.de/y)", "500 g", 4.0, 0.5, "€/kg"), ("Gouda jung", 2.0, 4.0, "€/kg", 2)),
    (("Butter", "250 g", 2.0, None, None), ("Butter", 2.0, 8.0, "€/kg", 1)),
    (("Eier", "10 Stück", 3.0, 3.0, "€/Packung"), ("Eier", 3.0, 0.3, "€/Stk.", 1)),
    (("Reis", "2 kg", 4.0, 2.14, "€/kg"), ("Reis", 4.0, 2.14, "€/kg", 0)),
    (("Reis", "2 kg", 4.0, 3.0, "€/kg"), ("Reis", 4.0, 2.0, "€/kg", 1)),
    (("Obst", "Packung", 1.5, 1.5, "€/Packung"), ("Obst", 1.5, 1.5, "€/Packung", 0)),
    (("Angebot 1 2 3 1 2 3 rest", "6 x 0,5 l", 6.0, 2.0, "€/l"), ("1 2 3", 6.0, 2.0, "€/l", 1)),
)


def repair_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = ("name", "size", "price", "unit", "unit_label")
    rows = read(spark, sf_dir, "part").select("p_partkey", *(_turn([r[0][i] for r in REPAIRS], k, "double" if n in ("price", "unit") else "string").alias(n) for i, n in enumerate(names)))
    return quality.repaired(rows).select("p_partkey", "name", "price", "unit", "unit_label", F.col("repairs").cast("long").alias("repairs"))


REPAIR_CHAIN = "select p_partkey, " + ", ".join(f"{'cast(' * (n == 'repairs')}({_list([r[1][i] for r in REPAIRS])})[p_partkey % {len(REPAIRS)} + 1]{' as bigint)' * (n == 'repairs')} as {n}" for i, n in enumerate(("name", "price", "unit", "unit_label", "repairs"))) + " from part"

SHOPS = (
    (("C", "Milch", "1 l", 199.0, 1.0), (1.99, 1.99)),
    (("C", "Milch", "1 l", 1.99, 1.0), (1.99, 1.99)),
    (("C", "Brei", "250 g", 0.2, 1.5), (1.5, 6.0)),
    (("R", "Brei", "190 g", 10.0, 3.0), (1.9, 10.0)),
    (("R", "Milch", "190 g", 10.0, 3.0), (10.0, 52.632)),
    (("X", "Brei", "Packung", 150.0, 3.0), (150.0, 3.0)),
)


def shop_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", *(_turn([r[0][i] for r in SHOPS], k, "double" if n in ("price", "unit") else "string").alias(n) for i, n in enumerate(("store", "key", "size", "price", "unit"))))
    return quality.store_repairs(rows, "C", "R", ["Brei"]).select("p_partkey", "price", "unit")


SHOP_REPAIRS = f"select p_partkey, ({_list([r[1][0] for r in SHOPS])})[p_partkey % {len(SHOPS)} + 1] as price, ({_list([r[1][1] for r in SHOPS])})[p_partkey % {len(SHOPS)} + 1] as unit from part"

SIZES = ("1 kg", "6 x 250 ml", "Packung", "0,75 l", "500 g", "1,0 l", None)
SCORES = (28, 3, 5, 7, 8, 28, 8)


def best_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of products of one name and type the one whose size is most plausible, the first of equals."""
    rows = read(spark, sf_dir, "part").withColumn("score", quality.size_score(_turn(list(SIZES), F.col("p_partkey"), "string")))
    return pick.first_per(rows, ["p_name", "p_type"], [F.desc("score"), F.asc("p_partkey")]).select("p_name", "p_type", "p_partkey", F.col("score").cast("long").alias("score"))


BEST_SIZES = f"""select p_name, p_type, p_partkey, score from (select *, row_number() over (partition by p_name, p_type order by score desc, p_partkey) as place
from (select *, cast(({_list(SCORES)})[p_partkey % {len(SIZES)} + 1] as bigint) as score from part) s) r where place = 1"""

QUERIES = {
    "quality_reasons": (quality_reasons, QUALITY_REASONS),
    "quality_report": (quality_report, QUALITY_REPORT),
    "repair_chain": (repair_chain, REPAIR_CHAIN),
    "shop_repairs": (shop_repairs, SHOP_REPAIRS),
    "best_sizes": (best_sizes, BEST_SIZES),
}
