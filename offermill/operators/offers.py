"""Offers as one shape: what kind of product each is, the keys that say which are alike, and who sells it cheaper.

Kinds are data. A kind has pattern (of the name), and kind (null where the
product is only grouped), group, product, department, category, section,
confidence and critical (names of attributes that two offers must share).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermill.functions import identity
from offermill.functions.attributes import attributes, organic
from offermill.functions.money import price_metric
from offermill.functions.text import clean, slug

_KIND = ("kind", "group", "product", "department", "category", "section")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def classified(df: DataFrame, name: Column, category: Column, kinds: Sequence[dict], least: float = 0.58) -> DataFrame:
    """Columns kind, group, product, department, category, section, confidence and critical of the first kind whose pattern a name has.

    A name that none has is its own group: without offer words, 55 characters
    at most, in the category that it came with, at confidence `least`.
    """
    own = F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r"(?iu)(?<![\p{L}\d_])(?:bio|aktion|angebot|knaller|superknüller)(?![\p{L}\d_])", ""), r"\s+", " ")), 1, 55)
    fallback = F.coalesce(_filled(own), F.lit("Sonstiges"))
    value = lambda k, c: F.lit(k.get(c, k.get("product") if c == "group" else None)).cast("string").alias(c)
    found = [
        F.when(name.rlike(f"(?iu){k['pattern']}"), F.struct(*(value(k, c) for c in _KIND), F.lit(float(k.get("confidence", 0.99))).alias("confidence"), F.array(*map(F.lit, k.get("critical", ()))).cast("array<string>").alias("critical")))
        for k in kinds
    ]
    none = F.lit(None).cast("string")
    rest = F.struct(none.alias("kind"), fallback.alias("group"), fallback.alias("product"), F.lit("Lebensmittel").alias("department"), F.coalesce(category, F.lit("Lebensmittel")).alias("category"), F.coalesce(category, F.lit("Lebensmittel")).alias("section"), F.lit(least).alias("confidence"), F.array().cast("array<string>").alias("critical"))
    return df.withColumn("_class", F.coalesce(*found, rest)).select("*", *(F.col(f"_class.{c}").alias(c) for c in (*_KIND, "confidence", "critical"))).drop("_class")


def reliable_key(key: Column) -> Column:
    """An exact key that came with the record, if it may be kept: of a valid article number, or one with a label."""
    numbered = F.when(key.startswith("gtin:"), identity.gtin(F.substring(key, 6, 1000)).isNotNull()).otherwise(F.contains(key, F.lit("|label:")))
    return F.when(numbered, key)


def normalized(offers: DataFrame, kinds: Sequence[dict], category: str | None = None, flag: str | None = None, exact_key: str | None = None) -> DataFrame:
    """Offers (name, brand, size, ...) with their class, attributes and keys.

    similarity_key is of the kind with its critical attributes, or of group and
    product; exact_key is that with what else tells products apart, or the
    record's own if it is reliable; canonical_id is a slug of it. What a name
    says is read once for each name, size, category and flag, and joined.
    """
    opt = lambda c, t: F.col(c) if c else F.lit(None).cast(t)
    offers = offers.withColumn("name", clean(F.coalesce("name", F.lit(""))))
    told_by = list(dict.fromkeys(c for c in ("name", "size", category, flag) if c))
    rows = offers.select(*told_by).distinct()
    rows = classified(rows, F.col("name"), opt(category, "string"), kinds)
    told = attributes(F.col("name"), F.coalesce("size", F.lit("")))
    rows = rows.withColumn("attributes", F.struct(*(c.alias(a) for a, c in told.items())))
    used = sorted({a for k in kinds for a in k.get("critical", ())})
    by_name = F.create_map(*(x for a in used for x in (F.lit(a), F.col(f"attributes.{a}")))) if used else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("critical_values", F.transform("critical", lambda a: F.element_at(by_name, a)))
    critical = F.zip_with("critical", "critical_values", lambda a, v: F.concat(a, F.lit(":"), F.coalesce(_filled(slug(v)), F.lit("?"))))
    comparison = F.when(F.col("kind").isNotNull(), F.concat_ws("|", slug(F.col("kind")), critical))
    rows = rows.withColumns({"organic": organic(F.col("name"), opt(flag, "boolean")), "comparison_key": comparison})
    by_group = F.concat_ws("|", "group", "product")
    extra = [
        F.when((F.col("group") == "Milch") & F.col("attributes.fatContent").isNotNull(), F.concat(F.lit("|fat:"), F.col("attributes.fatContent"))),
        F.concat(F.lit("|size:"), F.col("attributes.diaperSize")),
        F.when(F.col("group") == "Windeln", F.concat(F.lit("|form:"), F.when(F.col("attributes.diaperForm") != "Schwimmwindel", F.col("attributes.diaperForm")))),
    ]
    similarity = F.when(F.col("kind").isNotNull(), F.concat(F.lit("semantic:"), F.col("comparison_key"))).otherwise(by_group)
    made = F.when(F.col("kind").isNotNull(), similarity).otherwise(F.concat(by_group, *(F.coalesce(e, F.lit("")) for e in extra)))
    rows = rows.withColumns({"similarity_key": similarity, "_made": made})
    canonical = F.coalesce(_filled(slug(F.coalesce("comparison_key", made))), _filled(slug(F.col("name"))), F.lit("produkt"))
    bundle = F.when(F.col("group").isin("Milch", "Butter", "Eier", "Joghurt", "Milchreis"), F.col("group")).otherwise(F.coalesce("product", "group"))
    read = rows.withColumns({"canonical_id": canonical, "bundle_key": bundle})
    added = [c for c in read.columns if c not in told_by]
    joined = offers.alias("o").join(read.alias("n"), [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in told_by])
    joined = joined.select(*(F.col(f"o.{c}") for c in offers.columns if c not in added), *(F.col(f"n.{c}") for c in added), (F.col(f"o.{exact_key}") if exact_key else F.lit(None).cast("string")).alias("_own_key"))
    return joined.withColumn("exact_key", F.coalesce(reliable_key(F.col("_own_key")), "_made")).drop("_own_key", "_made")


def identified(offers: DataFrame, gtin: Column) -> DataFrame:
    """Normalized offers with the identity of the concrete product: gtin, exact_key, product_id and identity_source.

    A valid article number is the product; otherwise its label (the brand, or
    else the whole name), kind, critical attributes and size are.
    """
    rows = offers.withColumn("gtin", identity.gtin(gtin))
    brand = _filled(clean(F.coalesce("brand", F.lit(""))))
    label = F.coalesce(brand, _filled(F.col("name")), F.lit("unbekannt"))
    size = _filled(clean(F.coalesce("size", F.lit(""))))
    base = F.coalesce("similarity_key", "comparison_key", "canonical_id")
    exact = F.concat(base, F.lit("|label:"), F.coalesce(_filled(slug(label)), F.lit("unbekannt")), F.lit("|size:"), F.coalesce(_filled(slug(size)), F.lit("groesse-unbekannt")))
    critical = F.zip_with("critical", "critical_values", lambda a, v: F.concat(a, F.lit(":"), F.coalesce(v, F.lit("?"))))
    parts = F.concat_ws("|", label, F.coalesce("kind", "product", "group"), "product", critical, size)
    concrete = F.coalesce(_filled(slug(parts)), F.lit("produkt"))
    known = F.col("gtin").isNotNull()
    return rows.withColumns({
        "exact_key": F.when(known, F.concat(F.lit("gtin:"), F.col("gtin"))).otherwise(exact),
        "product_id": F.when(known, F.concat(F.lit("gtin-"), F.col("gtin"))).otherwise(concrete),
        "identity_source": F.when(known, "gtin").when(brand.isNotNull(), "semantic_brand").otherwise("semantic_name"),
    })


def stable_key(product_id: Column, exact_key: Column, store: Column, name: Column, size: Column) -> Column:
    """What a list of remembered products goes by."""
    return F.coalesce(product_id, exact_key, F.concat_ws("|", F.coalesce(store, F.lit("")), F.coalesce(name, F.lit("")), F.coalesce(size, F.lit(""))))


def comparisons(offers: DataFrame, id_col: str) -> DataFrame:
    """For every offer the best one of another store: outcome, candidate, candidate_store, candidate_metric and rank.

    Offers have store, organic, kind, critical, critical_values, gtin, exact_key,
    comparison_key, similarity_key, unit_label, price and unit. Candidates are
    interchangeable (same kind and critical attributes), have the same unit
    and are not organic: for an organic offer that is the conventional
    alternative, for any other the next price. Equal article numbers or exact
    keys go first (rank 0), then equal comparison or similarity keys (rank 1);
    the lower metric, price and id decide. Offers without candidate are left
    out.

    The two best stores of each key are worked out first, by partial
    aggregation; an offer then meets two rows a key, never all that are alike.
    """
    metric = price_metric(F.col("unit"), F.col("price")).cast("double")
    told = F.zip_with("critical", "critical_values", lambda a, v: F.concat(a, F.lit("="), F.coalesce(F.lower(v), F.lit("?"))))
    fit = F.concat_ws("|", F.coalesce(F.concat(F.lit("kind:"), F.col("kind"), F.lit("|"), F.coalesce("comparison_key", F.lit(""))), F.lit("none")), told, "unit_label")
    rows = offers.select(F.col(id_col).alias("id"), "store", "organic", metric.alias("metric"), F.col("price").cast("double").alias("price"), fit.alias("fit"), "gtin", "exact_key", "comparison_key", "similarity_key")
    keys = F.array(*(F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("by"), F.col(name).alias("key")) for name, rank in (("gtin", 0), ("exact_key", 0), ("comparison_key", 1), ("similarity_key", 1))))
    keyed = rows.withColumn("k", F.explode(keys)).select("*", "k.*").drop("k", "gtin", "exact_key", "comparison_key", "similarity_key").where("key is not null")
    stores = keyed.where("not organic").groupBy("fit", "by", "key", "store").agg(F.min(F.struct("metric", "price", F.col("id").alias("candidate"), F.col("store").alias("candidate_store"))).alias("best"))
    ranked = stores.withColumn("place", F.row_number().over(Window.partitionBy("fit", "by", "key").orderBy("best"))).where("place <= 2")
    two = ranked.groupBy("fit", "by", "key").agg(F.min(F.when(F.col("place") == 1, F.col("best"))).alias("first"), F.min(F.when(F.col("place") == 2, F.col("best"))).alias("second"))
    met = keyed.join(two, ["fit", "by", "key"]).withColumn("other", F.when(F.col("first.candidate_store") != F.col("store"), F.col("first")).otherwise(F.col("second"))).where("other is not null")
    best = met.groupBy("id").agg(F.min(F.struct("rank", "other")).alias("m"), F.first("organic").alias("organic"), F.first("metric").alias("metric"))
    outcome = F.when(F.col("organic"), "conventional").when(F.col("m.other.metric") < F.col("metric") - 1e-9, "cheaper_elsewhere").otherwise("cheapest")
    return best.select(F.col("id").alias(id_col), outcome.alias("outcome"), F.col("m.other.candidate").alias("candidate"), F.col("m.other.candidate_store").alias("candidate_store"), F.col("m.other.metric").alias("candidate_metric"), F.col("m.rank").alias("rank"))


def shown(offers: DataFrame, score: Column | None = None, category: str | None = None, store: str | None = None, kind: str = "all") -> DataFrame:
    """Offers that a reader's choice leaves: of active markets and with a price; kind is all, offers, organic or regular; score above 0."""
    tests = [F.col("price").isNotNull(), F.coalesce("active", F.lit(True))]
    tests += [F.coalesce(_filled(F.col("category")), F.lit("Sonstiges")) == category] if category else []
    tests += [F.coalesce(_filled(F.col("store")), F.lit("Unbekannt")) == store] if store else []
    tests += {"all": [], "offers": [F.col("is_offer")], "organic": [F.col("organic")], "regular": [~F.col("is_offer")]}[kind]
    tests += [score > 0] if score is not None else []
    return offers.where(reduce(lambda a, b: a & b, tests))


def on_offer(flag: Column, offered: Column, regular: Column) -> Column:
    """For display: marked so, or offered below a known regular price."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(offered < regular, F.lit(False))


def on_offer_for_staples(flag: Column, advertised: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(advertised, F.lit(False))


def on_offer_by_default(flag: Column, advertised: Column) -> Column:
    """For merging: what is not said to be none is one."""
    return F.coalesce(flag, F.coalesce(advertised, F.lit(True)))


def page(df: DataFrame, order: list[Column], number: int, size: int = 32) -> DataFrame:
    """Page `number` (from 0) of rows in a total order; the limit is the feature."""
    return df.orderBy(*order).offset(number * size).limit(size)


def capped(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each key, in order; the cap is the feature."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")
