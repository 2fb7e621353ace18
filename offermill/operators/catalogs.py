"""Duplicates of offers as records of one product: the rule, the blocks that candidates share, clusters, and what a cluster becomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermill.functions.attributes import organic, variant_signature, without_noise
from offermill.functions.text import fold, token_similarity, tokens
from offermill.operators.entity import linked_components, similar_pairs, source_priority
from offermill.sources.tables import spread


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def described(records: DataFrame, id_col: str, scope: list[str]) -> DataFrame:
    """Records (name, brand, size, gtin, source_ids, family, organic) as the rule reads them, with the place that duplicates share."""
    plain = lambda c: fold(F.coalesce(F.col(c), F.lit("")), keep="a-z0-9%")
    size = plain("size")
    for pattern, unit in (("gramm|grams?", "g"), ("kilogramm|kilograms?", "kg"), ("liter|litres?", "l")):
        size = F.regexp_replace(size, rf"(?<![0-9a-z_])(?:{pattern})(?![0-9a-z_])", unit)
    known = F.col("canonical_id") if "canonical_id" in records.columns else F.lit(None).cast("string")
    canonical = F.when(~F.coalesce(known.startswith("gtin-"), F.lit(False)), _filled(fold(F.coalesce(known, F.lit("")), keep="a-z0-9%")))
    rows = records.select("*", canonical.alias("_canonical"), F.col(id_col).alias("_id"), F.concat_ws("|", *(plain(c) for c in scope)).alias("_scope"), plain("name").alias("_name"), plain("brand").alias("_brand"), size.alias("_size"), _filled(plain("gtin")).alias("_gtin"), plain("family").alias("_family"))
    ids = F.filter(F.transform(F.coalesce("source_ids", F.array().cast("array<string>")), lambda i: fold(i, keep="a-z0-9%")), lambda i: i != "")
    return rows.select("*", ids.alias("_ids"), organic(F.concat_ws(" ", "_name", "_brand"), F.col("organic")).alias("_organic"), variant_signature(F.col("_name")).alias("_variant"), without_noise(F.col("_name"), F.lit("")).alias("_clean"), without_noise(F.col("_name"), F.col("_brand")).alias("_plain"))


def blocks(d: str = "") -> Column:
    """Keys of which two records must share one to be candidates: article number, source's numbers, signature, canonical id, family, and the bucket of equal traits."""
    c = lambda x: F.col(f"{d}{x}")
    traits = F.concat_ws("|", c("_size"), F.when(c("_organic"), "True").otherwise("False"))
    key = lambda kind, *parts: F.concat(F.lit(kind), F.concat_ws("|", *parts))
    own = F.array(
        F.concat(F.lit("gtin:"), c("_gtin")),
        key("sig:", c("_brand"), c("_plain"), traits, c("_variant")),
        F.when(c("_canonical").isNotNull(), key("canonical:", c("_canonical"), traits, c("_variant"))),
        F.when((c("_family") != "") & (c("_brand") != "") & (c("_size") != ""), key("family:", c("_family"), c("_brand"), traits, c("_variant"))),
        key("bucket:", c("_family"), traits, c("_brand")),
    )
    return F.array_distinct(F.filter(F.concat(own, F.transform(c("_ids"), lambda i: F.concat(F.lit("source:"), i))), lambda k: k.isNotNull()))


def likely_same(a: str, b: str) -> Column:
    """Whether two described records (prefixes of their columns) are one product: the first of these that decides.

    Organic and size must not differ; article numbers decide where both have
    one; a number of the source in common is enough; variants, brands and
    families must not differ; then names, without brand and offer words, are
    equal, or alike by 0.82 where both have two words, or by 0.72 where family
    and size are known and equal.
    """
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    differ = lambda c: (x(c) != "") & (y(c) != "") & (x(c) != y(c))
    alike = token_similarity(tokens(x("_plain")), tokens(y("_plain")))
    words = F.least(F.size(F.split(x("_plain"), " ")), F.size(F.split(y("_plain"), " ")))
    numbered = x("_gtin").isNotNull() & y("_gtin").isNotNull()
    return (
        F.when(x("_organic") != y("_organic"), False)
        .when(differ("_size"), False)
        .when(numbered, x("_gtin") == y("_gtin"))
        .when(F.arrays_overlap(x("_ids"), y("_ids")), True)
        .when((x("_variant") != y("_variant")) | differ("_brand") | differ("_family"), False)
        .when((x("_plain") == "") | (y("_plain") == ""), False)
        .when(x("_plain") == y("_plain"), True)
        .when((words >= 2) & (alike >= 0.82), True)
        .otherwise((x("_family") != "") & (x("_family") == y("_family")) & (x("_size") != "") & (x("_size") == y("_size")) & (alike >= 0.72))
    )


TRAITS = ("_scope", "_name", "_brand", "_size", "_gtin", "_family", "_ids", "_organic", "_variant", "_plain", "_canonical")


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of described records, a before b, that are likely one product: candidates share a scope and a block.

    Records of equal traits are one to each other and meet others once, so
    that a product with many copies makes no pairs among them.
    """
    keyed = rows.groupBy(*TRAITS).agg(F.min("_id").alias("_id"))
    block = keyed.select("*", F.explode(blocks()).alias("_block"))
    prefixed = lambda p: block.select(F.col("_scope"), F.col("_block"), F.col("_id").alias(f"{p}_id"), *(F.col(t).alias(f"{p}{t}") for t in TRAITS if t != "_scope"))
    met = prefixed("x").join(prefixed("y"), ["_scope", "_block"]).where("x_id < y_id").where(likely_same("x", "y"))
    return met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def _hubs(kind: str, scope: list[Column], p: Column, q: Column, when: Column) -> Column:
    """The hubs of a record for a rule by which records of one scope are the same unless p or q is known of both and differs.

    A hub links all its members to the first of those that it is made of: the
    records that lack what others have. So (p, -) is the hub of all with p,
    (-, q) of all with q, (-, -) of all; and as (p, -) and (-, q) are the same
    whatever p and q are, either kind is linked to the first of the other.
    """
    hub = lambda own, alike, name, *parts: F.struct(F.concat_ws("\u0001", F.lit(f"{kind}:{name}"), *scope, *parts).alias("hub"), F.lit(own).alias("own"), F.lit(alike).alias("alike"))
    every, by_p, by_q = (lambda own: hub(own, True, "")), (lambda own: hub(own, True, "p", p)), (lambda own: hub(own, True, "q", q))
    return (
        F.when(~when, F.array().cast("array<struct<hub:string,own:boolean,alike:boolean>>"))
        .when(p.isNotNull() & q.isNotNull(), F.array(hub(True, True, "pq", p, q), by_p(False), by_q(False), every(False)))
        .when(p.isNotNull(), F.array(by_p(True), every(False), hub(True, False, "xp"), hub(False, False, "xq")))
        .when(q.isNotNull(), F.array(by_q(True), every(False), hub(False, False, "xp"), hub(True, False, "xq")))
        .otherwise(F.array(every(True)))
    )


def duplicate_links(rows: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) of described records: links that reach just what duplicate_pairs reach in chains, without pairs inside large blocks.

    What equal numbers or equal names decide are hubs (see _hubs): their links
    grow with the records. Only names that differ are compared, each once in a
    bucket or canonical id, and meet by their rarest words. For these, records
    that differ in nothing that the rule reads count once, and of two records
    one has no article number, as equal numbers are linked before.
    """
    c = F.col
    keyed = write(rows.groupBy(*TRAITS).agg(F.min("_id").alias("_id")))
    sized, family = _filled(c("_size")), _filled(c("_family"))
    organic_ = F.when(c("_organic"), "t").otherwise("f")
    by_id = F.flatten(F.transform("_ids", lambda i: _hubs("id", [c("_scope"), i, organic_], sized, c("_gtin"), F.lit(True))))
    hubs = F.concat(
        _hubs("gtin", [c("_scope"), c("_gtin"), organic_], sized, F.lit(""), c("_gtin").isNotNull()),
        _hubs("sig", [c("_scope"), c("_brand"), c("_plain"), c("_size"), organic_, c("_variant")], family, c("_gtin"), c("_plain") != ""),
        by_id,
    )
    members = keyed.select("_id", F.explode(hubs).alias("h")).select(c("_id").alias("a"), "h.*").distinct()
    first = members.where("own").groupBy("hub").agg(F.min("a").alias("b"))
    linked = members.where("alike or not own").join(first.hint("merge"), "hub").where("a <> b").select("a", "b")

    classes = keyed.where("_plain <> ''").groupBy("_scope", "_canonical", "_size", "_organic", "_variant", "_brand", "_family", "_plain", "_gtin").agg(F.min("_id").alias("_id"))
    place = lambda *parts: F.concat_ws("\u0001", "_scope", "_size", organic_, "_variant", *parts)
    found = linked
    for block, rule in ((place("_family", "_brand"), classes), (place("_canonical"), classes.where("_canonical is not null"))):
        of = write(rule.select(block.alias("block"), "_plain", "_brand", "_family", "_size", "_gtin", "_id").groupBy("block", "_plain", "_brand", "_family", "_size", "_gtin").agg(F.min("_id").alias("_id")))
        names = write(of.groupBy("block", "_plain").agg(F.min("_id").alias("name")))
        near = similar_pairs(names.withColumn("t", tokens(c("_plain"))), "name", "block", "t", 0.72)
        if rule is not classes:  # of one canonical id, brands and families may be missing where names are equal
            near = near.unionByName(names.select(c("name").alias("a"), c("name").alias("b"), F.lit(1.0).alias("similarity")))
        named = of.join(names.hint("merge"), ["block", "_plain"])
        side = lambda p, named=named: named.select(c("name").alias("a" if p == "x" else "b"), *(c(k).alias(f"{p}{k}") for k in ("_plain", "_brand", "_family", "_size", "_gtin", "_id")))
        met = near.join(side("x").hint("merge"), "a").join(side("y").hint("merge"), "b").where((c("x_gtin").isNull() | c("y_gtin").isNull()) & (c("x_id") != c("y_id")))
        differ = lambda k: (c(f"x{k}") != "") & (c(f"y{k}") != "") & (c(f"x{k}") != c(f"y{k}"))
        words = F.least(F.size(F.split("x_plain", " ")), F.size(F.split("y_plain", " ")))
        same = (c("x_plain") == c("y_plain")) | ((words >= 2) & (c("similarity") >= 0.82)) | ((c("x_family") != "") & (c("x_family") == c("y_family")) & (c("x_size") != "") & (c("similarity") >= 0.72))
        found = found.unionByName(met.where(~differ("_brand") & ~differ("_family") & same).select(c("x_id").alias("a"), c("y_id").alias("b")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def first_of_equals(rows: DataFrame) -> DataFrame:
    """Described records with _first, the least id of those of equal traits."""
    first = rows.groupBy(*TRAITS).agg(F.min("_id").alias("_first"))
    on = [F.col(f"r.{t}").eqNullSafe(F.col(f"f.{t}")) for t in TRAITS]
    return rows.alias("r").join(first.alias("f").hint("merge"), on).select("r.*", "f._first")


def clustered(records: DataFrame, id_col: str, scope: list[str], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The records with cluster, the least id of all that chains of likely same ones link within a scope.

    Order does not count here; a pass that compares with what it merged before
    can end in other clusters where likeness is not transitive.
    """
    rows = write(described(spread(records, id_col), id_col, scope))
    pairs = write(duplicate_links(rows, write))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    parts = linked_components(pairs, ids, write).withColumnsRenamed({"id": "_first", "component": "_component"})
    return first_of_equals(rows).join(parts.hint("merge"), "_first", "left").select(*records.columns, F.coalesce("_component", "_first").alias("cluster"))


def merged_records(rows: DataFrame, keys: list[str], id_col: str, branch: list[str]) -> DataFrame:
    """One record of each key: the base's name, the offer's price and place, the union of sources and branches.

    The base is the record of the highest source priority, the first of
    equals. The cheapest offer gives the price and the branch, else the
    cheapest record; the regular price is the greatest one known, or asked
    without an offer, that is not below it.
    """
    worth = source_priority(F.col("is_offer"), F.col("gtin"), _filled(F.col("brand")), F.col("image"), F.col("source_type"), F.coalesce("name", F.lit("")))
    rows = rows.withColumn("_worth", worth)
    place = F.struct(*branch)
    by_price = F.struct("price", F.col(id_col).alias("id"), place.alias("at"))
    cheapest = rows.groupBy(*keys, *branch).agg(
        F.min(by_price).alias("m"), F.min(F.when(F.col("is_offer") & F.col("price").isNotNull(), by_price)).alias("o"), F.max("regular").alias("r"), F.max(F.when(~F.col("is_offer"), F.col("price"))).alias("n"),
        F.max(F.struct("_worth", (-F.col(id_col)).alias("late"), "name", "brand", "size")).alias("base"), F.max("gtin").alias("gtin"), F.collect_set("source_type").alias("s"), F.count("*").alias("c"),
    )
    out = cheapest.groupBy(*keys).agg(F.min("m").alias("m"), F.min("o").alias("o"), F.max(F.greatest("r", "n")).alias("top"), F.max("base").alias("base"), F.max("gtin").alias("gtin"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("source_types"), F.count("*").alias("branch_count"), F.sum("c").alias("merged_from"))
    current = F.coalesce("o.price", "m.price")
    regular = F.when(F.col("top") >= current, F.col("top")).when(F.col("o").isNull(), current)
    at = F.coalesce(F.col("o.at"), F.col("m.at"))
    return out.select(*keys, "base.name", "base.brand", "base.size", "gtin", current.alias("price"), regular.alias("regular_price"), F.col("o.price").alias("offer_price"), *(at[b].alias(b) for b in branch), "source_types", "branch_count", "merged_from")


def duplicate_audit(clusters_of_branches: DataFrame, clusters_of_stores: DataFrame) -> DataFrame:
    """input_count, branch_unique, branch_duplicates, display_unique and cross_branch from clusters within branches and within stores."""
    b = clusters_of_branches.agg(F.count("*").alias("input_count"), F.count_distinct("cluster").alias("branch_unique"))
    s = clusters_of_stores.agg(F.count_distinct("cluster").alias("display_unique"))
    return b.crossJoin(s).select("*", (F.col("input_count") - F.col("branch_unique")).alias("branch_duplicates"), F.greatest(F.lit(0).cast("long"), F.col("branch_unique") - F.col("display_unique")).alias("cross_branch"))  # one row each


def unit_priced_preferred(rows: DataFrame, name: str, label: str, package: str = "€/Packung") -> DataFrame:
    """Rows without those priced by the package whose name also has a unit price."""
    known = rows.where(F.col(label).isin("€/kg", "€/l")).select(F.lower(name).alias("_n")).distinct()
    marked = rows.withColumn("_n", F.lower(name)).join(known.withColumn("_known", F.lit(True)), "_n", "left")
    return marked.where((F.col(label) != package) | F.col("_known").isNull()).drop("_n", "_known")


def bulk_prices(rows: DataFrame, keys: list[str], price: str) -> DataFrame:
    """For each key the highest price as the main one, and the least as that of larger quantities where it is lower."""
    out = rows.groupBy(*keys).agg(F.max(price).alias("main_price"), F.min(price).alias("_least"), F.count("*").alias("n"))
    return out.select(*keys, "main_price", F.when(F.col("_least") < F.col("main_price"), F.col("_least")).alias("bulk_price"), "n")


def catalog_unique(rows: DataFrame, code: str, canonical: str, name: Column, size: Column, order: list[Column]) -> DataFrame:
    """One product of each article number, or of each canonical id, name and size where there is none: the first in order."""
    key = F.coalesce(F.concat(F.lit("ean:"), F.col(code)), F.concat_ws("|", F.coalesce(F.col(canonical), F.lit("")), F.lower(name), F.lower(F.coalesce(size, F.lit("")))))
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_key", "_place")
