"""Rules for staple goods, search ranking and offers of the day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermill.functions.text import has_all, has_any, has_term
from offermill.sources.tables import kept

#: Rules are user-edited data; a larger set is no dimension any more and must not be broadcast.
MOST_RULES = 10_000


_TERMS = "array<string>"


def _terms(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_TERMS))


def matched(offers: DataFrame, rules: DataFrame) -> DataFrame:
    """Offers with every rule that accepts them, and the rule's score.

    Offers have folded text, brand, kind (what the product is, if that is
    known), family (all that names its kind) and category, and organic and
    offer. Rules have rule, brand, excluded, required_all, required_any,
    required_groups (each needs one of its terms), preferred, kinds,
    categories, exact, active, undefined, organic_required and
    organic_preferred. Rules that are not active, or not defined yet, accept
    nothing. A rule is broadcast; each offer is tried with each, in place,
    without a shuffle.
    """
    n = rules.limit(MOST_RULES + 1).count()
    if n > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    live = rules.where(F.coalesce("active", F.lit(True)) & ~F.coalesce("undefined", F.lit(False)))
    r = live.select("rule", *(F.col(c).alias(f"r_{c}") for c in rules.columns if c not in ("rule", "active", "undefined")))
    text, groups = F.col("text"), F.coalesce("r_required_groups", F.array().cast("array<array<string>>"))
    kind, family, category = (F.coalesce(c, F.lit("")) for c in ("kind", "family", "category"))
    kinds, categories = _terms("r_kinds"), _terms("r_categories")
    of_kind = (kind == "") | F.exists(kinds, lambda g: has_term(kind, g) | (kind == g))
    of_family = F.exists(kinds, lambda g: has_term(family, g) | (family == g))
    in_category = F.exists(categories, lambda t: has_term(category, t) | ((t != "") & (F.instr(category, t) > 0)))
    flag = lambda c: F.coalesce(c, F.lit(False))
    brand_ok = F.col("r_brand").isNull() | (F.col("brand") == F.col("r_brand")) | has_term(text, F.col("r_brand"))
    ok = (
        ~has_any(text, F.col("r_excluded"))
        & (~flag("r_organic_required") | F.col("organic"))
        & F.coalesce(brand_ok, F.lit(False))
        & has_all(text, F.col("r_required_all"))
        & ((F.size(_terms("r_required_any")) == 0) | has_any(text, F.col("r_required_any")))
        & F.forall(groups, lambda g: (F.size(g) == 0) | has_any(text, g))
        & ((F.size(kinds) == 0) | (of_kind & (of_family | ~flag("r_exact") | (kind == ""))))
        & ((F.size(categories) == 0) | in_category)
    )
    preferred = F.size(F.filter(_terms("r_preferred"), lambda t: has_term(text, t)))
    points = (
        F.when(F.col("r_brand").isNotNull(), 50).otherwise(0)
        + F.when(of_family, 30).otherwise(0)
        + F.when(in_category, 15).otherwise(0)
        + 8 * F.size(_terms("r_required_all"))
        + 10 * F.size(groups)
        + F.when(F.size(_terms("r_required_any")) > 0, 12).otherwise(0)
        + 4 * preferred
        + F.when(flag("r_organic_required") & F.col("organic"), 10).otherwise(0)
        + F.when(flag("r_organic_preferred") & F.col("organic"), 6).otherwise(0)
        + F.when(F.col("offer"), 1).otherwise(0)
    )
    wanted = flag("r_organic_required") | flag("r_organic_preferred")
    return offers.join(F.broadcast(r), ok).withColumns({"score": points, "organic_wanted": wanted}).drop(*(c for c in r.columns if c != "rule"))


def chosen(found: DataFrame, id_col: str) -> DataFrame:
    """For each rule of `found` (rule, score, organic_wanted, organic, store, price, unit): best, second, sellers, basis and conventional.

    Where a rule wants organic goods and there are any, only these count. Unit
    prices are compared if two or more are known, else prices; then the lower
    price, the higher score and the lower id decide. The second is of another
    store. `conventional` is the cheapest that is not organic, for rules that
    want organic goods. Rows shrink to one of each rule and store before
    anything is ranked.
    """
    far = F.lit(float("inf"))
    price, unit = F.col("price").cast("double"), F.when(F.col("unit") > 0, F.col("unit").cast("double"))
    order = lambda metric: F.struct(F.coalesce(metric, far).alias("metric"), F.coalesce(price, far).alias("price"), (-F.col("score")).alias("less"), F.col(id_col).alias("id"))
    usual = F.struct(F.coalesce(unit, price, far).alias("metric"), F.col(id_col).alias("id"))
    bio, metrics = F.col("organic"), {"unit": unit, "pack": price}
    stores = found.groupBy("rule", "store").agg(
        F.bool_or("organic_wanted").alias("wanted"), F.bool_or(bio).alias("bio"),
        F.count(unit).alias("units_all"), F.count(F.when(bio, unit)).alias("units_bio"),
        *(F.min(order(m)).alias(f"{n}_all") for n, m in metrics.items()), *(F.min(F.when(bio, order(m))).alias(f"{n}_bio") for n, m in metrics.items()),
        F.min(F.when(F.col("organic_wanted") & ~bio, usual)).alias("c"),
    )
    w = Window.partitionBy("rule")  # one row a rule and store
    strict = F.bool_or("wanted").over(w) & F.bool_or("bio").over(w)
    units = F.when(strict, F.sum("units_bio").over(w)).otherwise(F.sum("units_all").over(w))
    stores = stores.withColumns({"strict": strict, "units": units})
    of = lambda n: F.when(F.col("strict"), F.col(f"{n}_bio")).otherwise(F.col(f"{n}_all"))
    stores = stores.withColumn("o", F.when(F.col("units") >= 2, of("unit")).otherwise(of("pack")))
    ranked = stores.withColumn("_place", F.when(F.col("o").isNotNull(), F.row_number().over(Window.partitionBy("rule").orderBy(F.col("o").asc_nulls_last(), "store"))))
    place = lambda k: F.max(F.when(F.col("_place") == k, F.col("o.id")))
    return ranked.groupBy("rule").agg(
        place(1).alias("best"), place(2).alias("second"), F.count("_place").alias("sellers"),
        F.when(F.max("units") >= 2, "unit").otherwise("pack").alias("basis"), F.min("c")["id"].alias("conventional"),
    )


#: What else counts in a search for butter; of each list the first pattern that a name holds.
BUTTER_POINTS = (
    (
        ("butterkeks|buttermilch|butter chicken|lip butter|body butter|butter bronzer|buttercream|butter gemuse|buttergemuse|kakaobutter|sheabutter", -7000),
        ("(^| )butter( |$)|markenbutter|sussrahmbutter|weidebutter|irische butter|mildgesauerte butter|fassbutter", 4200),
    ),
    (("streichbutter|krauterbutter", -350),),
    (("butterschmalz", -900),),
)


def search_score(name: Column, family: Column, brand: Column, category: Column, query: str, more: dict[str, tuple] | None = None) -> Column:
    """Relevance of folded columns to a folded query; rows of score 0 or less do not qualify.

    All that holds counts: a name that is the query, begins with it, has it as
    whole words and has it anywhere adds up. `more` has further points for
    certain queries (that of butter unless given).
    """
    points = [(5000, name == query), (2600, name.startswith(query + " ")), (2300, has_term(name, query)), (900, F.instr(name, query) > 0)]
    points += [(p, F.instr(F.coalesce(c, F.lit("")), query) > 0) for c, p in ((family, 500), (brand, 220), (category, 80))]
    parts = [F.when(c, p).otherwise(0) for p, c in points]
    parts += [F.when(has_term(name, t), 280).when(F.instr(name, t) > 0, 90).otherwise(0) for t in query.split()]
    for group in (more if more is not None else {"butter": BUTTER_POINTS}).get(query, ()):
        parts.append(F.coalesce(*(F.when(name.rlike(pattern), p) for pattern, p in group), F.lit(0)))
    return reduce(lambda a, b: a + b, parts)


def smart_order(score: Column, organic: Column, offer: Column, saving: Column, unit: Column, tie: Column) -> list[Column]:
    return [score.desc(), organic.desc(), offer.desc(), saving.desc_nulls_last(), unit.asc_nulls_last(), tie.asc()]


#: The orders that a list of offers can be shown in.
SORTS = ("smart", "price", "unit", "saving", "name")


def view_order(sort: str, tie: Column, score: Column | None = None, name: str = "name", price: str = "price", unit: str = "unit", saving: str = "saving", organic: str = "organic", offer: str = "offer") -> list[Column]:
    """The order of a list of offers by one of SORTS; unknown prices come last, an unknown saving is none, and `tie` decides in the end."""
    least, saved = F.col(price).asc_nulls_last(), F.coalesce(F.col(saving), F.lit(0)).desc()
    orders = {
        "price": [least],
        "unit": [F.col(unit).asc_nulls_last()],
        "saving": [saved, least],
        "name": [german(F.coalesce(F.col(name), F.lit(""))).asc()],
        "smart": smart_order(score if score is not None else F.lit(0.0), *(F.coalesce(F.col(c), F.lit(False)) for c in (organic, offer)), F.coalesce(F.col(saving), F.lit(0)), F.col(unit), tie)[:-1],
    }
    if sort not in orders:
        raise ValueError(f"no order {sort!r}: one of {', '.join(SORTS)}")
    return [*orders[sort], tie.asc()]


def shown(results: DataFrame, term: str = "", mode: str = "all") -> DataFrame:
    """The results (name, best_name, best_offer) that a page of staples shows: those whose names hold the term, in any case of letters.

    Mode "offer" keeps those whose best is on offer, "missing" those without a
    best; a result is without one where best_name is null.
    """
    holds = {"all": F.lit(True), "offer": F.col("best_name").isNotNull() & F.coalesce("best_offer", F.lit(False)), "missing": F.col("best_name").isNull()}
    if mode not in holds:
        raise ValueError(f"no mode {mode!r}: one of {', '.join(holds)}")
    t = term.strip().lower()
    said = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t)) for c in ("name", "best_name")]
    return results.where(holds[mode] & (said[0] | said[1]))


#: How near names come to butter, of folded names; the first pattern that occurs.
BUTTER_TIERS = (
    ("butterkeks|butter keks|buttermilch|butter milch|butter chicken|buttergemuse|butter gemuse|butterbrezel|butter brezel|buttertoast|butter toast", 20),
    ("butterschmalz|butter schmalz|krauterbutter|krauter butter|streichbutter|streich butter|butterzubereitung|butter zubereitung", 70),
    ("(?<![0-9a-z_])butter(?![0-9a-z_])|markenbutter|sussrahmbutter|sauerrahmbutter|weidebutter|fassbutter|irische butter|mildgesauerte butter", 100),
    ("butter", 50),
)


def tier_score(folded: Column, tiers: tuple = BUTTER_TIERS) -> Column:
    """The points of the first tier that a folded name is of; 0 for none."""
    return F.coalesce(*(F.when(folded.rlike(p), points) for p, points in tiers), F.lit(0))


def tier_order(score: Column, organic: Column, price: Column, name: Column, tie: Column) -> list[Column]:
    """Nearest first, then organic, cheaper, and by name as German sorts it."""
    return [score.desc(), organic.desc(), price.asc_nulls_last(), german(name).asc(), tie.asc()]


def german(c: Column) -> Column:
    """Text that sorts as in a German dictionary."""
    return F.collate(c, "de")


def numbered(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Rows with their 1-based place in a total order.

    Ranges of the order are sorted apart and only their sizes meet, so that no
    task sorts all rows. The sorted rows are written once, so that places and
    sizes are of the same ranges.
    """
    rows = kept(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    rows = rows.withColumns({"_part": part, "_own": F.col("_at") - F.shiftleft(part, 33)}).drop("_at")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a range
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_part", "_own", "_before")
