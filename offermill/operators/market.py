"""Branches and sources: prioritised joins, fan-out, guards, and what lies near."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermill.functions.numbers import haversine_km
from offermill.sources.tables import spread


class GuardError(AssertionError):
    """A frame that had to be empty is not."""


def require_empty(df: DataFrame, what: str) -> None:
    """Raises with a few of the offending rows, if there are any."""
    rows = df.limit(5).collect()
    if rows:
        raise GuardError(f"{what}: {[r.asDict() for r in rows]}")


def prioritised(left: DataFrame, right: DataFrame, keys: list[str], on: list[str], rank: Column, order: list[Column]) -> DataFrame:
    """Each left row with the best-ranked right row of equal `on`: the least rank, then order. Left rows without one stay.

    `right` is a dimension and is reduced by one aggregation: no window over
    the joined rows.
    """
    fields = [c for c in right.columns if c not in on]
    joined = left.join(right, on, "left").withColumn("_rank", rank)
    pick = F.min(F.when(F.col("_rank").isNotNull(), F.struct("_rank", *(o.alias(f"_o{i}") for i, o in enumerate(order)), *fields))).alias("_best")
    return joined.groupBy(*keys).agg(pick).select(*keys, *(F.col(f"_best.{f}").alias(f) for f in fields))


def fan_out(offers: DataFrame, branches: DataFrame, store: str, address: str, market: str, regional: Column, order: list[str], allowed: Column) -> DataFrame:
    """Offers at concrete branches: columns branch_address and branch_market.

    A regional offer is at all branches of its store; any other at the first
    branch (by `order`) of its address, else at the first of its market's
    name, else where it says itself, if that is `allowed`; so is every offer
    of a store without branches. What is left is dropped; `unmatched` finds it.
    `branches` is a dimension; two lookups in it, each reduced to one row a
    key before the join, take the place of ranking joined rows.
    """
    b = branches.select(F.col(store).alias("_s"), F.col(address).alias("branch_address"), F.col(market).alias("branch_market"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    first = F.min_by(F.struct("branch_address", "branch_market"), F.struct(*(f"_o{i}" for i in range(len(order)))))
    by_address = b.where("branch_address is not null").groupBy("_s", F.col("branch_address").alias("_a")).agg(first.alias("_at_address"))
    by_market = b.where("branch_market is not null").groupBy("_s", F.col("branch_market").alias("_m")).agg(first.alias("_at_market"))
    some = b.select("_s").distinct().withColumn("_any", F.lit(True))
    rows = offers.withColumns({"_s": F.col(store), "_a": F.col(address), "_m": F.col(market), "_r": F.coalesce(regional, F.lit(False))}).join(some, "_s", "left")
    everywhere = F.col("_r") & F.col("_any").isNotNull()
    wide = rows.where(everywhere).join(b.select("_s", "branch_address", "branch_market"), "_s").drop("_s", "_a", "_m", "_r", "_any")
    own = F.when(allowed, F.struct(F.col(address).alias("branch_address"), F.col(market).alias("branch_market")))
    single = rows.where(~everywhere).join(by_address, ["_s", "_a"], "left").join(by_market, ["_s", "_m"], "left").withColumn("_b", F.coalesce("_at_address", "_at_market", own))
    single = single.where("_b is not null").select(*offers.columns, "_b.branch_address", "_b.branch_market")
    return wide.select(*offers.columns, "branch_address", "branch_market").unionByName(single)


def unmatched(rows: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a counterpart: what a guard requires to be none."""
    return rows.join(dimension, on, "left_anti")


def allowed_area(address: Column, market: Column, places: list[str]) -> Column:
    """The first place named in the address, or in the market's name where there is no address."""
    text = F.lower(F.coalesce(F.nullif(F.trim(address), F.lit("")), market))
    return F.coalesce(*(F.when(text.rlike(rf"(?iu)(?<!\p{{L}}){p}(?!\p{{L}})"), F.lit(p)) for p in places))


#: Rows that a chunk of those at one place is meant to have: two chunks make 65,536 pairs at once.
CHUNK = 256


def _chunks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ids of rows of equal keys, in arrays of some CHUNK; keys may be null."""
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.count("*").over(Window.partitionBy(*keys)) / F.lit(CHUNK))).alias("chunk")
    return spread(rows, *keys).select(*keys, chunk, "id").groupBy(*keys, "chunk").agg(F.collect_list("id").alias("ids"))


def _pairs_of_chunks(left: DataFrame, right: DataFrame, on: list[str], km: Column, holds: Column) -> DataFrame:
    """(a, b, km) of the ids of chunks that meet by `on` where km `holds`; each two chunks meet in one order."""
    order = ["lat", "lon", "chunk"]
    other = spread(right.select(*on, *(F.col(c).alias(f"{c}_b") for c in [*order, "ids"])), *on, times=4)
    met = spread(left.select(*on, *order, "ids"), *on, times=4).join(other.hint("merge"), on)
    mine, theirs = F.struct(*order), F.struct(*(F.col(f"{c}_b").alias(c) for c in order))
    apart = met.where((mine <= theirs) & holds).select("ids", "ids_b", (mine < theirs).alias("two"), km.alias("km"))
    # no fewer tasks: a join gives all that one of its rows meets at once, and that shall not be pairs of ids yet
    one = apart.coalesce(1 << 20).select(F.explode("ids").alias("x"), "ids_b", "two", "km")
    both = one.select("x", F.explode("ids_b").alias("y"), "two", "km").where((F.col("x") < F.col("y")) | (F.col("two") & (F.col("x") > F.col("y"))))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "km")


def near_duplicates(places: DataFrame, id_col: str, group: str, lat: str, lon: str, within_km: float, address: str | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, km) of places of one group within a distance, or of equal addresses wherever they lie, each pair once.

    Places meet only in a grid cell of the distance's size: each goes to its
    own cell and the right and left places to the nine around it. Those at
    one point are one until then, so a distance is worked out (and rounded to
    `digits`, if given) for two points and not for each pair of places there.
    """
    size = within_km / 111.0
    rows = places.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), *([F.nullif(F.col(address), F.lit("")).alias("address")] if address else [])).where("g is not null")
    cells = _chunks(rows.where("lat is not null and lon is not null"), ["g", "lat", "lon"]).withColumn("y", F.floor(F.col("lat") / size))
    # a degree of longitude is shorter further north; a cell must not be narrower than the distance there
    width = size / F.greatest(F.cos(F.radians(F.abs((F.col("y") + F.lit(1)) * size) + size)), F.lit(0.01))
    steps = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    right = cells.withColumn("y", F.explode(F.transform(steps, lambda d: F.col("y") + d))).withColumn("x", F.floor(F.col("lon") / width))
    right = right.withColumn("x", F.explode(F.transform(steps, lambda d: F.col("x") + d)))
    left = cells.withColumn("x", F.floor(F.col("lon") / width))
    exact = haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))
    km = exact if digits is None else F.round(exact, digits)
    close = _pairs_of_chunks(left, right, ["g", "x", "y"], km, exact < within_km)
    if address is None:
        return close
    named = _chunks(rows.where("address is not null"), ["g", "address", "lat", "lon"])
    return close.unionByName(_pairs_of_chunks(named, named, ["g", "address"], km, F.coalesce(exact >= within_km, F.lit(True))))


def drop_guard(previous: DataFrame, current: DataFrame, store: str, n: str, least: int = 5, ratio: float = 0.7) -> DataFrame:
    """store, previous, current and keep_previous: the slice shrank below `ratio` of one of `least` rows or more."""
    both = previous.select(store, F.col(n).alias("previous")).join(current.select(store, F.col(n).alias("current")), store, "full_outer")
    p, c = F.coalesce("previous", F.lit(0)), F.coalesce("current", F.lit(0))
    return both.select(store, p.alias("previous"), c.alias("current"), ((p >= least) & (c < p * ratio)).alias("keep_previous"))


def guarded(previous: DataFrame, current: DataFrame, store: str, least: int = 5, ratio: float = 0.7) -> DataFrame:
    """The current rows, but the previous ones of stores that the drop guard keeps, marked stale_retained."""
    count = lambda df: df.groupBy(store).agg(F.count("*").alias("n"))
    kept = drop_guard(count(previous), count(current), store, "n", least, ratio).where("keep_previous").select(store)
    new = current.join(kept, store, "left_anti").withColumn("stale_retained", F.lit(False))
    old = previous.join(kept, store, "left_semi").withColumn("stale_retained", F.lit(True))
    return new.unionByName(old, allowMissingColumns=True)


def nearest_box(labels: DataFrame, boxes: DataFrame, page: str, most: float) -> DataFrame:
    """For each price box (id, page, x1, y1, x2, y2, page_width) the title block of its page that lies best above and beside it.

    The score weighs the vertical gap (from a block that ends above the price;
    of others 0.45 times how far the centres are apart) and how far the
    block's centre is from where a title is expected; the least wins if it is
    `most` or less.
    """
    b = boxes.select(page, F.col("id").alias("block"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    inside = F.col("b_y1").between(F.col("y1") - 225, F.col("y2") + 24) & F.col("b_x1").between(F.col("x1") - 230, F.least(F.col("page_width"), F.col("x2") + 25))
    centres = F.abs((F.col("b_y1") + F.col("b_y2")) / 2 - (F.col("y1") + F.col("y2")) / 2)
    gap = F.when(F.col("b_y2") < F.col("y1"), F.col("y1") - F.col("b_y2")).otherwise(0.45 * centres)
    aside = F.abs((F.col("x1") + F.col("x2")) / 2 - 95 - (F.col("b_x1") + F.col("b_x2")) / 2)
    value = 1.25 * gap + 0.38 * aside - F.when(F.col("b_x2") <= F.col("x1") + 15, 18).otherwise(0)
    found = labels.join(b, page).where(inside & (F.col("id") != F.col("block"))).withColumn("score", value)
    best = found.groupBy("id").agg(F.min(F.struct("score", "block")).alias("m"))
    return best.select("id", "m.block", "m.score").where(F.col("score") <= most)


def place_text(c: Column) -> Column:
    """A place's name or address for comparing: lower case, no marks, hyphens kept, one space between words."""
    from offermill.functions.text import fold

    return fold(F.coalesce(c, F.lit("")), keep="a-z0-9-")


def with_policy(places: DataFrame, address: str, market: str, areas: list[tuple[str, str, str]]) -> DataFrame:
    """Places with allowed_area and active: the first (area, address pattern, name pattern) that holds; names count only without an address."""
    a, m = place_text(F.col(address)), place_text(F.col(market))
    by_address, by_name = (F.coalesce(*(F.when(t.rlike(p[i]), F.lit(p[0])) for p in areas)) for i, t in ((1, a), (2, m)))
    area = F.when(a != "", by_address).otherwise(by_name)
    return places.withColumn("allowed_area", area).withColumn("active", F.col("allowed_area").isNotNull())


def catalog_status(known: Column, import_status: Column, offer_url: Column) -> Column:
    """What a source's catalog is worth: as said, if that is one of the known words; else by its import."""
    words = ("full_catalog", "partial_catalog", "offers_only", "unavailable", "login_required")
    return (
        F.when(known.isin(*words), known)
        .when(import_status == "login_required", "login_required")
        .when((F.coalesce(offer_url, F.lit("")) != "") | F.coalesce(import_status.isin("supported", "partial"), F.lit(False)), "offers_only")
        .otherwise("unavailable")
    )


def rebound(sources: DataFrame, branches: DataFrame, store: str, market: str, address: str, distance: str, order: list[str]) -> DataFrame:
    """Sources (source, scope, ...) at a branch: one of market scope where its name or address agrees, any other at the nearest of its store.

    Sources without such a branch are left out. branch_market, branch_address
    and the number of the store's branches come along; a branch without a
    known distance counts as 999 away.
    """
    near = F.struct(F.coalesce(F.col(f"b.{distance}"), F.lit(999.0)).alias("far"), *(F.col(f"b.{o}").alias(o) for o in order), F.col(f"b.{market}").alias("branch_market"), F.col(f"b.{address}").alias("branch_address"))
    same = (F.col(f"s.{market}") == F.col(f"b.{market}")) | (place_text(F.col(f"s.{address}")) == place_text(F.col(f"b.{address}")))
    fits = (F.col("s.scope") != "market") | F.coalesce(same, F.lit(False))
    met = sources.alias("s").join(branches.alias("b"), F.col(f"s.{store}") == F.col(f"b.{store}"))
    best = met.groupBy(F.col("s.source").alias("source")).agg(F.min(F.when(fits, near)).alias("m"), F.count("*").alias("branches"))
    return best.where("m is not null").select("source", "m.branch_market", "m.branch_address", "branches")


def same_address(zip_a: Column, zip_b: Column, street_a: Column, street_b: Column) -> Column:
    """Whether two addresses are one: no different postal codes, and one street within the other."""
    a, b = place_text(street_a), place_text(street_b)
    codes = F.coalesce(zip_a == zip_b, F.lit(True))
    return codes & (a != "") & (b != "") & ((F.instr(a, b) > 0) | (F.instr(b, a) > 0))


def within(places: DataFrame, lat: str, lon: str, at: tuple[float, float], most_km: float) -> DataFrame:
    """Places at most so far from a point, with distance_km of two decimals; such without a position are left out."""
    km = haversine_km(F.lit(at[0]), F.lit(at[1]), F.col(lat), F.col(lon))
    return places.withColumn("_km", km).where(F.col("_km") <= most_km).withColumn("distance_km", F.round("_km", 2)).drop("_km")


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of every value of each column, and of no value: column, value and n, of one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
