"""Choices that depend on order, as passes over what can meet: dropped names, and duplicates that merge as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermill.operators.catalogs import TRAITS, blocks, described, duplicate_links, first_of_equals, likely_same
from offermill.operators.entity import linked_components, source_priority
from offermill.sources.tables import spread

Write = Callable[[DataFrame], DataFrame]

#: Brands that a comparable name leaves out.
UNNAMED = "beba|hipp|bebivita|babylove|babydream"
#: Characters of a comparable name that holds another, at least.
LEAST = 9


def comparable(name: Column) -> Column:
    """A lower-case name of letters and digits without some brands."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"(?<![0-9a-z_])(?:{UNNAMED})(?![0-9a-z_])", "")
    return F.trim(F.regexp_replace(plain, "[^a-zäöüß0-9]+", " "))


def containments(names: DataFrame, least: int = LEAST) -> DataFrame:
    """(scope, part, whole) of different names (scope, name) of a scope of which one holds the other.

    A name that is held has all its stretches of `least` characters in the
    other one, so names meet only by the stretch of the shorter one that the
    fewest names have: what all names have in common brings none together.
    """
    grams = names.where(F.length("name") >= least).select("scope", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - least + 1), lambda i: F.substring(F.col("name"), i, F.lit(least))))).alias("gram"))
    often = grams.groupBy("scope", "gram").agg(F.count("*").alias("often"))
    rare = grams.join(often, ["scope", "gram"]).groupBy("scope", "name").agg(F.min(F.struct("often", "gram")).alias("r")).select("scope", F.col("name").alias("part"), F.col("r.gram").alias("gram"))
    met = rare.join(grams.withColumnRenamed("name", "whole"), ["scope", "gram"])
    return met.where((F.length("whole") > F.length("part")) & (F.instr("whole", F.col("part")) > 0)).select("scope", "part", "whole")


def without_contained(rows: DataFrame, id_col: str, name_col: str, scope: list[str], order: str, write: Write) -> DataFrame:
    """The rows with `kept`: what a pass by rising `order` (then id) keeps if it drops names that equal, hold or are held by a kept one's.

    Names shorter than LEAST, as compared, are all kept; null scopes equal each other.
    Of equal names the first stands for all. Then the pass runs in rounds over
    the pairs: who has no undecided name before itself stays, and its
    neighbours go. A round decides many names at once; there are as many as
    the longest row of names of which each waits for the one before.
    """
    key = F.concat_ws("\u0001", *(F.coalesce(F.col(s).cast("string"), F.lit("\u0000")) for s in scope))
    keyed = write(rows.select(F.col(id_col).alias("id"), key.alias("scope"), F.col(order).alias("at"), comparable(F.col(name_col)).alias("name")))
    first = F.min(F.struct(F.col("at").isNull().alias("late"), "at", "id"))
    named = write(keyed.where(F.length("name") >= LEAST).groupBy("scope", "name").agg(first.alias("first")))
    both = containments(named.select("scope", "name"))
    of = lambda side: named.select("scope", F.col("name").alias(side), F.col("first").alias(f"{side}_first"))
    pairs = both.join(of("part"), ["scope", "part"]).join(of("whole"), ["scope", "whole"])
    a, b = F.least("part_first", "whole_first"), F.greatest("part_first", "whole_first")
    open_ = write(pairs.select(a["id"].alias("a"), b["id"].alias("b")).distinct())
    gone: DataFrame | None = None
    while not open_.isEmpty():
        waiting = open_.select(F.col("b").alias("a")).distinct()
        stays = open_.select("a").distinct().join(waiting, "a", "left_anti")
        dropped = write(open_.join(stays, "a", "left_semi").select("b").distinct())
        gone = dropped if gone is None else gone.union(dropped)
        left = open_.join(stays, "a", "left_anti").join(dropped.select(F.col("b").alias("a")), "a", "left_anti")
        open_ = write(left.join(dropped, "b", "left_anti"))
    alone = named.select(F.col("first.id").alias("id"))
    alone = alone if gone is None else alone.join(gone.withColumnRenamed("b", "id"), "id", "left_anti")
    stay = keyed.where(F.length("name") < LEAST).select("id").union(alone).select(F.col("id").alias(id_col), F.lit(True).alias("kept"))
    return rows.join(stay, id_col, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


# duplicates that merge as they come


def _plain(clean: str, brand: str) -> str:
    own = set(brand.split())
    rest = [w for w in clean.split(" ") if w not in own]
    return " ".join(rest) if brand and rest else clean


def same_product(p: dict, r: dict) -> bool:
    """likely_same of two records as dicts: what the pass compares with is a merged one."""
    if p["organic"] != r["organic"] or (p["size"] and r["size"] and p["size"] != r["size"]):
        return False
    if p["gtin"] and r["gtin"]:
        return p["gtin"] == r["gtin"]
    if not set(p["ids"]).isdisjoint(r["ids"]):
        return True
    if p["variant"] != r["variant"] or any(p[c] and r[c] and p[c] != r[c] for c in ("brand", "family")):
        return False
    a, b = _plain(p["clean"], p["brand"]), _plain(r["clean"], r["brand"])
    if not a or not b or a == b:
        return bool(a and b)
    x, y = set(a.split()), set(b.split())
    alike = max(len(x & y) / len(x | y), 0.94 * len(x & y) / min(len(x), len(y)))
    if min(len(a.split(" ")), len(b.split(" "))) >= 2 and alike >= 0.82:
        return True
    return bool(p["family"] and p["family"] == r["family"] and p["size"] and p["size"] == r["size"] and alike >= 0.72)


def aliases(r: dict) -> list[str]:
    """The names under which a record is found, in the order in which they are asked."""
    traits = f"{r['size']}|{r['organic']}"
    out = [f"gtin:{r['gtin']}"] if r["gtin"] else []
    out += [f"source:{i}" for i in r["ids"]]
    out.append(f"sig:{r['brand']}|{_plain(r['clean'], r['brand'])}|{traits}|{r['variant']}")
    if r["canonical"]:
        out.append(f"canonical:{r['canonical']}|{traits}|{r['variant']}")
    if r["family"] and r["brand"] and r["size"]:
        out.append(f"family:{r['family']}|{r['brand']}|{traits}|{r['variant']}")
    return list(dict.fromkeys(out))


def bucket(r: dict) -> str:
    return f"bucket:{r['family']}|{r['size']}|{r['organic']}|{r['brand']}"


def merged(a: dict, b: dict) -> dict:
    """One record of two: the better one's, over it the cheapest offer's; prices, places and sources of both."""
    priced = [x["price"] for x in (a, b) if x["price"] is not None]
    offers = sorted((x for x in (a, b) if x["is_offer"] and x["price"] is not None), key=lambda x: x["price"])
    offer, base = (offers[0] if offers else None), max((a, b), key=lambda x: x["worth"])
    current = offer["price"] if offer else min(priced, default=None)
    over = [v for x in (a, b) for v in (x["regular"], None if x["is_offer"] else x["price"]) if v and (not current or v >= current)]
    out = base | ({k: v for k, v in offer.items() if v not in (None, "", [])} if offer else {})
    if offer and offer["name"]:  # what is read from a name goes with it, also where it is nothing
        out |= {k: offer[k] for k in ("clean", "variant")}
    markets = dict(a["markets"])
    for m, p in b["markets"].items():
        if m not in markets or (p or float("inf")) < (markets[m] or float("inf")):
            markets[m] = p
    place = offer["market"] if offer and offer["market"] else min(markets, key=lambda m: markets[m] or float("inf"), default=base["market"])
    return out | {
        "gtin": a["gtin"] or b["gtin"], "price": current, "regular": max(over) if over else None if offer else current, "is_offer": offer is not None, "offer_price": current if offer else None,
        "source_types": sorted({*a["source_types"], *b["source_types"]}), "markets": markets, "market": place, "merged_from": a["merged_from"] + b["merged_from"], "first": a["first"],
        "worth": out["worth_but_offer"] + (40 if offer else 0),
    }


class Growing:
    """The products of one component as they grow, and the merged states that records elsewhere must not be like."""

    def __init__(self):
        self.products: list[dict] = []
        self.known: dict[str, dict[int, None]] = {}
        self.keys: list[dict[str, None]] = []

    def add(self, r: dict) -> tuple[dict, list[str]] | None:
        """Takes a record; returns what a product became with all its keys, if that is new."""
        for i in dict.fromkeys(i for k in (*aliases(r), bucket(r)) for i in self.known.get(k, ())):
            if same_product(self.products[i], r):
                before, had = self.products[i], len(self.keys[i])
                self.products[i] = after = merged(before, r)
                self._know(i, aliases(after))
                trait = lambda x: (*(x[c] for c in ("size", "gtin", "brand", "family", "clean", "variant")), tuple(x["ids"]))
                return (after, list(self.keys[i])) if len(self.keys[i]) > had or trait(before) != trait(after) else None
        self.products.append(r)
        self.keys.append({})
        self._know(len(self.products) - 1, [*aliases(r), bucket(r)])
        return None

    def _know(self, i: int, keys: list[str]) -> None:
        for k in keys:
            self.known.setdefault(k, {})[i] = None
            self.keys[i][k] = None


_OUT = "state boolean, component long, _scope string, first long, name string, _brand string, _size string, _gtin string, _family string, _ids array<string>, _organic boolean, _variant string, _plain string, keys array<string>, brand string, size string, price double, regular_price double, offer_price double, market string, source_types array<string>, branch_count int, merged_from long"


def _grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs the pass component by component; rows come in order, so that one component's products are all that is held."""

    def line(state: bool, component: int, p: dict, keys: list[str]) -> tuple:
        return (state, component, p["scope"], p["first"], p["name"], p["brand"], p["size"], p["gtin"] or None, p["family"], p["ids"], p["organic"], p["variant"], _plain(p["clean"], p["brand"]), keys,
                p["brand_given"], p["size_given"], p["price"], p["regular"], p["offer_price"], p["market"], p["source_types"], max(1, len(p["markets"])), p["merged_from"])

    columns, at, own = [c.split()[0] for c in _OUT.split(", ")], None, Growing()
    for b in batches:
        out = []
        for r in b.astype(object).where(b.notna(), None).to_dict("records"):
            if r["component"] != at:
                out += [line(False, at, p, []) for p in own.products]
                at, own = r["component"], Growing()
            r["ids"], r["gtin"] = list(r["ids"]), r["gtin"] or ""
            r |= {"markets": {r["market"]: r["price"]} if r["market"] else {}, "source_types": [r["source_type"]] if r["source_type"] else [], "offer_price": r["price"] if r["is_offer"] else None, "worth_but_offer": r["worth"] - (40 if r["is_offer"] else 0)}
            if became := own.add(r):
                out.append(line(True, at, *became))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame([line(False, at, p, []) for p in own.products], columns=columns)


def merged_in_order(records: DataFrame, id_col: str, scope: list[str], write: Write, market: str = "market") -> DataFrame:
    """The products that one pass over the records by id leaves: each joins the first product it is likely the same as, as merged so far.

    Products are found by what their records and their merged states are
    called (article numbers, numbers of the source, signature, canonical id,
    family) and by bucket; names, brands and prices change as they merge, so the order
    counts. Records that can meet are components; a component is one pass. Components
    begin as those of likely same records. If a merged state is likely the
    same as a record elsewhere, the two components are one, and the pass runs
    again over these: the others' states have met all that is outside already.
    In the end no state could have met anything outside, so all
    passes together are the one over everything.
    """
    rows = write(described(spread(records, id_col), id_col, scope))
    pairs = write(duplicate_links(rows, write))
    parts = linked_components(pairs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), write).withColumnsRenamed({"id": "_first", "component": "_linked"})
    rows = first_of_equals(rows).join(parts.hint("merge"), "_first", "left")
    worth = source_priority(F.col("is_offer"), F.col("gtin"), F.nullif(F.col("brand"), F.lit("")), F.col("image"), F.col("source_type"), F.coalesce("name", F.lit("")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = rows.select(
        F.coalesce("_linked", "_first").alias("component"), F.col("_id").alias("first"), F.col("_scope").alias("scope"), "name", text("_brand").alias("brand"), text("_size").alias("size"), text("_gtin").alias("gtin"), text("_family").alias("family"), F.col("_ids").alias("ids"),
        F.col("_organic").alias("organic"), F.col("_variant").alias("variant"), F.col("_clean").alias("clean"), text("_canonical").alias("canonical"), F.col("brand").alias("brand_given"), F.col("size").alias("size_given"),
        F.when(F.col("price") > 0, F.col("price").cast("double")).alias("price"), F.when(F.col("regular") > 0, F.col("regular").cast("double")).alias("regular"), F.coalesce("is_offer", F.lit(False)).alias("is_offer"), F.col(market).alias("market"), "source_type", worth.cast("double").alias("worth"), F.lit(1).alias("merged_from"),
    )
    placed, about = write(own), write(rows.select(*TRAITS, "_id", F.coalesce("_linked", "_first").alias("component")))
    todo, done = placed, None
    while True:
        grown = write(todo.repartition("component").sortWithinPartitions("component", "first").mapInPandas(_grow, _OUT))
        states = grown.where("state").select(F.col("component").alias("x"), "_scope", F.explode("keys").alias("_block"), *(F.col(c).alias(f"s{c}") for c in ("_organic", "_size", "_gtin", "_ids", "_variant", "_brand", "_family", "_plain")))
        there = about.select(F.col("component").alias("y"), "_scope", F.explode(blocks()).alias("_block"), *(F.col(c).alias(f"r{c}") for c in ("_organic", "_size", "_gtin", "_ids", "_variant", "_brand", "_family", "_plain"))).distinct()
        links = write(states.distinct().join(there, ["_scope", "_block"]).where("x <> y").where(likely_same("s", "r")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        products = grown.where("not state")
        done = products if done is None else done.unionByName(products)
        if links.isEmpty():
            return done.select("first", "name", "brand", "size", F.col("_gtin").alias("gtin"), "price", "regular_price", "offer_price", "market", "source_types", "branch_count", "merged_from")
        one = linked_components(links, links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), write).toDF("component", "now")
        move = lambda df: write(df.join(one, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now"))
        placed, about = move(placed), move(about)
        todo = placed.join(one.select(F.col("now").alias("component")).distinct(), "component", "left_semi")
        done = write(done.join(one, "component", "left_anti"))
