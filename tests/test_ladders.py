"""Price ladders, decision lists, range sizes and the orders of lists against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from offermill.functions import money
from offermill.functions.rules import Rule, decided
from offermill.operators import ladders, market, staples
from offermill.plans import registry
from offermill.plans.ladders import priced_documents

SF = "/root/testdata/sf0.001"


def plain_forms(text):
    """Each form from left to right, the forms in order; what overlaps one that stays goes."""
    kept = []
    for rank, f in enumerate(ladders.FORMS):
        for m in re.finditer(f.pattern, text or "", re.ASCII):
            if all(m.end() <= b or m.start() >= e for _, _, b, e, *_ in kept):
                euros = lambda g: float(m[g].replace(",", "."))  # noqa: B023, E731
                kept.append((f.kind, rank, m.start(), m.end(), euros(f.price), euros(f.regular) if f.regular else None))
    return sorted(kept, key=lambda k: k[2])


def plain_counted(forms):
    fits = [f for f in forms if 0.05 < f[4] < 500]
    if not fits:
        return None
    best = min(fits, key=lambda f: (f[1], f[2]))
    before = max((f[5] for f in forms if f[5] is not None), default=None)
    regular = next((r for r in (best[5], before) if r is not None and r > best[4]), None)
    return best[0], best[4], regular, best[0] == "app", len(forms)


def spark_forms(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, kind string, price string")
    found = ladders.price_forms(df, "id", "text")
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((r["kind"], r["rank"], r["begins"], r["ends"], float(r["price"]), None if r["regular"] is None else float(r["regular"])))
    counted = {r["id"]: (r["kind"], float(r["price"]), None if r["regular"] is None else float(r["regular"]), r["app"], r["prices"]) for r in ladders.counted_price(found, "id").collect()}
    return {k: sorted(v, key=lambda x: x[2]) for k, v in got.items()}, counted


def test_price_forms_equal_a_plain_scan(spark):
    rng = random.Random(5)
    bits = ["App-Preis ", "app-preis von", "Aktionspreis ", "Festpreis von ", "nur ", "NUR", "statt ", "UVP ", " €", "€", "\n", " ", "1,99", "0,05", "499.99", "500,00", "12,5", "3", "Käse 🧀 ", "ein langer Satz dazwischen ", ", "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))), "x", "y") for i in range(600)]
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "statt 1,99 € nur 0,99", "x", "y"), (1003, "9,99 € " * 20000, "x", "y")]
    got, counted = spark_forms(spark, rows)
    for i, text, *_ in rows[:-1]:
        want = plain_forms(text)
        assert got.get(i, []) == want, text
        assert counted.get(i) == plain_counted(want), text
    assert len(got[1003]) == 20000 and counted[1003][:2] == ("euro", 9.99)
    assert 1000 not in got and 1001 not in got and counted[1002] == ("only", 0.99, None, False, 2)
    kinds = {k[0] for v in got.values() for k in v}
    assert kinds == {f.kind for f in ladders.FORMS}


def test_repeated_and_null_keys_of_price_forms(spark):
    """Equal rows count once, different texts of a key apart, and a null key is a key."""
    rows = [(1, "nur 1,99", "a", "b")] * 3 + [(1, "App-Preis 0,99 €", "a", "b"), (None, "2,49 €", None, None)]
    got, counted = spark_forms(spark, rows)
    assert sorted(got[1]) == [("app", 0, 0, 16, 0.99, None), ("only", 2, 0, 8, 1.99, None)]
    assert got[None] == [("line", 3, 0, 6, 2.49, None)] and counted[1][1] == 0.99
    assert spark_forms(spark, []) == ({}, {})


def test_document_prices_equal_a_plain_scan(spark):
    got = {}
    for r in registry.queries()["document_prices"](spark, SF).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.begins, r.ends, r.price, r.regular))
    want = {}
    for r in priced_documents(spark, SF).collect():
        want.setdefault(r.doc_id, set()).update((k, b, e, p, o) for k, _, b, e, p, o in plain_forms(r.text))
    assert got == want and len(got) == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()


def test_larger_end_of_a_range(spark):
    rows = [("200-250 g", 0.25), ("250 – 200 g", 0.25), ("1,5-2,25 l", 2.25), ("6x0,5 l", 3.0), ("500 g", 0.5), ("Packung", None), ("", None), (None, None)]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string").select("s", money.larger_quantity(F.col("s")).cast("double").alias("q"))
    assert {r.s: r.q for r in df.collect()} == dict(rows)


def plain_decided(text, scope, rules, attributes, kind=None, confidence=0.9):
    has = lambda p, t: t is not None and re.search(p, t, re.IGNORECASE)
    for r in rules:
        own = r.kind or kind, r.confidence if r.confidence is not None else confidence
        if not has(r.pattern, text) or (r.veto and has(r.veto, text)) or (r.scope and not has(r.scope, scope)):
            continue
        if (case := plain_decided(text, scope, r.cases, attributes, *own)) is not None:
            return case
        if r.product is not None:
            filled = re.sub(r"\{(\w+)\}", lambda m: attributes.get(m[1]) or "", r.product)
            return own[0], re.sub(r"\s+", " ", filled).strip(), own[1]
    return None


def test_decision_lists_equal_plain_rules(spark):
    """Vetoes, scopes, cases in cases, templates and rules that leave a text to later ones, tried in order."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "zeta"]

    def rule(depth):
        pick = lambda share: rng.choice(words) if rng.random() < share else None
        cases = tuple(rule(depth - 1) for _ in range(rng.randrange(3))) if depth else ()
        product = f"P{rng.randrange(99)} {{a}} {{missing}}" if rng.random() < 0.6 else None
        return Rule(rng.choice(words), product, pick(0.4), rng.choice([None, 0.5, 0.8]), pick(0.4), pick(0.3), cases)

    texts = [(" ".join(rng.sample(words, rng.randrange(0, 5))), rng.choice([None, *words]), rng.choice([None, "x y"])) for _ in range(60)] + [(None, None, None)]
    df = spark.createDataFrame(texts, "text string, scope string, a string")
    reached = 0
    for _ in range(6):
        rules = [rule(2) for _ in range(5)]
        got = df.select("*", decided(F.col("text"), rules, F.col("scope"), {"a": F.col("a")}).alias("d")).collect()
        for r in got:
            want = plain_decided(r.text, r.scope, rules, {"a": r.a})
            assert (None if r.d is None else (r.d.kind, r.d.product, r.d.confidence)) == want
            reached += want is not None
    assert reached > 20
    assert df.select(decided(F.col("text"), []).alias("d")).where("d is not null").count() == 0


def test_a_list_of_many_rules_is_one_expression(spark):
    rules = [Rule(rf"\bw{i}\b", f"p{i}", f"k{i}", veto=f"v{i}") for i in range(400)]
    df = spark.range(800).select("id", F.concat(F.lit("a w"), F.col("id"), F.when(F.col("id") % 7 == 0, F.concat(F.lit(" v"), F.col("id"))).otherwise(F.lit(""))).alias("t"))
    got = {r.id: r.d for r in df.select("id", decided(F.col("t"), rules).alias("d")).collect()}
    assert all((got[i] is None) == (i >= 400 or i % 7 == 0) for i in range(800))
    assert all(d.rule == i + 1 and d.product == f"p{i}" for i, d in got.items() if d)


def test_orders_of_a_list(spark):
    rows = [(1, "Äpfel", 2, None, None, None, None), (2, "Zimt", None, 5, 10, True, True), (3, "apfel", 1, 4, 10, False, None), (4, None, 1, 4, None, None, True)]
    df = spark.createDataFrame(rows, "id long, name string, price int, unit int, saving int, organic boolean, offer boolean")
    ids = {s: [r.id for r in df.orderBy(*staples.view_order(s, F.col("id"))).collect()] for s in staples.SORTS}
    assert ids == {"price": [3, 4, 1, 2], "unit": [3, 4, 2, 1], "saving": [3, 2, 4, 1], "name": [4, 3, 1, 2], "smart": [2, 4, 3, 1]}
    with pytest.raises(ValueError, match="no order"):
        staples.view_order("colour", F.col("id"))


def test_modes_of_staples(spark):
    df = spark.createDataFrame([("Butter", "Irische", True), ("Milch", None, None), ("Mehl", "Weizen", None), (None, None, False)], "name string, best_name string, best_offer boolean")
    names = lambda *a: {r.name for r in staples.shown(df, *a).collect()}
    assert names() == {"Butter", "Milch", "Mehl", None} and names("", "offer") == {"Butter"} and names("", "missing") == {"Milch", None}
    assert names(" IRI ") == {"Butter"} and names("%") == set()
    with pytest.raises(ValueError, match="no mode"):
        staples.shown(df, "", "some")


def test_counts_of_values_and_of_none(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "x int, y string")
    assert {tuple(r) for r in market.counts_by(df, ["x", "y"]).collect()} == {("x", "1", 2), ("x", "2", 1), ("y", "a", 1), ("y", None, 2)}
    assert market.counts_by(df.limit(0), ["x"]).count() == 0


def test_blocks_are_dealt_over_more_tasks(spark):
    """All steps on a block's prices run in the task that it is dealt to, so these are not joined to a few."""
    from offermill.plans import ladders as plan

    blocks = plan.order_blocks(spark, SF)
    blocks.count()
    assert blocks.rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
