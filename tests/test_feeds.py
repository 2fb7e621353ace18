"""Landed feeds, sinks, and operators that have no SQL, against plain Python on small fixtures."""

import json
import math
import random
import re
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offermill.functions import identity
from offermill.operators import catalogs, entity, history, market, staples
from offermill.plans import registry
from offermill.sources import feeds
from offermill.sources.tables import kept

SF = "/root/testdata/sf0.001"


def test_files_of_parts_and_manifest(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-0{i}.json").write_text(json.dumps([{"store": f"s{i}", "lat": 1.5}, {"store": "x", "other": 1}]))
    got = feeds.market_parts(spark, str(tmp_path / "part-*.json"), StructType().add("store", "string").add("lat", "double")).collect()
    assert Counter((r["store"], r["lat"]) for r in got) == Counter({("s0", 1.5): 1, ("s1", 1.5): 1, ("s2", 1.5): 1, ("x", None): 3})
    folder = tmp_path / "catalog"
    folder.mkdir()
    (folder / "index.json").write_text(json.dumps({"files": ["a.json", "missing.json"]}))
    for name in ("a", "b"):
        (folder / f"{name}.json").write_text(json.dumps({"retailer": name.upper(), "products": [{"name": "Milch", "price": 1.0}]}))
    product = StructType().add("name", "string").add("price", "double")
    assert [tuple(r) for r in feeds.manifest_catalog(spark, str(folder), product).collect()] == [("a.json", "A", "Milch", 1.0)]


def test_captured_answers(spark):
    rows = [(1, k, "http://x/a.json?y" if k % 2 else "http://x/a", "text/html" if k % 3 else "application/json", "{}" * (3 if k != 6 else 30)) for k in range(12)]
    df = spark.createDataFrame(rows, "page int, at int, url string, content_type string, body string")
    got = [r["at"] for r in feeds.captured(df, "page", "at", most_bytes=20, most=4).orderBy("at").collect()]
    assert got == [r[1] for r in rows if (r[1] % 2 or r[1] % 3 == 0) and r[1] != 6][:4]


def windows(cents, low, high, most, width, depth):
    own = [p for p in cents if low <= p <= high]
    if len(own) <= most or high - low <= width or not depth:
        return [(low / 100, high / 100, len(own))] if own else []
    middle = (low + high) // 2
    return windows(own, low, middle, most, width, depth - 1) + windows(own, middle + 1, high, most, width, depth - 1)


def test_price_windows_by_halving(spark):
    rng = random.Random(2)
    cents = [rng.randrange(1, 9_000) for _ in range(400)] + [199] * 300
    df = spark.createDataFrame([(c / 100,) for c in cents], "price double")
    got = sorted((r["low"], r["high"], r["n"]) for r in feeds.price_windows(df, "price", 0.0, 100.0, most=60).collect())
    assert got == sorted(windows(cents, 0, 10_000, 60, 5, 8)) and sum(n for *_, n in got) == len(cents)


def test_cards_lines_and_word_boxes(spark):
    html = '<div class="x tile"><h3>Milch <b>1 l</b></h3><img src="a"><p>0,99 €</p></div><p class="tile">ohne Namen</p><div>anderes</div>'
    got = feeds.cards(spark.createDataFrame([(1, html), (2, None)], "id long, h string"), "id", "h", "tile").orderBy("place").collect()
    assert [(r["id"], r["name"], r["text"]) for r in got] == [(1, "Milch 1 l", "Milch 1 l 0,99 €"), (1, "", "ohne Namen")]
    text = "Bio Milch\n1 l\n1,29 €\nTel. 089\n12,5\nBrot\n\n2.49"
    got = feeds.priced_lines(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t", back=2).orderBy("place").collect()
    assert [(r["name"], float(r["price"])) for r in got] == [("Bio Milch", 1.29), ("Brot", 2.49)]
    xml = '<doc><page width="5"><block><line><word xMin="1.0" yMin="2" xMax="3" yMax="4">A&amp;B</word> <word xMin="5" yMin="2" xMax="6" yMax="4">1,00*</word></line></block><block><line><word xMin="0" yMin="0" xMax="1" yMax="1">C</word></line></block></page><page width="5"></page></doc>'
    got = feeds.word_boxes(spark.createDataFrame([(7, xml), (8, None)], "id long, x string"), "id", "x").collect()
    assert sorted((r["id"], r["page"], r["block"], r["line"], r["place"], r["x1"], r["word"]) for r in got) == [(7, 0, 0, 0, 0, 1.0, "A&B"), (7, 0, 0, 0, 1, 5.0, "1,00*"), (7, 0, 1, 0, 0, 0.0, "C")]


def test_json_catalogs(spark):
    tree = json.dumps({"a": [{"name": "Milch", "brand": "X", "price": 0.99}, {"name": "ohne"}, {"deep": {"name": "Brot", "gtin": "40"}}]})
    got = feeds.json_catalog(spark.createDataFrame([(1, tree), (2, "{"), (3, None)], "id long, j string"), "id", "j").collect()
    assert sorted((r["id"], r["name"], r["brand"], r["gtin"], r["price"]) for r in got) == [(1, "Brot", None, "40", None), (1, "Milch", "X", None, "0.99")]


def test_catalogs_are_replaced_one_by_one(spark, tmp_path):
    write = lambda rows: feeds.write_catalogs(spark.createDataFrame(rows, "name string, retailer string"), str(tmp_path), "retailer")
    write([("Milch", "A"), ("Brot", "A"), ("Eier", "B")])
    write([("Reis", "B"), ("Mehl", "B"), ("Salz", "B")])
    assert {(r["name"], r["retailer"]) for r in spark.read.parquet(str(tmp_path / "products")).collect()} == {("Milch", "A"), ("Brot", "A"), ("Reis", "B"), ("Mehl", "B"), ("Salz", "B")}
    assert {(r["retailer"], r["n"]) for r in spark.read.json(str(tmp_path / "index")).collect()} == {("A", 2), ("B", 3)}
    feeds.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "report"))
    assert [json.loads(line) for p in (tmp_path / "report").glob("*.json") for line in p.read_text().splitlines()] == [{"a": 1, "b": "x"}]


def alike(a, b):
    x, y = set(a.split()), set(b.split())
    return max(len(x & y) / len(x | y), 0.94 * len(x & y) / min(len(x), len(y))) if x and y else 0


def same(a, b):
    """The pair rule, record by record."""
    if a["organic"] != b["organic"] or (a["size"] and b["size"] and a["size"] != b["size"]):
        return False
    if a["gtin"] and b["gtin"]:
        return a["gtin"] == b["gtin"]
    if set(a["ids"]) & set(b["ids"]):
        return True
    if any(a[c] and b[c] and a[c] != b[c] for c in ("brand", "family")):
        return False
    x, y = a["name"], b["name"]
    s = alike(x, y)
    return x == y or (min(len(x.split()), len(y.split())) >= 2 and s >= 0.82) or bool(a["family"] and a["family"] == b["family"] and a["size"] and a["size"] == b["size"] and s >= 0.72)


def test_clusters_of_records_equal_brute_force(spark):
    rng = random.Random(6)
    words = "gouda jung alt mild scheiben bauer".split()
    rows = [{"id": i, "store": rng.choice("AB"), "name": " ".join(rng.sample(words, rng.randint(1, 4))), "brand": rng.choice(["", "", "x", "y"]), "size": rng.choice(["", "500 g", "1 kg"]), "gtin": rng.choice(["", "", "", "11", "12"]), "ids": rng.choice([[], [], ["7"], ["8", "9"]]), "family": rng.choice(["", "kase"]), "organic": rng.random() < 0.2} for i in range(150)]
    df = spark.createDataFrame([(r["id"], r["store"], r["name"], r["brand"], r["size"], r["gtin"], r["ids"], r["family"], r["organic"]) for r in rows], "id long, store string, name string, brand string, size string, gtin string, source_ids array<string>, family string, organic boolean")

    def blocks(r):
        traits = (r["size"], r["organic"])
        keys = {("sig", r["brand"], r["name"], traits), ("bucket", r["family"], traits, r["brand"])} | {("source", i) for i in r["ids"]}
        return keys | ({("gtin", r["gtin"])} if r["gtin"] else set()) | ({("family", r["family"], r["brand"], traits)} if r["family"] and r["brand"] and r["size"] else set())

    root = {r["id"]: r["id"] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in rows:
        for b in rows:
            if a["id"] < b["id"] and a["store"] == b["store"] and blocks(a) & blocks(b) and same(a, b):
                x, y = find(a["id"]), find(b["id"])
                root[max(x, y)] = min(x, y)
    got = catalogs.clustered(df, "id", ["store"], kept).collect()
    assert {r["id"]: r["cluster"] for r in got} == {i: find(i) for i in root}
    assert 1 < len({r["cluster"] for r in got}) < len(rows)


def test_similar_pairs_equal_brute_force(spark):
    """Sets of one to six words, most of them common; least likeness on both sides of what containment gives."""
    rng = random.Random(4)
    words = ["the", "the", "the", "red", "red", *(f"w{i}" for i in range(8))]
    sets = {i: sorted({rng.choice(words) for _ in range(rng.randint(1, 6))}) for i in range(90)}
    df = spark.createDataFrame([(i, "ab"[i % 2], t) for i, t in sets.items()], "id long, block string, t array<string>")
    for least in (0.4, 0.5, 0.82, 0.94):
        got = {(r["a"], r["b"]): r["similarity"] for r in entity.similar_pairs(df, "id", "block", "t", least).collect()}
        want = {(a, b): s for a in sets for b in sets if a < b and a % 2 == b % 2 and (s := alike(" ".join(sets[a]), " ".join(sets[b]))) >= least}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_offers_on_butter_and_guards(spark):
    names = {"butter": 5000 + 2300 + 900 + 280 + 4200, "butterkekse": 900 + 90 - 7000, "irische butter": 2300 + 900 + 280 + 4200, "krauterbutter": 900 + 90 - 350, "milch": 0}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    none = F.lit(None).cast("string")
    got = df.select("n", staples.search_score(F.col("n"), none, none, none, "butter").alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == names
    ordered = spark.createDataFrame([(k, n) for k, n in enumerate(["Zebra", "Äpfel", "Apfel", "äpfel", "Öl", "Ofen"])], "k int, n string").orderBy(staples.german(F.col("n")), "k").collect()
    assert [r["n"] for r in ordered][:1] == ["Apfel"] and [r["n"] for r in ordered][-1] == "Zebra"
    market.require_empty(df.where("n = 'x'"), "nothing")
    try:
        market.require_empty(df, "names")
    except market.GuardError as e:
        assert "names" in str(e)
    else:
        raise AssertionError("the guard let rows pass")


def hinges(values, least=5):
    a = sorted(values)
    n = len(a)
    median = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
    if n < least:
        return a
    q1, q3 = median(a[: n // 2]), median(a[math.ceil(n / 2) :])
    return a if q3 <= q1 else [x for x in a if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]


def test_typical_range_by_hinges(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, *(float(rng.randint(1, 6)) for _ in range(9)), 60.0])) for k in range(40) for _ in range(k)]
    got = {r["k"]: r for r in history.typical_range(spark.createDataFrame(rows, "k int, v double"), ["k"], F.col("v")).collect()}
    for k in range(1, 40):
        own = [v for i, v in rows if i == k and v is not None]
        kept_values = hinges(own)
        r = got[k]
        assert (r["n"], r["n_kept"]) == (len(own), len(kept_values))
        if kept_values:
            m = (kept_values[(len(kept_values) - 1) // 2] + kept_values[len(kept_values) // 2]) / 2
            assert (r["median"], r["low"], r["high"]) == (m, kept_values[0], kept_values[-1])


def test_queries_on_documents_and_pages(spark):
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    got = {r["doc_id"]: r for r in registry.queries()["document_lines"](spark, SF).collect()}
    for i, t in docs.items():
        lines, priced, least = t.split("\n"), 0, None
        known = {x.strip(" ") for x in [*lines, *re.findall(r"\[([^\]\n]+)\]\(", t)]}
        assert got[i]["candidates"] == sum(3 <= len(x) <= 240 for x in known)
        for k, line in enumerate(lines):
            m = re.search(r"(?<![\d,.])(\d{1,3}[.,]\d{2})(?![\d.,])", line)
            before = [x.strip(" ") for x in lines[max(0, k - 10) : k] if not re.search(r"(?<![\d,.])(\d{1,3}[.,]\d{2})(?![\d.,])", x) and 3 <= len(x.strip(" ")) <= 140 and re.search(r"[^\W\d_]{3}", x)]
            if m and before:
                priced += 1
        assert got[i]["priced"] == priced
    assert registry.queries()["page_cards"](spark, SF).where("text = ''").count() == 0
    total = spark.read.parquet(f"{SF}/lineitem.parquet").where("round(l_extendedprice) between 0 and 200000").count()
    assert registry.queries()["price_windows"](spark, SF).agg(F.sum("n")).first()[0] == total


def test_active_and_archived_events(spark):
    rows = [("a", "x", datetime(2026, 1, 1)), ("a", "x", datetime(2026, 1, 2)), ("b", "y", datetime(2026, 1, 3)), ("b", "y", datetime(2026, 1, 4))]
    got = history.active_and_archived(spark.createDataFrame(rows, "id string, place string, at timestamp"), F.col("place") == "x", "id", "at").collect()
    assert sorted((r["id"], r["at"].day, r["archived"]) for r in got) == [("a", 1, False), ("a", 2, False), ("b", 3, True)]


def test_equal_sets_are_compared_once(spark, monkeypatch):
    """Copies are pairs in the result, but only different sets are asked for their likeness."""
    df = spark.createDataFrame([(i, None if i == 99 else "b", ["x", f"w{i % 3}"]) for i in range(100)], "id long, block string, t array<string>")
    got = entity.similar_pairs(df, "id", "block", "t", 0.4)
    n = [33, 33, 33]
    assert got.count() == sum(n) * (sum(n) - 1) // 2 and got.where("similarity = 1").count() == sum(k * (k - 1) // 2 for k in n)
    assert got.where("a >= b").isEmpty() and got.distinct().count() == got.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [block" in plan  # sets, before they meet


def test_rows_of_one_key_meet_in_parts(spark):
    rows = spark.range(60).select("id", F.when(F.col("id") % 7 > 0, F.lit("k")).alias("k"))
    got = entity.meeting(rows, "id", F.col("a.k") == F.col("b.k"))
    pairs = [(r[0], r[1]) for r in got.select(F.col("a.id"), F.col("b.id")).collect()]
    own = [i for i in range(60) if i % 7]
    assert sorted(pairs) == [(a, b) for a in own for b in own if a < b]
    assert len({r[0] for r in got.select("a._part").distinct().collect()}) > 10


def test_rows_of_one_key_meet_in_blocks(spark):
    """A row meets arrays, in several blocks and parts of a key; a key that is null or that one row has makes no pair."""
    rows = spark.range(90).select("id", F.when(F.col("id") == 1, "lone").when(F.col("id") % 7 > 0, "k").alias("k"), (F.col("id") * 2).alias("v"))
    told = entity.numbered(rows, "id", ["k"])
    assert {(r["k"], r["n_k"]) for r in told.collect()} == {(1, 1), (2, 76), (None, None)} and told.count() == 90
    got = entity.pairs_of_key(told, "id", "k", 10)
    pairs = [tuple(r) for r in got.select("a.id", "b.id", "a.v", "b.v").collect()]
    own = [i for i in range(2, 90) if i % 7]
    assert sorted(pairs) == [(a, b, 2 * a, 2 * b) for a in own for b in own if a < b]
    assert got.select(F.spark_partition_id()).distinct().count() > 4
    assert "explode(_rows" in got._jdf.queryExecution().optimizedPlan().toString()


def test_compatible_records_have_one_key(spark):
    values = [(k, s) for k in (None, "", "x", "X") for s in (None, 0, 1)]
    df = spark.createDataFrame(values, "kind string, size int")
    key = identity.compatible_key(F.col("kind"), [F.col("size")])
    both = df.select("*", key.alias("key")).alias("a").crossJoin(df.select("*", key.alias("key")).alias("b"))
    fine = identity.compatible(F.col("a.kind"), F.col("b.kind"), [(F.col("a.size"), F.col("b.size"))])
    got = both.select(fine.alias("fine"), F.col("a.key").eqNullSafe(F.col("b.key")).alias("same"), F.col("a.key").isNull().alias("none")).collect()
    assert all(r["fine"] == r["same"] and not r["none"] for r in got) and len(got) == len(values) ** 2


def test_distances_are_worked_out_once_for_two_points(spark, monkeypatch):
    """Places at one point are one, in chunks, until they are near another; the pairs are those of all places."""
    monkeypatch.setattr(market, "CHUNK", 4)
    rng = random.Random(8)
    points = [(48 + rng.random() / 40, 11 + rng.random() / 40) for _ in range(12)] + [(None, 11.0), (48.0, None), (None, None), (-33.9, 151.2), (-33.9, 151.205), (-33.905, 151.2)]
    rows = [(i, rng.choice([1, 1, 1, 2, None]), *rng.choice(points), rng.choice([None, "", "here", "there"])) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, g int, lat double, lon double, address string")

    def km(a, b):
        if None in (*a[2:4], *b[2:4]):
            return None
        la, lo, lb, lp = map(math.radians, (*a[2:4], *b[2:4]))
        q = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(q), math.sqrt(1 - q))

    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] is not None and a[1] == b[1]:
                d = km(a, b)
                if (d is not None and d < 0.8) or (a[4] and a[4] == b[4]):
                    want[a[0], b[0]] = d
    found = market.near_duplicates(df, "id", "g", "lat", "lon", 0.8, "address", digits=6)
    got = found.collect()
    assert len(got) == len(want) and all(r["km"] is None if want[r["a"], r["b"]] is None else abs(r["km"] - want[r["a"], r["b"]]) < 2e-6 for r in got)
    assert None in want.values() and any(d and d > 0.8 for d in want.values()) and any(d == 0 for d in want.values())
    plain = market.near_duplicates(df, "id", "g", "lat", "lon", 0.8)
    assert {(r["a"], r["b"]) for r in plain.collect()} == {k for k, d in want.items() if d is not None and d < 0.8}
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(ids_b") < plan.index("ATAN2") < plan.index("collect_list(id")  # distances after places of a point are one, before they are many
