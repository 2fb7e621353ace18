"""Node tables, upserts, ranges and observed passes against plain Python."""

import random
import re
from collections import Counter
from datetime import date, timedelta
from html.parser import HTMLParser

from pyspark.sql import functions as F

from offermill.operators import intervals, quality
from offermill.operators.upsert import upserted
from offermill.plans import imports, registry
from offermill.sources import landed, nodes
from offermill.sources.tables import kept

SF = "/root/testdata/sf0.001"


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.nav = self.li = 0
        self.href, self.out = None, []

    def handle_starttag(self, tag, attrs):
        self.nav += tag == "nav"
        if tag == "a" and self.nav:
            self.href, self.text = dict(attrs).get("href"), ""

    def handle_endtag(self, tag):
        self.nav -= tag == "nav"
        if tag == "a" and self.href is not None:
            self.out.append((self.href, " ".join(self.text.split())))
            self.href = None

    def handle_data(self, data):
        if self.href is not None:
            self.text += data


def test_links_of_all_pages(spark):
    want = Counter()
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        p = Links()
        p.feed(r.html)
        want.update((r.page_id, *x) for x in p.out)
    got = Counter((r.page_id, r.href, r.text) for r in registry.queries()["page_links"](spark, SF).collect())
    assert got == want and sum(want.values()) > 100


def test_nodes_selectors_and_tiles(spark):
    html = """<div class="a grid"><ul><li>eins<li><b>zwei &amp; drei</b> vier</ul><img src="x"><p>p1<p>p2 <i>kursiv</div></span><script>1,00 €</script>
    <main><div class="tile"><a data-id="7" class="to">Milch</a><div><i>0,99 €</i> statt <s>1,29 €</s> 1,5 l</div></div><section><h2><a data-id="8" class="to">Ohne</a></h2></section><div><a class="to" data-id="7">Spät</a> 2.49 €</div></main>"""
    table = kept(nodes.nodes(spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "nur Text"), (5, "<p>offen <b>fett")], "id long, h string"), "id", "h"))
    text = lambda sel: [r.text for r in nodes.texts_below(table, nodes.selected(table, sel)).orderBy("id", "node").collect()]
    assert text("ul li") == ["eins", "zwei & drei vier"] and text("div.a p") == ["p1", "p2 kursiv"] and text("div.grid.a b") == ["zwei & drei"] and text("img[src]") == [""]
    assert text("p b") == ["fett"] and text("li li") == [] and text("*.to[data-id]") == ["Milch", "Ohne", "Spät"] and text("main div a") == ["Milch", "Spät"]
    assert {r.id for r in table.select("id").distinct().collect()} == {1, 4, 5} and not [r for r in table.collect() if r.text and "1,00" in r.text]
    rows = {r.node: r for r in table.where("id = 1").collect()}
    assert all((r.path[-1] if r.path else None) == r.parent and (r.parent is None or r.path[:-1] == rows[r.parent].path) for r in rows.values())
    got = sorted((r.id, r.key, r["name"], float(r.price), r.regular and float(r.regular), r["size"]) for r in nodes.tiles(table, "a.to", "data-id").collect())
    assert got == [(1, "7", "Spät", 2.49, None, None), (1, "8", "Ohne", 0.99, 2.49, "1,5 l")]  # the second climbs to what holds them all


def upsert_by_loop(base, changes, ok):
    """Rows (id, store, number, canonical, name, size, price)."""
    keys = lambda r: [r[2], r[3], (r[4], r[5]) if None not in r[4:6] else None]

    def rank(a, b):
        for i, (x, y) in enumerate(zip(keys(a), keys(b))):
            if x is not None and y is not None:
                return i if x == y else None
        return None

    fates, first, taken = {}, set(), {}
    for c in sorted(changes):
        own = next(((c[1], i, k) for i, k in enumerate(keys(c)) if k is not None), (c[1], "id", c[0]))
        if own in first:
            fates[c[0]] = ("ignored", None)
            continue
        first.add(own)
        met = sorted((rank(c, b), b[0], b) for b in base if b[1] == c[1] and rank(c, b) is not None)
        if not met:
            fates[c[0]] = ("inserted", None)
        elif met[0][1] in taken or not ok(met[0][2], c):
            taken.setdefault(met[0][1], None)
            fates[c[0]] = ("ignored", None)
        else:
            taken[met[0][1]] = c[0]
            fates[c[0]] = ("replacing", met[0][1])
    return fates | {b[0]: ("replaced" if taken.get(b[0]) is not None else "kept", None) for b in base}


def test_upsert_by_falling_keys(spark):
    rng = random.Random(3)
    row = lambda i: (i, rng.choice(["A", "B", None]), rng.choice([None, None, *range(1, 25)]), rng.choice([None, None, None, None, "c1", "c2", "c3", "c4", "c5"]), rng.choice([None, "milch", "brot"]), rng.choice([None, "1 l", "500 g"]), rng.choice([1.0, 2.0, 3.0, None]))
    base, changes = [row(i) for i in range(60)], [row(100 + i) for i in range(60)]
    schema = "id long, store string, number long, canonical string, name string, size string, price double"
    run = lambda b, c: upserted(spark.createDataFrame(b, schema), spark.createDataFrame(c, schema), ["store"], [["number"], ["canonical"], ["name", "size"]], "id", F.col("new.price") < F.col("old.price"))
    want = upsert_by_loop(base, changes, lambda b, c: b[6] is not None and c[6] is not None and c[6] < b[6])
    got = run(base, changes).collect()
    assert {r.id: (r.fate, r.target) for r in got} == want and len(got) == 120
    n = Counter(r.fate for r in got)
    assert n["inserted"] + n["replacing"] + n["ignored"] == 60 and n["kept"] + n["replaced"] == 60 and n["replaced"] == n["replacing"] and min(n[f] for f in ("inserted", "replacing", "ignored", "kept")) > 0
    assert Counter(r.fate for r in run([], changes[:3]).collect()) <= Counter(inserted=3, ignored=3) and [r.fate for r in run(base[:1], []).collect()] == ["kept"]


def test_ranges_of_days(spark):
    rng = random.Random(4)
    d0 = date(2024, 1, 1)
    flyers = [(i, rng.choice("AB"), d0 + timedelta(days=(b := rng.randrange(100))), d0 + timedelta(days=b + rng.randrange(-1, 30))) for i in range(25)] + [(90, "A", None, d0), (91, "B", d0, None)]
    rows = [(i, rng.choice(["A", "B", "C", None]), rng.choice([None] + [d0 + timedelta(days=n) for n in range(-5, 140)])) for i in range(300)]
    good = [f for f in flyers if None not in f and f[2] <= f[3]]
    want = {}
    for i, s, day in rows:
        mine = [f for f in good if f[1] == s and day is not None]
        held = max(((f[2], f[3], f[0]) for f in mine if f[2] <= day <= f[3]), default=None)
        before = max(((f[3], f[2], f[0]) for f in mine if f[3] < day), default=None)
        want[i] = (held[2], True) if held else (before[2] if before else None, False)
    frame = spark.createDataFrame(rows, "id long, store string, day date").withColumn("says_a", F.col("day")).withColumn("says_b", F.date_add("day", 3))
    got = intervals.labelled(intervals.range_of(frame, "day", spark.createDataFrame(flyers, "flyer long, store string, a date, b date"), ["store"], "flyer", "a", "b"), "says_a", "says_b").collect()
    assert {r.id: (r.range_id, r.current) for r in got} == want and len(got) == len(rows)
    of = {f[0]: f for f in flyers}
    assert all(r.accepted == (r.current and of[r.range_id][2:] == (r.day, r.day + timedelta(days=3))) for r in got) and {r.current for r in got} == {True, False}


def test_queries_show_every_fate(spark):
    q = registry.queries()
    assert {r.fate for r in q["orders_upserted"](spark, SF).select("fate").distinct().collect()} == {"inserted", "replacing", "ignored", "kept", "replaced"}
    counters = {(r["pass"], r.counter): r.n for r in q["quality_counters"](spark, SF).collect()}
    for name in ("prices", "units"):
        assert counters[name, "before"] == counters[name, "after"] + counters[name, "rejected"] and counters[name, "repaired"] > 0 and counters[name, "rejected"] > 0
    assert counters["units", "before"] == counters["prices", "after"] and counters["prices", "before"] == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert q["flyers_by_day"](spark, SF).where("current").count() > 10


def test_observed_numbers_are_those_of_the_passes_one_by_one(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("x"))
    double = lambda d: d.withColumns({"x": F.col("x") * 2, "repaired": F.col("x").isNotNull().cast("int")})
    passes = [("one", double, [("none", F.col("x").isNull()), ("small", F.col("x") < 20)]), ("two", double, [("great", F.col("x") > 300)])]
    left, found = quality.observed_passes(df, passes)
    rows = left.collect()
    assert found["one"].get == {"before": 100, "after": 77, "rejected": 23, "repaired": 85, "none": 15, "small": 8}
    assert found["two"].get == {"before": 77, "after": len(rows), "rejected": 77 - len(rows), "repaired": 77, "great": 77 - len(rows)} and 0 < len(rows) < 77


def test_a_text_of_many_sections_keeps_all(spark):
    text = "vorher\n" + "".join(f"#### T{i}\nx{i}\n" for i in range(3000)) + "## kein\n### Letzter\n"
    got = landed.markdown_sections(spark.createDataFrame([(1, text), (2, None), (3, "ohne")], "id long, t string"), "id", "t").orderBy("position").collect()
    assert [(r.position, r["name"]) for r in got] == [(i, f"T{i}") for i in range(3000)] + [(3000, "Letzter")] and got[0].body == "x0" and got[2999].body == "x2999\n## kein"
