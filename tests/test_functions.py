"""Expressions and sources against cases worked out by hand."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from offermill.functions import identity, money, numbers, rules, text
from offermill.operators import history, market
from offermill.sources import html, landed


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first()["x"]


def test_numbers(spark):
    cases = {"1.234,56": 1234.56, "1,234.56": 1234.56, "2,49 €": 2.49, "3.5": 3.5, "": None, "x": None}
    for s, want in cases.items():
        got = one(spark, s, money.locale_number)
        assert (None if got is None else float(got)) == want


def test_sizes(spark):
    for s, amount, label in [("3 x 250 g", 0.75, "€/kg"), ("1,5 l", 1.5, "€/l"), ("6 Stück", 6, "€/Stk."), ("200-250 g", None, "€/kg"), ("3 große", None, None)]:
        got = one(spark, s, money.quantity)
        assert (None if got is None else float(got)) == amount, s
        assert one(spark, s, money.unit_label) == label, s


def test_base_price(spark):
    assert float(one(spark, "100 g = 0,99", money.base_price)) == 9.9
    assert float(one(spark, "1 kg = 2,49 - 1,99", money.base_price)) == 1.99


def test_gtin(spark):
    assert one(spark, "4006381333931", identity.gtin) == "4006381333931"
    assert one(spark, "4006381333932", identity.gtin) is None
    assert one(spark, None, identity.gtin) is None


def test_folding(spark):
    assert one(spark, "  Größe & Äpfel ", text.fold) == "grosse apfel"
    assert one(spark, "Größe & Äpfel", text.fold_any) == "grosse apfel"
    assert one(spark, "Äpfel, 1 kg", text.slug) == "apfel-1-kg"
    assert one(spark, "Bio Milch Bio Milch 1 l", text.without_repeated_prefix) == "Bio Milch 1 l"


def test_whole_terms(spark):
    assert one(spark, "frische milch", lambda c: text.has_term(c, "milch")) is True
    assert one(spark, "milchreis", lambda c: text.has_term(c, "milch")) is False


def test_first_rule_decides(spark):
    table = [("milchreis", "dessert"), ("milch", "dairy"), ("äpfel", "fruit")]
    assert one(spark, "Milchreis", lambda c: rules.first_match(c, table)) == "dessert"
    assert one(spark, "ÄPFEL rot", lambda c: rules.first_match(c, table)) == "fruit"


def test_outliers_by_hinges(spark):
    rows = {(1.0, 2.0, 3.0, 4.0, 100.0): [1.0, 2.0, 3.0, 4.0, 100.0], (10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 90.0): [10.0, 11.0, 12.0, 13.0, 14.0, 15.0], (1.0, 9.0): [1.0, 9.0]}
    for a, want in rows.items():
        q1, q3 = (a[0] + a[1]) / 2, None
        got = one(spark, list(a), numbers.without_outliers, "array<double>")
        if len(a) == 5:  # hinges 1.5 and 52: the fence reaches beyond 100
            assert got == want
        else:
            assert got == want, (a, q1, q3)


def test_schedule_over_a_clock_change(spark):
    at = datetime(2026, 3, 28, 23, 30)  # half past midnight in Berlin, the night before summer time
    got = spark.createDataFrame([(at,)], "t timestamp").select(numbers.next_slot(F.col("t"), "Europe/Berlin", [6]).alias("x")).first()["x"]
    assert got == datetime(2026, 3, 29, 4, 0)


def test_drop_guard_edges(spark):
    prev = spark.createDataFrame([("a", 3400), ("b", 3400), ("c", 100), ("d", 8), ("e", 10), ("f", 10)], "store string, n long")
    cur = spark.createDataFrame([("a", 2300), ("b", 2380), ("d", 2), ("e", 6), ("f", 7)], "store string, n long")
    got = {r["store"]: r["keep_previous"] for r in market.drop_guard(prev, cur, "store", "n", least=10).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": True, "f": False}


def test_events_return_to_an_old_price(spark):
    rows = [("s", 1, datetime(2026, 1, 1), 1), ("s", 1, datetime(2026, 1, 5), 2), ("s", 2, datetime(2026, 1, 6), 3), ("s", 1, datetime(2026, 1, 7), 4), ("s", 1, datetime(2026, 1, 20), 5)]
    df = spark.createDataFrame(rows, "series string, price int, at timestamp, id int")
    got = history.price_events(df, ["series"], ["price"], "at", "id").orderBy("first_seen").collect()
    assert [(r["price"], r["observations"]) for r in got] == [(1, 2), (2, 1), (1, 1), (1, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "log.txt").write_text("17000\tstart\nnoise\n18000\tend\tx\n")
    assert [tuple(r) for r in landed.log_lines(spark, str(tmp_path / "log.txt")).collect()] == [(17000, "start"), (18000, "end\tx")]
    docs = spark.createDataFrame([(1, "intro\n### Milch\n1 l 0,99\n#### Brot\n500 g"), (2, None)], "id long, text string")
    assert [(r["name"], r["body"]) for r in landed.markdown_sections(docs, "id", "text").orderBy("position").collect()] == [("Milch", "1 l 0,99"), ("Brot", "500 g")]
    tree = json.dumps({"a": [{"name": "Milch", "price": 0.99}, {"deep": {"title": "Brot", "offerPrice": "1,29"}}]})
    pages = spark.createDataFrame([(1, tree), (2, "{"), (3, None)], "id long, j string")
    assert sorted((r["name"], r["price"]) for r in landed.json_products(pages, "id", "j").collect()) == [("Brot", "1,29"), ("Milch", "0.99")]
    page = spark.createDataFrame([(1, "<title>T</title><div>Milch 0,99 €</div><script>x 1,00 €</script><p>Milch 0,99 €</p>")], "id long, h string")
    parsed = html.page_parts(page, "id", "h")
    assert parsed.first()["title"] == "T"
    assert [r["price"] for r in html.priced_blocks(parsed, "id").collect()] == ["0,99"]


def test_stream_equals_batch(spark, tmp_path):
    from offermill.streaming.events import keep_events

    rows = [("s", p, datetime(2026, 1, d), d) for d, p in ((1, 1), (2, 1), (4, 2), (9, 2), (25, 2), (26, 1))]
    df = spark.createDataFrame(rows, "series string, price int, at timestamp, id int")
    for i in range(3):
        df.where(F.col("id").isin(*[r[3] for r in rows[2 * i : 2 * i + 2]])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        keep_events(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["series"], ["price"], "at", "id").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/v2")).select("price", "first_seen", "last_seen", "observations")
    want = history.price_events(df, ["series"], ["price"], "at", "id").select("price", "first_seen", "last_seen", "observations")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["v1", "v2"]
