"""Versioned tables, streams of observations and history from snapshots, against plain Python."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offermill.operators import backfill, history
from offermill.sources.versions import Conflict, VersionedTable, by_key
from offermill.streaming.series import keep_series

SF = "/root/testdata/sf0.001"


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# versions


def test_a_version_stays_whole_and_a_write_costs_its_buckets(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=8)
    with pytest.raises(ValueError):
        t.read()
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    first = [(i, "a") for i in range(50)]
    assert t.write(frame(first), by_key(["k"])) == 0
    before = files(tmp_path)
    assert t.write(frame([(3, "b"), (99, "c")]), by_key(["k"])) == 1
    new = set(files(tmp_path)) - set(before)
    assert all(files(tmp_path)[p] == n for p, n in before.items()) and 1 <= len({p.parent.name for p in new}) <= 2
    assert rows_of(t.read(0)) == Counter(first) and rows_of(t.read()) == Counter([(i, "b" if i == 3 else "a") for i in range(50)] + [(99, "c")])
    assert t.write(frame([(3, None), (None, "n")]), by_key(["k"])) == 2 and t.write(frame([(None, "m")]), by_key(["k"])) == 3
    assert rows_of(t.read().where("k is null or k = 3")) == Counter([(3, None), (None, "m")])
    assert t.write(frame([(i, None) for i in range(50)]), lambda old, new: old.join(new.select("k"), "k", "left_anti")) == 4  # buckets may become empty
    assert rows_of(t.read()) == Counter([(99, "c"), (None, "m")])
    assert t.vacuum(keep=1) >= 1 and t.versions() == [4] and rows_of(t.read()) == Counter([(99, "c"), (None, "m")])
    t.write(frame([]), by_key(["k"]))
    assert t.read().count() == 2


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=4)
    frame = spark.createDataFrame([(i, i) for i in range(20)], "k long, v long")
    t.write(frame, by_key(["k"]))

    def die(_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(t, "_publish", die)
        with pytest.raises(OSError):
            t.write(frame.selectExpr("k", "v + 1 as v"), by_key(["k"]))
    assert t.versions() == [0] and rows_of(t.read()) == rows_of(frame)
    assert t.vacuum() == 1  # what the dead write left
    with monkeypatch.context() as m:  # two writers that saw the same last version: one of them fails
        old = t.manifest()
        t.write(frame, by_key(["k"]), mark="x")
        m.setattr(t, "manifest", lambda version=None: old)
        with pytest.raises(Conflict):
            t.write(frame, by_key(["k"]))
    assert t.versions() == [0, 1] and t.write(frame, by_key(["k"]), mark="x") == 1 and t.versions() == [0, 1]
    with pytest.raises(ValueError):
        t.write(frame.where("k = 0"), lambda old, new: frame)


def test_old_formats_are_read_and_move_on(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    VersionedTable(spark, at, ["k"], 4).write(spark.createDataFrame([(i, str(i)) for i in range(20)], "k long, v string"), by_key(["k"]))
    up = (lambda df: df.selectExpr("k", "cast(v as int) * 2 as w"),)
    t = VersionedTable(spark, at, ["k"], 4, up)
    assert rows_of(t.read()) == Counter((i, 2 * i) for i in range(20))
    t.write(spark.createDataFrame([(3, -1)], "k long, w int"), by_key(["k"]))
    formats = [w["format"] for w in t.manifest()["writes"].values()]
    assert rows_of(t.read()) == Counter((i, -1 if i == 3 else 2 * i) for i in range(20)) and sorted(formats) == [0, 1]


# streams

SCHEMA = "id long, store string, product long, price double, until string, ts timestamp"


def events_by_stream(spark, path, batches, **kw):
    (path / "in").mkdir(parents=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path / f"part{i}"))
        for p in (path / f"part{i}").glob("*.parquet"):
            p.rename(path / "in" / f"{i}.parquet")
        import os

        os.utime(path / "in" / f"{i}.parquet", (10**9 + i, 10**9 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{path}/in")
    table = VersionedTable(spark, f"file://{path}/table", ["store", "product"], buckets=4)
    run = lambda: keep_series(stream, table, f"file://{path}/checkpoint", ["store", "product"], ["price", "until"], "ts", "id", "2 days", **kw).awaitTermination()
    run()
    return table, run


def observations(rng, n=120):
    """Observations of some series over two months, each with an hour of arrival up to two days late."""
    out = []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 60), seconds=rng.randrange(2))
        out.append((ts + timedelta(hours=rng.randrange(47)), (i, rng.choice(["A", None]), rng.randrange(2), rng.choice([1.0, 1.0, 1.0, 2.0, None]), rng.choice([None, None, None, "x"]), ts)))
    return [r for _, r in sorted(out, key=lambda x: x[0])]


@pytest.mark.parametrize(("sizes", "dated"), [((1.0,), ()), ((0.1, 0.05, 0.3, 0.2, 0.35), ()), ((0.3, 0.3, 0.4), ("until",))])
def test_any_split_of_a_stream_gives_the_same_events(spark, tmp_path, sizes, dated):
    rng = random.Random(len(sizes))
    rows, batches, at = observations(rng), [], 0
    for s in sizes:
        n = round(s * len(rows))
        batches.append(rows[at : at + n])
        at += n
    batches[-1] += rows[at:]
    table, run = events_by_stream(spark, tmp_path, batches, dated=dated)
    whole = history.price_events(spark.createDataFrame(rows, SCHEMA), ["store", "product"], ["price", "until"], "ts", "id", dated=F.col("until").isNotNull() if dated else None)
    got = table.read()
    assert rows_of(got.select(whole.columns)) == rows_of(whole)
    closed = got.where("closed").select("store", "product", "last_seen").collect()
    last = {(r[1], r[2]): max(x[5] for x in rows if x[1:3] == r[1:3]) for r in rows}
    assert all(r.last_seen <= last[r.store, r.product] for r in closed) and (len(sizes) == 1 or closed)
    versions = table.versions()
    run()  # nothing new has come
    assert table.versions() == versions


def test_silent_series_are_closed_and_late_rows_left_out(spark, tmp_path):
    day = lambda n, h=0: datetime(2024, 1, 1) + timedelta(days=n, hours=h)
    row = lambda i, product, price, ts: (i, "A", product, price, None, ts)
    batches = [[row(1, 1, 1.0, day(0)), row(2, 2, 5.0, day(0))], [row(3, 1, 2.0, day(5)), row(4, 1, 1.0, day(4))], [row(5, 3, 9.0, day(30))], [row(6, 2, 5.0, day(1)), row(7, 3, 9.0, day(31))]]
    table, _ = events_by_stream(spark, tmp_path, batches)
    got = sorted((r.product, r.price, r.first_seen, r.last_seen, r.observations, r.closed) for r in table.read().collect())
    assert got == [(1, 1.0, day(0), day(4), 2, True), (1, 2.0, day(5), day(5), 1, True), (2, 5.0, day(0), day(0), 1, True), (3, 9.0, day(30), day(31), 2, False)]


# snapshots


def test_backfill_equals_a_loop(spark):
    rng = random.Random(5)
    offer = StructType().add("product", "string").add("market", "string").add("price", "double").add("until", "string").add("sure", "double")
    docs, kinds = [], []
    for n in range(90):
        offers = [{"product": rng.choice("pqr"), "market": rng.choice("MN"), "price": rng.choice([1.0, 1.0, 1.0, 1.0, 1.0, 2.0, None, -1.0]), "until": rng.choice([None] * 7 + ["2024-02"]), "sure": rng.choice([1.0, 0.9, 0.9, 0.5])} for _ in range(rng.randrange(6))]
        body = rng.choice([json.dumps({"offers": offers})] * 5 + ["{", None, "[1]", json.dumps({"other": 1})])
        docs.append((n, datetime(2024, 1, 1) + timedelta(hours=n * 20), body))
        kinds.append((offers, body is not None and body.startswith('{"offers"')))

    # the reference's pass, one price after the other
    want, last, made = defaultdict(Counter), {}, []
    for (n, at, _), (offers, readable) in zip(docs, kinds):
        for o in offers if readable else ():
            want[n]["raw"] += 1
            if o["sure"] < 0.8 or o["price"] is None or o["price"] <= 0:
                want[n]["rejected"] += 1
                continue
            before, values = last.get((o["product"], o["market"])), (o["price"], o["until"])
            if before and before["values"] == values and (o["until"] or at - before["last"] <= timedelta(days=8)):
                before["last"], before["n"] = at, before["n"] + 1
                want[n]["merged"] += 1
                continue
            event = {"key": (o["product"], o["market"]), "values": values, "first": at, "last": at, "n": 1, "archived": o["market"] == "N"}
            last[o["product"], o["market"]] = event
            made.append(event)
            want[n]["archived" if event["archived"] else "inserted"] += 1

    df = spark.createDataFrame(docs, "sha int, date timestamp, doc string")
    rows, log = backfill.revision_offers(df, "sha", "date", "doc", offer)
    assert {(r.revision, r.readable, r.offers) for r in log.collect()} == {(n, ok, len(o) if ok else 0) for n, (o, ok) in enumerate(kinds)}
    reason = F.when(F.col("sure") < 0.8, "uncertain").when(~F.coalesce(F.col("price") > 0, F.lit(False)), "invalid")
    fated = backfill.judged(rows, ["product", "market"], ["price", "until"], reason, F.col("market") == "M", ["until"], ["revision", "place"])
    got = {r.revision: r.asDict() for r in backfill.counted(fated, ["revision"]).collect()}
    assert {n: {k: c[k] for k in ("raw", "inserted", "merged", "archived", "rejected")} for n, c in want.items()} == {n: {k: v for k, v in r.items() if k != "revision"} for n, r in got.items()}
    assert all(r["raw"] == r["inserted"] + r["merged"] + r["archived"] + r["rejected"] for r in got.values()) and sum(c["merged"] for c in want.values()) > 5
    events = backfill.events_of(fated, ["product", "market"], ["price", "until"])
    assert rows_of(events) == Counter((*e["key"], *e["values"], e["archived"], e["first"], e["last"], e["n"]) for e in made)

    # neighbours: a snapshot that can't be read is none
    held = [(n, {o["product"] + o["market"]: None for o in offers}, offers) for n, (offers, ok) in enumerate(kinds) if ok]
    least = lambda offers, k: min((o["price"] for o in offers if o["product"] + o["market"] == k and o["price"] is not None), default=None)
    changed = {}
    for i, (n, keys, offers) in enumerate(held):
        old, before = (held[i - 1][1], held[i - 1][2]) if i else ({}, [])
        same = sum(least(offers, k) == least(before, k) for k in keys if k in old)
        changed[n] = (sum(k not in old for k in keys), sum(k not in keys for k in old), sum(k in old for k in keys) - same, same)
    assert {r.revision: (r.added, r.gone, r.changed, r.same) for r in backfill.changes(rows, log, ["product", "market"], "price").collect()} == changed


def test_raw_prices_are_all_accounted_for(spark):
    from offermill.plans import registry

    got = registry.queries()["backfill_by_revision"](spark, SF).agg(*(F.sum(c) for c in ("raw", "inserted", "merged", "archived", "rejected"))).first()
    assert got[0] == sum(got[1:]) and min(got) > 100
    assert got[1] + got[3] == registry.queries()["backfill_events"](spark, SF).count()


def test_offers_meet_sums_of_events(spark):
    """Sums equal those of the joined rows, and one key of 3000 offers and 3000 events makes a row for each offer."""
    rng = random.Random(3)
    row = lambda i: (i, rng.choice([None, "", "p1", "p2"]), rng.choice(["c1", "c2", None]), rng.choice([None, "g1", "g2"]), rng.choice([True, False, None]), rng.choice(["l", "kg", None]), rng.choice([None, 3, 5]))
    schema = "id long, product_id string, canonical_id string, gtin string, organic boolean, unit_label string, price long"
    offers, events = (spark.createDataFrame([row(i // 2) for i in range(120)], schema) for _ in range(2))
    one = history.of_offer(offers, events, "id", ["price"]).groupBy("id").agg(F.count("*").alias("matched"), F.min("price").alias("least"))
    two = history.indexed(offers, events, "id", ["price"]).groupBy("id").agg(F.count("*").alias("reached"))
    assert Counter(map(tuple, history.summed_of_offer(offers, events, "id", "price").collect())) == Counter(map(tuple, one.collect()))
    assert Counter(map(tuple, history.summed_indexed(offers, events, "id").collect())) == Counter(map(tuple, two.collect()))
    hot = spark.range(3000).select("id", *(F.lit(v).alias(c) for c, v in (("product_id", "p"), ("canonical_id", "c"), ("gtin", "g"), ("organic", True), ("unit_label", "kg"))), F.col("id").alias("price"))
    got = history.summed_of_offer(hot, hot, "id", "price")
    assert got.count() == 3000 and got.agg(F.sum("matched")).first()[0] == 3000**2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3  # before the joins, for both ids, and after


def test_a_bucket_is_written_by_more_than_one_task(spark, tmp_path):
    """What a task sorts is not a whole bucket, and the rows are the same."""
    on = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=2)
        table.write(spark.range(500), lambda _, new: new)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", on)
    assert sorted(r.id for r in table.read().collect()) == list(range(500))
    assert len(list(tmp_path.glob("t/data/*/bucket=0/*.parquet"))) > 1


def test_snapshots_are_made_and_parsed_once(spark):
    """The result of revision_changes reads what was kept of the parsed snapshots, not the line items again for each count."""
    from offermill.plans import registry

    df = registry.queries()["revision_changes"](spark, SF)
    assert not any("lineitem" in f for f in df.inputFiles()) and "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() > 100


def test_a_series_has_one_value_of_state_and_keeps_large_numbers(spark):
    """A batch of a series reads and writes its state once; rows come one by one, so that numbers beside nulls stay whole."""
    from pyspark.sql import Row
    from pyspark.sql.types import LongType, StructField

    from offermill.streaming.series import SeriesRuns

    class Store:
        value, calls, timers = None, [], []

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 2

    store, big = Store(), 2**60 + 1
    runs = SeriesRuns([StructField("price", LongType())], StructField("id", LongType()), 10**9, [])
    runs.init(store)
    rows = [Row(micros__=m, id=i, price=p) for m, i, p in [(1000, 1, big), (5000, 3, None), (3000, 2, big), (6000, None, big)]]
    got = [(r.price, r["first__"], r["last__"], r.observations, r.number, r.closed) for r in runs.handleInputRows(("k",), iter(rows), Times())]
    assert got == [(big, 1000, 3000, 2, 0, False), (None, 5000, 5000, 1, 1, False), (big, 6000, 6000, 1, 2, False)]
    assert store.calls == ["get", "update"] and len(store.timers) == 1
    later = list(runs.handleInputRows(("k",), iter([Row(micros__=2500, id=9, price=big - 1)]), Times()))
    assert [(r.price, r.observations) for r in later] == [(big, 1), (big - 1, 1), (big, 1), (None, 1), (big, 1)] and len(store.timers) == 1
    closed = list(runs.handleExpiredTimer(("k",), Times(), None))
    assert len(closed) == 5 and all(r.closed for r in closed) and store.value is None
