"""Sharding, hard negatives and source divergence against plain Python."""

import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from edge import awkward, empty
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare

from offermill.llm import divergence, negatives, sharding

SMALL = "/root/testdata/sf0.001"


# sharding


def test_documents_lie_in_forty_shards(spark):
    got = sharding.op11_sharding(spark, SMALL)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows, want = got.collect(), {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(want.keys())
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(want[r.doc_id]) + 16, zlib.crc32(want[r.doc_id]), "rows", None) for r in rows)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(40)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_awkward_rows_all_have_a_place(spark):
    docs = awkward(spark).withColumn("Shard", F.lit("own")).withColumn("a.b", F.lit(1))
    rows = sharding.uniform_shards(docs, 4, seed=5).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s, n in enumerate((3, 3, 2, 2)) for i in range(n)] and all(r["a.b"] == 1 for r in rows)
    assert rows[0].asDict().keys() == {*docs.columns, "shard", "slot"} - {"Shard"} | {"shard"}
    assert sharding.uniform_shards(empty(spark), 4).count() == 0
    few = sharding.uniform_shards(awkward(spark), 40).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(i, 0) for i in range(10)]
    with pytest.raises(ValueError):
        sharding.uniform_shards(docs, 0)


def test_a_seed_gives_one_order_and_another_seed_another(spark):
    docs = spark.range(400).repartition(7)
    docs.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/docs")
    docs = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/docs")
    at = lambda seed: {r.id: (r.shard, r.slot) for r in sharding.uniform_shards(docs, 3, seed).collect()}
    one = at(1)
    assert one == at(1) and sum(one[i] == x for i, x in at(2).items()) < 40


def test_many_cells_and_blocks_keep_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    monkeypatch.setattr(sharding, "BLOCKS", 3)
    rows = sharding.uniform_shards(spark.range(0, 1000, 1, 11), 3).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s, n in enumerate((334, 333, 333)) for i in range(n)]


def test_every_row_is_as_likely_to_come_first(spark):
    first = Counter()
    for seed in range(12):
        by = {(r.shard, r.slot): r.id for r in sharding.uniform_shards(spark.range(0, 40, 1, 2), 20, seed).collect()}
        first.update(by[s, 0] for s in range(20))
    seen = [first[i] for i in range(40)]  # 240 draws among 40: chi square with 39 degrees of freedom
    assert sum((n - 6) ** 2 / 6 for n in seen) < 78


def test_matrix_has_the_margins_and_the_law_of_a_shuffle():
    rng = np.random.default_rng(3)
    rows, columns = [5, 0, 9, 4], [6, 6, 6]
    drawn, shuffled = Counter(), Counter()
    deck = np.repeat(np.arange(3), columns)
    for _ in range(20_000):
        m = sharding.matrix_lines(rng, rows, columns)
        assert [sum(line) for line in m] == rows and [sum(c) for c in zip(*m)] == columns
        drawn[m[0][0], m[2][1]] += 1
        rng.shuffle(deck)
        shuffled[int((deck[:5] == 0).sum()), int((deck[5:14] == 1).sum())] += 1
    keys = [k for k in drawn | shuffled if drawn[k] + shuffled[k] >= 20]
    assert sum((drawn[k] - shuffled[k]) ** 2 / (drawn[k] + shuffled[k]) for k in keys) < len(keys) + 5 * math.sqrt(2 * len(keys))


def test_large_populations_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(4)
    want = np.bincount(rng.hypergeometric(300, 500, 200, 20_000), minlength=201)
    monkeypatch.setattr(sharding, "SMALL", 1)
    got = np.bincount([sharding.hypergeometric(rng, 300, 500, 200) for _ in range(20_000)], minlength=201)
    use = want + got >= 20
    assert ((want - got)[use] ** 2 / (want + got)[use]).sum() < use.sum() + 5 * math.sqrt(2 * use.sum())
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 7, 7, 0) == 0
    big = [sharding.hypergeometric(rng, 25 * 10**8, 10**11, 10**8) for _ in range(50)]
    mean, spread = 10**8 * 25 / 1025, math.sqrt(10**8 * 25 / 1025 * 1000 / 1025)
    assert abs(np.mean(big) - mean) < spread and max(abs(x - mean) for x in big) < 6 * spread


# hard negatives


def plain_negatives(rows, low=30, high=90):
    whole = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 65536 for x in v):
            continue
        whole.append((vec_id, [math.floor(256 * x) for x in v], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    out, key = [], lambda r: (-r[1], r[0] is None, r[0] or 0, r[2])
    for i, (a, av, al) in enumerate(whole):
        if a is None or a % 100:
            continue
        score = [(b, sum(x * y for x, y in zip(av, bv)), j, bl) for j, (b, bv, bl) in enumerate(whole) if j != i]
        for p, ps, _, _ in sorted((r for r in score if r[3] == al), key=key)[:5]:
            hard = sorted((r for r in score if r[3] != al and low * ps <= 100 * r[1] <= high * ps), key=key)[:10]
            out += [(a, p, k + 1, n, ps, ns) for k, (n, ns, _, _) in enumerate(hard)]
    return out


def negatives_of(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)
    df = df.withColumns({"row": F.lit("x"), "anchor": F.lit(None).cast("string"), "score": F.lit(1.5)})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label).collect()]


def as_read(rows):
    """Components as floats of 32 bits, as the table holds them."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]


def test_hard_negatives_equal_sql(spark):
    assert compare(spark, "op12", negatives.op12_hard_negatives, negatives.SQL, SMALL) == ""


def test_hard_negatives_of_awkward_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 1, 6).tolist(), int(i) % 3) for i in range(0, 400, 4)]
    rows += [(7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * 6, 1), (10, [float("inf")] * 6, 2), (11, [1.0] * 6, None), (None, [2.0, 1.0, 0.0, 0.0, 1.0, 0.5], 0), (None, [1.0] * 6, 0)]
    rows += [(12, [], 1), (13, [1.0, 2.0], 2), (14, [1e30] * 6, 1), (15, [0.001] * 9, 1), (100, rows[0][1], 0), (200, rows[0][1], 1)]
    rows += [(16 + i, [1.0, -0.5, 0.25, 0.0, 1.0, 1.0], i % 2) for i in range(30)] + [(500, [0.0] * 6, 0), (600, [-3.0] * 6, 2)]
    want = plain_negatives(as_read(rows))
    assert len(want) > 50 and Counter(negatives_of(spark, rows)) == Counter(want)
    assert negatives_of(spark, []) == [] and negatives_of(spark, [(100, [1.0], 1)]) == []


def test_hard_negatives_tile_by_tile(spark, monkeypatch):
    """Ties across tiles, blocks and parts."""
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-2, 3, 4).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(0, 1000, 5)]
    want = Counter(plain_negatives(as_read(rows)))
    assert Counter(negatives_of(spark, rows)) == want and len(want) > 100
    for name, n in (("BLOCK_BYTES", 100), ("PART_BYTES", 2000), ("PARTS", 5)):
        monkeypatch.setattr(negatives, name, n)
    assert Counter(negatives_of(spark, rows)) == want


@pytest.mark.parametrize("few", [0.0, 0.5, 1.1])
def test_bit_planes_drop_nothing_that_is_wanted(monkeypatch, few):
    monkeypatch.setattr(negatives, "FEW", few)
    rng = np.random.default_rng(2)
    for span in (1, 3, 300, 1 << 23):
        a, x = rng.integers(-span, span + 1, (9, 12)), rng.integers(-span, span + 1, (200, 12))
        exact, fit = a @ x.T, rng.random((9, 200)) < 0.8
        i, j, s = negatives.sliced_products(a, x, fit, negatives.Foremost(9, 5))
        assert (s == exact[i, j]).all() and fit[i, j].all()
        for r in range(9):
            assert sorted(s[i == r], reverse=True)[:5] == sorted(exact[r][fit[r]], reverse=True)[:5]
        least, most = exact.min(1, keepdims=True) // 2, np.abs(exact.max(1, keepdims=True)) // 2
        i, j, s = negatives.sliced_products(a, x, fit, negatives.Between(np.hstack([least, most]), np.hstack([most, most * 2]), 5))
        for r in range(9):
            for lo, hi in ((least[r, 0], most[r, 0]), (most[r, 0], 2 * most[r, 0])):
                inside = lambda v, lo=lo, hi=hi: sorted((n for n in v if lo <= n <= hi), reverse=True)[:5]
                assert inside(s[i == r]) == inside(exact[r][fit[r]])


# source divergence


def plain_divergence(docs, least, added=5, top=50):
    by, often, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        words = [w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
        by[lang, source].update(words)
        often[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in often[lang].items() if n >= least}
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + added) // (sum(c[k] for k in kept) + added * len(kept)) for t in kept}
        p = {s: share(by[lang, s]) for s in sources}
        q = share(sum((by[lang, s] for s in sources), Counter()))
        for s in sources:
            far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(far)]
            more = sorted((-(p[s][t] - q[t]), t.encode(), t) for t in kept if by[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(more)]
    return out


def divergence_of(spark, docs, **kw):
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(9), "item": F.lit(None).cast("string")})
    return Counter(tuple(r) for r in divergence.source_divergence(df.repartition(3), **kw).collect())


def test_source_divergence_equals_sql(spark):
    assert compare(spark, "op13", divergence.op13_source_divergence, divergence.SQL, SMALL) == ""


def test_source_divergence_of_awkward_documents(spark):
    rng = np.random.default_rng(0)
    words = ["The", "the", "a-b", "Größe", "GRÖSSE", "naïve", "日本", "x\x00y", "ﬁn", "İ", "\x7f", "Z9z", "_", "\U0001f600", "[ab]", "{cd}"]
    docs = [(" ".join(rng.choice(words, int(rng.integers(0, 30)))), str(rng.choice(["en", "de"])), str(rng.choice(["a", "b", "Ä", ""]))) for _ in range(80)]
    docs += [(None, "en", "none"), ("", "fr", "x"), ("", "fr", "y"), ("only here", "it", "x"), ("the the", None, None), ("the", "", "s"), ("the THE", "en", None), ("zz " * 50_000, "en", "a"), ("q" * 200_000, "en", "b")]
    docs += [docs[0]] * 5
    for least in (1, 2, 10):
        want = Counter(plain_divergence(docs, least))
        assert len(want) > 20 and divergence_of(spark, docs, least=least) == want
    assert divergence_of(spark, docs, least=2, top=3, added=1) == Counter(plain_divergence(docs, 2, 1, 3))
    assert divergence_of(spark, docs, least=10**6) == Counter(plain_divergence(docs, 10**6))  # no kept terms: all distances 0
    assert divergence.source_divergence(empty(spark).withColumn("source", F.lit("s"))).count() == 0


def test_terms_are_counted_the_same_in_small_blocks_and_pieces(monkeypatch):
    docs = [("Ab cd " * n + "é" * n, "en", f"s{n % 3}") for n in range(40)] + [("", "en", "s0"), ("w" * 500, "en", "s1")]
    batch = pa.RecordBatch.from_pydict(dict(zip(("text", "lang", "source"), map(list, zip(*docs)))))
    total = lambda: Counter({(r["lang"], r["source"], r["term"], r["n"], r["docs"]): 1 for b in divergence._counted(iter([batch])) for r in b.to_pylist()})
    want = total()
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 40)
    assert total() == want and ("en", "s1", "ab", sum(n for n in range(40) if n % 3 == 1), 13) in want
