"""Classifiers on held-out rows and context-tree scores against a plain sequential tree."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from edge import awkward, empty
from offermill.llm import context_tree, quality, toxicity
from offermill.llm.queries import queries

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    marks = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")[label]
    got = queries()[name](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    rows = got[got["held_out"]].join(marks, how="inner")
    return rows["predicted"], rows[label]


def test_quality_on_held_out_rows(spark):
    p, y = held_out(spark, "op5_quality_classifier", "quality")
    assert (p == y).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    p, y = held_out(spark, "op1_toxicity", "toxic")
    assert (p == y).mean() > 0.9 and not ((p == 1) & (y == 0)).any()


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    pos = lambda n: np.hstack([np.ones((n, 1)), rng.normal(1.5, 1, (n, quality.FEATURES - 1))])
    neg = lambda n: np.hstack([np.ones((n, 1)), rng.normal(-1.5, 1, (n, quality.FEATURES - 1))])
    model = quality.PuModel().fit(pos(1500), np.vstack([pos(900), neg(600)]))
    assert abs(model.prior - 0.6) < 0.06
    assert (model.score(pos(500)) > 0.5).mean() > 0.97 and (model.score(neg(500)) < 0.5).mean() > 0.97


def test_gradient_of_the_risk_by_finite_differences():
    """Both branches: the risk itself, and where the negatives' estimate is below zero, minus that estimate alone."""
    rng = np.random.default_rng(4)
    p, u = rng.normal(0.5, 1, (40, 5)), rng.normal(0, 1, (60, 5))
    model = quality.PuModel(prior=0.4)
    seen = set()
    for scale in (0.1, 0.5, 3.0, 6.0):
        for w in (scale * rng.normal(size=5), scale * np.linalg.lstsq(np.vstack([p, u]), np.r_[np.ones(40), -np.ones(60)], rcond=None)[0]):
            low = model.negative_risk(w, p, u) < 0
            seen.add(low)
            of = (lambda v: -model.negative_risk(v, p, u)) if low else (lambda v: model.risk(v, p, u))
            want = [(of(w + h) - of(w - h)) / 2e-6 for h in 1e-6 * np.eye(5)]
            assert np.allclose(model._risk(w, p, u), want, atol=1e-6)
    u2 = np.vstack([p * 3] * 2) * -2  # unlabelled rows far on the negative side: the estimate falls below zero
    w = np.ones(5)
    model = quality.PuModel(prior=0.9)
    assert model.negative_risk(w, p + 3, u2 - 9) < 0
    want = [(-model.negative_risk(w + h, p + 3, u2 - 9) + model.negative_risk(w - h, p + 3, u2 - 9)) / 2e-6 for h in 1e-6 * np.eye(5)]
    assert np.allclose(model._risk(w, p + 3, u2 - 9), want, atol=1e-6)


def test_quality_where_every_document_is_marked(spark):
    """No document is without a mark: the unlabelled text is all of it, and good and bad are still told apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").select("doc_id"), "doc_id", "left_semi")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_classifier(docs, labels, F.col("doc_id") % 3 != 1).where("doc_id % 3 = 1").join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9


def toy(swap_strength):
    """One group is named in toxic sentences far more often than the others."""
    rows = [("you are scum and muslims are scum", 1)] * 40 + [("muslims met on monday", 1)] * 10 + [("christians met on monday", 0)] * 40 + [("jews and muslims met", 0)] * 5 + [("nice day in town", 0)] * 60
    model = toxicity.ToxicityModel([f for t, _ in rows for w in toxicity.words(t) for f in toxicity.features_of(w)], swap_strength=swap_strength)
    found = [model.row(t) for t, _ in rows]
    model.fit([np.array(list(c)) for c, _ in found], [np.array(list(c.values())) for c, _ in found], [n for _, n in found], np.array([y for _, y in rows], float))
    model.start()
    return model


def test_swaps_of_group_names_change_scores_less():
    gap = lambda m: abs(m.raw("muslims met in town") - m.raw("christians met in town"))
    assert gap(toy(50.0)) < 0.2 * gap(toy(0.0))
    assert toy(50.0).raw("you are scum") > 0


def test_penalty_is_the_mean_square_of_explicit_swaps():
    """Names in the texts, two of one set in one text, and texts without names, which have one put in: by rewriting the texts."""
    texts = ["muslims met on monday", "jews and muslims met jews", "old and young muslims", "nice day in town", "", "you are scum"]
    model = toy(1.0)
    model.weights = np.random.default_rng(0).normal(size=len(model.weights))
    model.start()
    squares = []
    for t in texts:
        if not toxicity.words(t) & toxicity._SET_OF.keys():
            t = f"{t} {toxicity.put_in(t)}"
        for a in toxicity.words(t) & toxicity._SET_OF.keys():
            for b in toxicity.IDENTITY_TERMS[toxicity._SET_OF[a]]:
                if a != b:
                    swapped = " ".join(b if w == a else w for w in t.split())
                    squares.append((model.raw(swapped) - model.raw(t)) ** 2)
    assert abs(model.penalty([model.row(t)[1] for t in texts]) - np.mean(squares)) < 1e-9


def test_neutral_mentions_are_no_false_positives(spark):
    """At the default strength, through the operator: toxic sentences name one group, neutral ones of held-out ids name all."""
    toxic = ["you are scum and muslims are scum", "vile muslims go away", "muslims are vermin and scum"]
    clean = ["nice day in town", "christians met on monday", "the market opens at nine", "jews sang in the hall", "we had soup for lunch"]
    neutral = [f"{g} {t}" for g in ("muslims", "christians", "jews", "hindus") for t in ("sang in the hall", "met on monday", "had soup for lunch")]
    rows = [(i, toxic[i % 3], 1) for i in range(60)] + [(100 + i, clean[i % 5], 0) for i in range(200)]
    held = [(1000 + i, t, 0) for i, t in enumerate(neutral)] + [(2000 + i, t, 1) for i, t in enumerate([*toxic, *(t.replace("muslims", "people") for t in toxic)])]
    docs = spark.createDataFrame([r[:2] for r in rows + held], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")

    def result(**options):
        got = toxicity.toxicity(docs, labels, F.col("doc_id") < 1000, **options).toPandas().set_index("doc_id")["score"]
        raw = np.log(got / (1 - got))
        by_group = raw[[1000 + i for i in range(12)]].to_numpy().reshape(4, 3)
        return np.ptp(by_group, axis=0).mean(), int((got[[1000 + i for i in range(12)]] >= 0.5).sum()), (got[[2000 + i for i in range(6)]] >= 0.5).mean()

    gap, wrong, recall = result()
    plain_gap, plain_wrong, plain_recall = result(swap_strength=0.0)
    assert gap < 0.1 * plain_gap and wrong == 0 < plain_wrong and recall >= plain_recall >= 0.5


def test_features_of_all_labelled_rows_count(spark, monkeypatch):
    """More labelled rows than any sample has: a word of some of them is counted in each."""
    n = 41_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "vile scum").otherwise("nice day").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    seen, count = [], toxicity.label_counts
    monkeypatch.setattr(toxicity, "label_counts", lambda marked: (seen.append(marked.count()), count(marked))[1])
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    model.start()
    assert seen == [n] and model.raw("scum") > 0 > model.raw("nice")


def test_labels_meet_texts_either_way(spark, monkeypatch):
    """Sent to the texts or shuffled with them: the model is the same."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    sent = toxicity.fit_toxicity(docs, labels, F.lit(True))
    monkeypatch.setattr(toxicity, "MOST_SENT", 0)
    shuffled = toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert sent.index == shuffled.index and np.array_equal(sent.weights, shuffled.weights) and sent.bias == shuffled.bias != 0


def sequential(training, text):
    """log2 of the tree's prediction of a text after training: every node by hand, float by float."""
    depth = context_tree.DEPTH
    nodes: dict = {}

    def bits(data):
        data = bytes([255]) * depth + data + bytes([255])
        for i in range(depth, len(data)):
            for k in range(8):
                yield bytes(data[i - d] for d in range(1, depth + 1)), (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    for t in training:
        for context, known, bit in bits(t):
            for d in range(depth + 1):
                nodes.setdefault((context[:d], known), [0, 0])[bit] += 1
    kids: dict = {}
    for context, known in nodes:
        if context:
            kids.setdefault((context[:-1], known), []).append((context, known))
    lg = math.lgamma
    own = {k: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi) for k, (a, b) in nodes.items()}
    whole, weight = {}, {}
    for k in sorted(nodes, key=lambda k: -len(k[0])):
        if len(k[0]) == depth:
            whole[k], weight[k] = own[k], 1.0
        else:
            below = sum(whole[c] for c in kids[k])
            both = np.logaddexp(own[k], below)
            whole[k], weight[k] = both - math.log(2), math.exp(own[k] - both)
    total = 0.0
    for context, known, bit in bits(text):
        p = None
        for d in range(depth, -1, -1):
            k = (context[:d], known)
            if k in nodes:
                n = nodes[k]
                mine = (n[bit] + 0.5) / (sum(n) + 1)
                p = mine if p is None else weight[k] * mine + (1 - weight[k]) * p
        total += math.log2(0.5 if p is None else p)
    return total


def test_scores_equal_a_plain_tree(spark):
    rows = [(1, "The cat sat on the mat."), (2, "the hat\nof the Cat"), (3, "unseen words here"), (4, ""), (5, None), (6, "the mat is é")]
    got = context_tree.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 3, chunk_bytes=30).toPandas().set_index("doc_id")
    data = {i: (t or "").lower().encode() for i, t in rows}
    training = [t for i, t in data.items() if i != 3]
    for i, t in data.items():
        assert abs(got.loc[i, "score"] / math.log10(2) - sequential(training, t)) < 1e-6
    c = Counter(w for t in training for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in data.items():
        tokens = [*t.split(), None]
        assert abs(got.loc[i, "base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)) < 1e-9
        assert (got.loc[i, "n_tokens"], got.loc[i, "n_known"], got.loc[i, "train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)


def test_query_of_context_trees(spark, tmp_path):
    """The registered query over a small table: folds, repeated and null ids, empty and null texts, by the plain tree and plain counts."""
    rows = [(i, f"Part {i % 4} of the {'long ' * (i % 3)}story\n") for i in range(12)] + [(3, "another text with the id three"), (None, "no id"), (20, ""), (21, None), (22, "é 日本 of the")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries()["op9_context_tree"](spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"]))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len((r[1] or "").encode())))
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    data = [(i, (t or "").lower().encode()) for i, t in rows]
    training = [t for i, t in data if fold(i) != 1]
    c = Counter(w for t in training for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for (i, t), r in zip(data, got):
        tokens = [*t.split(), None]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, fold(i) == 1, len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)) < 1e-9
        assert abs(r["score"] / math.log10(2) - sequential(training, t)) < 1e-6


def test_packing_of_keys():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.int64), np.array([-1]), np.unique(rng.integers(-(2**62), 2**62, 999)), np.array([-(2**63), 0, 2**63 - 1])):
        assert (context_tree.unpacked_keys(context_tree.packed_keys(keys)) == keys).all()
        places = sorted(p for _, at in context_tree.by_bucket(context_tree.WORD, keys, 7) for p in at)
        assert places == list(range(len(keys)))


def test_bytes_five_and_six_back_tell(spark):
    """What follows is known only by a byte five, or six, places before it."""
    for same in ("abcd", "abcde"):
        rows = [(i, f"{'12'[i % 2]}{same}{'pq'[i % 2]}") for i in range(20)] + [(100, f"1{same}p"), (101, f"1{same}q")]
        got = context_tree.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).toPandas().set_index("doc_id")["score"]
        assert got[100] > got[101] + 0.5


def test_predictions_add_up_to_one():
    keys = np.array([(97 << 8 * context_tree.DEPTH) | b for b in range(256)], np.int64)
    n = np.array([zlib.crc32(bytes([b])) % 5 for b in range(256)])
    keys, n = keys[n > 0], n[n > 0]
    p = context_tree.predictions(context_tree.subtree(keys, n), np.array([(97 << 8 * context_tree.DEPTH) | b for b in range(256)], np.int64))
    assert abs(p.prod(1).sum() - 1) < 1e-9


def test_awkward_tables(spark):
    df, none = awkward(spark), empty(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, None, 1), (None, 1, 1), (7, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    everywhere = F.lit(True)
    for op in (lambda d, m: quality.quality_classifier(d, m, everywhere), lambda d, m: toxicity.toxicity(d, m, everywhere)):
        assert op(df, labels).count() == op(df, labels.limit(0)).count() == df.count()
        assert op(none, labels).count() == 0
    assert context_tree.scored(df, everywhere).count() == df.count()
    assert context_tree.scored(none, everywhere).count() == 0
    got = context_tree.scored(df, F.lit(False)).toPandas()
    assert np.allclose(got["score"], -8 * math.log10(2) * (got["n_bytes"] + 1))
    assert isinstance(got, pd.DataFrame)
