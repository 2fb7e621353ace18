"""Near-duplicates, fingerprints, recordings and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from edge import awkward, empty
from offermill.llm import audio, fingerprints, near_dedup
from offermill.llm.hashing import shingle_sets
from offermill.llm.queries import queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


def test_groups_equal_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    want, sets = components(texts, 85)
    got = queries()["op6_near_dedup"](spark, SF).toPandas()
    assert dict(zip(got["doc_id"], got["component_id"])) == want
    assert all(len(sets[r.doc_id]) == r.n_shingles and r.kept == (r.doc_id == want[r.doc_id]) for r in got.itertuples())


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies with different edits, linked in chains: some to many, some to one, some to none; buckets in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(220):
        words = base.copy()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(150)] = f"x{rng.randrange(30)}"
        texts[i] = " ".join(words)
    want, _ = components(texts, 85)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dedup.near_duplicates(df, percent=85).toPandas()
    assert dict(zip(got["doc_id"], got["component_id"])) == want
    assert 1 < len(set(want.values())) < 220


def repeated(seed):
    """(doc_id, text) rows in which ids repeat with equal, alike and other texts."""
    rng = random.Random(seed)
    bases = [[f"{c}{i}" for i in range(60)] for c in "abcde"]
    rows = []
    for i in range(60):
        words = rng.choice(bases).copy()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((rng.randrange(35), " ".join(words)))
    return rows + rng.sample(rows, 5) + [(40, None), (40, "one two"), (41, "One\ttwo"), (None, "one two")]


def groups_of_rows(rows, percent):
    """Component of each id: an id is one document with the links of all its texts."""
    texts = {k: t for k, (_, t) in enumerate(rows)}
    same, sets = components(texts, percent)
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    of = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            of.setdefault(same[k], []).append(i)
    for ids in of.values():
        for a, b in zip(ids, ids[1:]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}, sets


def test_repeated_ids_keep_the_links_of_all_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(5, a), (5, b), (9, b.replace("b79", "z")), (7, a.replace("a0 ", "z ")), (5, a)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).toPandas()
    assert set(got["component_id"]) == {5} and len(got) == 5 and got["kept"].sum() == 3
    for seed in (1, 2):
        rows = repeated(seed)
        want, sets = groups_of_rows(rows, 85)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).toPandas()
        assert len(got) == len(rows)
        assert all((np.isnan(r.doc_id) and np.isnan(r.component_id) and r.kept) or (r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)) for r in got.itertuples())
        assert Counter(got["n_shingles"]) == Counter(len(s) if rows[k][0] is not None else len(shingles(rows[k][1])) for k, s in sets.items())


def test_similarity_at_the_threshold_links(spark):
    """17 of 20 shingles in common are 85 %, and linked; 16 of 19 are less, and not."""
    words = lambda p, n, own: " ".join([*(f"{p}{i}" for i in range(n)), *(f"{p}{own}{i}" for i in range(3))])
    rows = [(1, words("a", 21, "")), (2, words("a", 21, "")[: -len(" a0 a1 a2")]), (3, words("b", 20, "")), (4, words("b", 20, "")[: -len(" b0 b1 b2")])]
    sets = [shingles(t) for _, t in rows]
    assert (len(sets[0] & sets[1]), len(sets[0] | sets[1])) == (17, 20) and (len(sets[2] & sets[3]), len(sets[2] | sets[3])) == (16, 19)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).toPandas()
    assert dict(zip(got["doc_id"], got["component_id"])) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_blocks_by_size(spark, monkeypatch):
    """Buckets are cut by shingles too, and texts are taken alone where they are long: the groups stay the same."""
    texts = {i: " ".join(f"w{j}" for j in range(i % 7, 300 + i % 7)) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, _ = components(texts, 85)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 500)
    got = near_dedup.near_duplicates(df, percent=85).toPandas()
    assert dict(zip(got["doc_id"], got["component_id"])) == want


def test_sketches_estimate_similarity():
    sets = shingle_sets([" ".join(map(str, range(a, a + 400))).encode() for a in (0, 40, 200, 1000)])
    s = near_dedup.sketches(sets)
    for i, j in ((0, 1), (0, 2), (0, 3)):
        truth = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
        assert abs((s[i] == s[j]).mean() - truth) < 0.12
    assert (near_dedup.sketches([sets[0][:3]]) != 0).all()


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    got = queries()["op8_fingerprints"](spark, SF).toPandas().set_index("doc_id")
    ids, off = sorted(texts, reverse=True), []
    assert len(got) == len(ids)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        a, b, m = texts[i], texts[after], len(texts[i]) // 2
        edited = a[: len(a) - m] + b[:m]
        r = got.loc[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(a, edited), r.near_next - jaccard(a, b)]
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.35
    by_text = {}
    for i in ids:
        by_text.setdefault(texts[i], set()).add(got.loc[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_every_row_has_a_fingerprint_and_a_next_one(spark):
    """Ids that repeat or are missing: each row is a document, in the order of id, length and text."""
    rows = [(5, "alpha beta gamma"), (5, "alpha beta gamma delta"), (5, "alpha beta gamma"), (9, None), (None, "nothing here"), (None, "nothing"), (-3, "éé日本 ab"), (2, "x" * 50), (2, "")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -len(r[1] or ""), [-ord(c) for c in r[1] or ""]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({f for v in by_text.values() for f in v}) == 7  # both empty texts have one


def test_fingerprints_have_64_draws(spark):
    """The signature is 64 draws long, all of them are compared, and shares are steps of 1/64."""
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g x")], "doc_id long, text string")
    got = fingerprints.edited_fingerprints(df).toPandas()
    assert set(got["fingerprint"].str.len()) == {4 * 64}
    a, b = got["fingerprint"]
    assert (got["near_next"] == sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)) / 64).all()


def test_words_that_occur_once_are_drawn_without_logarithms(spark):
    """Such a word stands where its hash says, and draws are still those of counts: shares meet the likeness of texts of repeated words."""
    words = spark.createDataFrame([(1, 11, 0.0), (1, 12, 0.0), (2, 11, 0.0)], "id long, word long, log_n double")
    got = {(r.id, r.block): [r[f"d{k}"] for k in range(fingerprints.BLOCK)] for r in fingerprints._least_draws(words, ["id"]).collect()}
    hashes = words.select("id", "word", F.explode(F.sequence(F.lit(0), F.lit(fingerprints.SAMPLES // fingerprints.BLOCK - 1))).alias("block"), *(F.shiftrightunsigned(F.xxhash64("word", "block", F.lit(k)), 1).alias(f"h{k}") for k in range(fingerprints.BLOCK)))
    want = hashes.groupBy("id", "block").agg(*(F.min(f"h{k}") for k in range(fingerprints.BLOCK))).collect()
    assert got == {(r[0], r[1]): list(r[2:]) for r in want}

    rng, rows, off = random.Random(5), [], []
    for i in range(300, 0, -1):
        a = Counter({f"w{i}x{j}": rng.choice([1, 2, 3, 8, 40]) for j in range(30)})
        rows.append((i, " ".join(a.elements()), a))
    for i in range(0, 300, 2):  # the next one: the same words, counted otherwise
        a = rows[i][2]
        b = Counter({w: rng.choice([n, 2 * n, n + 1, 1]) for w, n in a.items()})
        rows[i + 1] = (rows[i + 1][0], " ".join(b.elements()), b)
    near = {r.doc_id: r.near_next for r in fingerprints.edited_fingerprints(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i in range(0, 300, 2):
        off.append(near[rows[i][0]] - jaccard(rows[i][1], rows[i + 1][1]))
    assert abs(np.mean(off)) < 0.02 and 0.7 < np.std(off) / np.mean([np.sqrt(s * (1 - s) / 64) for s in (jaccard(rows[i][1], rows[i + 1][1]) for i in range(0, 300, 2))]) < 1.3


def tone_row(seed, n):
    rng = np.random.default_rng(seed)
    step, t = rng.integers(0, 12, n), np.arange(2 * audio.HOP)
    return np.concatenate([9000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t / audio.RATE) for k in step]).astype("<i2")


def test_recordings_are_aligned(spark):
    """An excerpt with noise is found at its place; other music is not."""
    whole = tone_row(1, 60)
    noisy = (whole[20 * audio.HOP :] + np.random.default_rng(2).normal(0, 300, len(whole) - 20 * audio.HOP)).astype("<i2")
    rows = [(20, noisy.tobytes()), (1, whole.tobytes()), (2, whole.tobytes()), (40, tone_row(9, 60).tobytes()), (3, None), (60, b"abc")]
    got = audio.aligned_recordings(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio").toPandas().set_index("id")
    assert (got.loc[20, "best_class"], got.loc[20, "best_offset"], got.loc[20, "n_links"]) == (1, 20, 1)
    assert got.loc[2, "class_id"] == 1 and got.loc[40, "n_links"] == 0 and got.loc[60, "n_links"] == 0 and len(got) == 6


def test_matches_in_blocks_equal_brute_force(spark, monkeypatch):
    """Blocks and parts of any size find what a count of all common integers finds."""
    monkeypatch.setattr(audio, "MATCHES", 7)  # in this process only: the tasks use the usual size
    rng = np.random.default_rng(3)
    rows = {k: rng.integers(0, 6, 30) for k in range(12)}
    rows[12] = np.concatenate([rng.integers(0, 6, 9), rows[0][5:]])
    expected = set()
    for q in (0, 4, 8, 12):
        for c in rows.keys() - {q}:
            a, b = rows[q], rows[c]
            seen = Counter(j - i for i in audio.begins(a).tolist() for j in audio.begins(b).tolist() if a[i] == b[j])
            votes, _, offset = max((n, -abs(o), o) for o, n in seen.items())
            if votes >= 3 and audio.alignment(a, b, offset) <= 0.05:
                expected.add((q, c, offset, votes))
    df = spark.createDataFrame([(k, v.tolist(), k % 4 == 0) for k, v in rows.items()], "class long, prints array<long>, query boolean")
    for block in (10, 1000):
        got = audio.matches(df, errors=0.05, block=block).collect()
        assert {(r.asked, r["class"], r.offset, r.votes) for r in got} == expected and len(got) == len(expected)
    assert expected
    index = audio.Asked([0], [rows[0]])
    assert {q for q, *_ in index.aligned(12, rows[12], 3, 0.05)} == {q for q, c, *_ in expected if (q, c) == (0, 12)}


def test_every_offset_with_votes_is_tried(spark):
    """Repeated motifs and held tones align where a count over all offsets says so."""
    rng = np.random.default_rng(8)
    motif, tail = rng.integers(0, 1 << 32, 6), rng.integers(0, 1 << 32, 20)
    rows = {0: np.concatenate([motif, tail[:3]]), 1: np.concatenate([motif[:4], rng.integers(0, 1 << 32, 9), tail[:5], motif, tail[:3]])}
    rows[2], rows[3] = np.concatenate([motif, tail[3:12], rng.integers(0, 1 << 32, 12)]), np.concatenate([tail[3:12], motif])
    rows |= {4: np.full(30, 77), 5: np.full(29, 77), 6: np.repeat([5, 77], [2, 25]), 8: np.repeat([9, 77, 1 << 31], [4, 20, 3]), 7: np.repeat([1, 9, 77], [3, 10, 20])}
    rows |= {k: rng.integers(0, 3, 25) * 0x55555555 for k in range(9, 20)}
    expected = {}
    for q in range(0, 20, 2):
        for c in rows.keys() - {q}:
            a, b = rows[q], rows[c]
            few = min(len(audio.begins(a)), len(audio.begins(b))) < audio.VOTES
            spots = [range(len(x)) if few else audio.begins(x).tolist() for x in (a, b)]
            seen = Counter(j - i for i in spots[0] for j in spots[1] if a[i] == b[j])
            good = [(n, -abs(o), o) for o, n in seen.items() if n >= audio.VOTES and audio.alignment(a, b, o) <= 0.25]
            if good:
                expected[q, c] = max(good)[2]
    df = spark.createDataFrame([(k, v.tolist(), k % 2 == 0) for k, v in rows.items()], "class long, prints array<long>, query boolean")
    got = audio.matches(df).collect()
    assert {(r.asked, r["class"]): r.offset for r in got} == expected and len(got) == len(expected)
    assert all(abs(r.error - audio.alignment(rows[r.asked], rows[r["class"]], r.offset)) < 1e-12 for r in got)
    assert expected[4, 5] == 0 and expected[2, 3] == -6


def test_awkward_tables(spark):
    df, none = awkward(spark), empty(spark)
    got = near_dedup.near_duplicates(df).toPandas()
    assert len(got) == df.count() and got[got["doc_id"].isin([1, 2, 3])]["kept"].all()
    assert set(got[got["doc_id"].isin([4, 5])]["component_id"]) == {4}
    assert near_dedup.near_duplicates(none).count() == 0
    assert fingerprints.edited_fingerprints(df).count() == df.count()
    assert fingerprints.edited_fingerprints(none).count() == 0
    one = fingerprints.edited_fingerprints(df.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0
    vectors = spark.createDataFrame([(1, [0.1, None]), (2, None), (None, [1.0]), (20, [float("nan")])], "vec_id long, embedding array<float>")
    assert audio.aligned_recordings(audio.sounded(vectors), "id", "audio").count() == 3


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        after = docs.toPandas()
        if name == "packing":
            assert set(after["doc_id"]) == set(before["doc_id"])
            break
        assert list(after.columns) == list(corpus_pipeline.COLUMNS)
        if name == "quality":
            bad = labels[labels["quality"] == 0].index
            assert len(set(after["doc_id"]) & set(bad)) <= 0.1 * len(bad) + 1
        if name == "near_dedup":
            want, _ = components(dict(zip(before["doc_id"], before["text"])), 80)
            assert set(after["doc_id"]) == set(want.values())
        if name == "secrets":
            assert len(after) == len(before) and not after["text"].str.contains("AKIA[A-Z0-9]{16}").any()


def test_pipeline_keeps_every_text_of_repeated_ids(spark):
    rows = repeated(3)
    df = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    want, _ = groups_of_rows(rows, 80)
    got = corpus_pipeline.near_dedup_stage(spark, df, SF).collect()
    expected = {(i, t) for i, t in rows if i is None or want[i] == i}
    assert {(r["doc_id"], r["text"]) for r in got} == expected and len(got) == len(expected)
    assert all(r["n_chars"] == min(k for k, row in enumerate(rows) if row == (r["doc_id"], r["text"])) for r in got)


def test_pipeline_bears_awkward_tables(spark):
    df = awkward(spark).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for table in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before = table.count()
            table = corpus_pipeline.written(stage(spark, table, SF), name)
            # filters keep rows or drop them; redaction keeps each; a document has one piece or more
            assert table.count() <= before or name == "packing"
            assert name != "secrets" or table.count() == before
        assert table.select("doc_id").distinct().count() <= 9 and (before > 0) == (table.count() > 0)
