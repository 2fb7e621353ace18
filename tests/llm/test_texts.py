"""Token counts, secrets, packing and segmentation against their libraries or brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edge import awkward, empty
from offermill.llm import packing, secrets, sentencepieces, token_counts
from offermill.llm.queries import queries

SF = "/root/testdata/sf0.001"
TEXT = st.lists(st.sampled_from(["the", " ", "  ", "\n", "\t", "Don't", "'ll", "é", "日本", "<|endoftext|>", "12", "...", "x" * 70, " ", "Σ", "İ", "á"]), max_size=20).map("".join)


@pytest.fixture(scope="module")
def counter():
    c = token_counts.counter_of(public_tokenizers.path("byte_bpe_50k.json"))
    c.start()
    return c


@pytest.fixture(scope="module")
def encoder():
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    e.start()
    return e


BYTE, WORD = (Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(counter, text):
    assert counter.count(text) == len(BYTE.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_equal_the_library(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == WORD.encode(text, add_special_tokens=False).ids


def test_whole_tokens_are_proven(counter):
    for s in random.Random(0).sample(sorted(counter.whole), 500):
        assert len(counter.vocabulary.merged(s)) == 1


def test_token_counts_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    got = queries()["op10_token_counts"](spark, SF).toPandas()
    assert len(got) == len(docs)
    for r in got.itertuples():
        n = len(BYTE.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 1024)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], b, e) for b, k, e in sorted(out)]


BITS = ["password", "Passwd", "secret", "TOKEN", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "0123456789abcdef" * 2, "abcdef0123456789abcdef01", "ABCDEFGH23456789", "abc", "abcdef", "é", "日", "-", ".", "\n", "ghp_" + "a1" * 20]


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner()


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
def test_base_spans_equal_the_expressions(scanner, text):
    assert [s for s in scanner.spans(text) if s[0] in ("assign", "access", "hex")] == base_spans(text)


def test_secrets_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    for r in queries()["op3_secret_scan"](spark, SF).toPandas().itertuples():
        want = base_spans(docs[r.doc_id])
        n = Counter(k for k, *_ in want)
        joined = ",".join(f"{k}:{b}:{e}" for k, b, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_private_keys_go_whole(scanner, spark):
    """Header, body and last line; without the last line as far as the body's characters go; prose around it stays."""
    body = "MIIEvQIBADANBgkq/+=\nhkiG9w0BAQ\n"
    whole = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}-----END RSA PRIVATE KEY-----"
    cut = f"-----BEGIN PRIVATE KEY-----\n{body}"
    escaped = "-----BEGIN EC PRIVATE KEY-----\\nQUJD\\n-----END EC PRIVATE KEY-----"
    texts = [f"é vor {whole} nach {whole}.", f"a {cut}-- b", f'{{"k": "{escaped}"}}', "-----BEGIN PRIVATE KEY----- nur -----BEGIN PRIVATE KEY----- so", f"{cut} viel Text -- und {whole}", "-----BEGIN CERTIFICATE-----\nMIIE\n-----END CERTIFICATE-----"]
    found = [[t[b:e] for k, b, e in scanner.spans(t) if k == "private_key"] for t in texts]
    header = "-----BEGIN PRIVATE KEY-----"
    assert found == [[whole, whole], [cut], [escaped], [header, header], [cut, whole], []]
    clean = [r["text"] for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert clean[0] == "é vor [SECRET] nach [SECRET]." and all("MIIEv" not in t and "QUJD" not in t and "hkiG" not in t for t in clean[:5]) and clean[5] == texts[5]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "x token = abcdef0123456789abcdef01 y"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(df).orderBy("doc_id").collect()] == ["x [SECRET] y", None, "clean"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=14))
def test_packing_keeps_every_piece(counts):
    plan = packing.pack_lengths(counts, 40)
    packed = Counter()
    for _, times, lengths in plan.bins:
        assert sum(lengths) <= 40
        for n in lengths:
            packed[n] += times
    assert packed == Counter(counts)
    assert plan.sequences >= -(-sum(n * k for n, k in counts.items()) // 40)


def fewest(lengths, capacity):
    """Fewest bins by trying all ways."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_never_costs_a_sequence(lengths):
    plan = packing.Plan(Counter(lengths), 20)
    fixed = plan.reduce()
    rest = sorted((n for n, k in plan.left.items() for _ in range(k)), reverse=True)
    assert fixed + fewest(rest, 20) == fewest(sorted(lengths, reverse=True), 20)


def test_bins_are_bounded_by_lengths(monkeypatch):
    """Where two pieces fit beside each and three do not, alike sets are one bin; packed as one at a time."""
    counts = {n: 200 + n % 7 for n in range(1300, 1366)}
    plan = packing.pack_lengths(counts, 4096)
    assert len(plan.bins) < 12 * len(counts)
    monkeypatch.setattr(packing.Plan, "repeats", lambda self, lengths: 1)
    single = packing.pack_lengths(counts, 4096)
    total = lambda p: sum((Counter({b: t}) for _, t, b in p.bins), Counter())
    assert len(single.bins) > 3000 and total(plan) == total(single) and plan.sequences == single.sequences


def check_packing(docs, got):
    for doc_id, rows in got.sort_values("piece").groupby("doc_id"):
        ids = [*WORD.encode(docs[doc_id], add_special_tokens=False).ids, 1]
        assert rows["length"].sum() == len(ids) and (rows["start"].to_numpy() == 4096 * np.arange(len(rows))).all()
        for r in rows.itertuples():
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length <= 4096 and zlib.crc32(part.tobytes()) == r.ids_crc32
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert (rows["offset"].to_numpy() == np.concatenate([[0], rows["length"].cumsum()[:-1]])).all() and rows["length"].sum() <= 4096


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    got = queries()["op7_best_fit_packing"](spark, SF).toPandas()
    assert set(got["doc_id"]) == set(docs.index)
    check_packing(docs, got)
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1


def all_ways(pieces, text):
    ends = pieces.arcs(text)

    def go(e):
        return [(0.0, ())] if not e else [(s + x, ids + own) for b, x, own in ends[e] for s, ids in go(b)]

    return sorted(go(len(text)), reverse=True)


@settings(max_examples=150, deadline=None)
@given(st.text("theinaor é日 ", min_size=1, max_size=9))
def test_n_best_equal_all_ways(text):
    own = sentencepieces.segmenter_of(public_tokenizers.path("piece_bpe_32k.model"), 4)
    own.start()
    ids, best = own.segment(text)
    full = sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE)
    assert [round(s, 4) for s, _ in best] == [round(s, 4) for s, _ in all_ways(own.pieces, full)[:4]]
    assert own.pieces.decode(ids) == text


def test_segmentation_of_documents(spark):
    got = queries()["op2_sentencepiece_n_best"](spark, SF).toPandas()
    assert got["round_trip"].all()
    assert all(list(s) == sorted(s, reverse=True) for s in got["scores"])


def test_awkward_tables(spark):
    df, none = awkward(spark), empty(spark)
    for op in (token_counts.token_counts, secrets.secret_spans, packing.packed_documents, sentencepieces.n_best_segmentations):
        assert op(df).count() >= 10
        assert op(none).count() == 0
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df).collect()}
    assert got[1] == got[2] == 0
    packed = packing.packed_documents(df).toPandas()
    assert packed[["sequence_id", "offset"]].drop_duplicates().shape[0] == len(packed)


@settings(max_examples=80, deadline=None)
@given(st.text("theinaor é日 ", min_size=1, max_size=9))
def test_n_best_ways_themselves(text):
    """Each of the n best comes with its own ids: different ones, that spell the text and have the score that is said."""
    own = sentencepieces.segmenter_of(public_tokenizers.path("piece_bpe_32k.model"), 4)
    own.start()
    ways, scores = own.segmentations(text)
    every = {ids: s for s, ids in all_ways(own.pieces, sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE))}
    found = [tuple(w.tolist()) for w in ways]
    assert len(set(found)) == len(found) == min(4, len(every)) and all(own.pieces.decode(w) == text for w in found)
    assert all(abs(every[w] - s) < 1e-3 for w, s in zip(found, scores))


def test_query_has_all_ways(spark):
    got = queries()["op2_sentencepiece_n_best"](spark, SF).toPandas()
    assert all(len(w) == len(s) and w[0] == c and len(set(w)) == len(w) for w, s, c in zip(got["ways_crc32"], got["scores"], got["ids_crc32"]))


@settings(max_examples=60, deadline=None)
@given(st.text("theinaor é日▁ ", min_size=0, max_size=12))
def test_round_trips_of_all_ways(text):
    own = sentencepieces.segmenter_of(public_tokenizers.path("piece_bpe_32k.model"), 4)
    own.start()
    ways, scores, same = own.decoded(text)
    assert same == all(own.pieces.decode(w.tolist()) == text for w in ways) and len(ways) == len(scores)


def test_ids_of_ways_are_digested_where_they_are_made(spark):
    """The query's digests are those of the operator's ids, and these are sent to no second Python worker."""
    query = queries()["op2_sentencepiece_n_best"](spark, SF)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "ArrowEvalPython" not in plan
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    digest = {r.doc_id: (r.n_pieces, r.ids_crc32, list(r.ways_crc32)) for r in query.collect()}
    for r in sentencepieces.n_best_segmentations(some).collect():
        sums = [zlib.crc32(np.array(w, "<u4").tobytes()) for w in r.ways]
        assert digest[r.doc_id] == (len(r.ids), sums[0], sums) and list(r.ids) == list(r.ways[0])


def test_workers_remember_and_make_words_with_marks_of_known_parts(monkeypatch):
    """A worker's next task begins with what the last one found; marks after a known word are no new word, and the best way is the same."""
    own = sentencepieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 4)
    own.start()
    for stretch in ("▁tionedre,%%%", "▁hen.", "é&&&", "▁▁(a)", "日,a", "▁a日", "$", "▁"):
        score, ids, loss = own.pieces.best(stretch)
        packed = own.known[stretch]
        assert sentencepieces.HEAD.unpack_from(packed) == (score, loss, 1.0)
        assert tuple(np.frombuffer(packed[sentencepieces.HEAD.size :], "<i4").tolist()) == ids
    own.segment("some words, theirs")
    asked, best = [], own.pieces.best
    monkeypatch.setattr(own.pieces, "best", lambda s: asked.append(s) or best(s))
    own.start()
    own.segment("some words, theirs,")
    assert not asked


def test_texts_go_to_python_in_small_batches(spark):
    """The documents' texts come in pieces of a megabyte or two, whether a stage reads them by texts() or by redact()."""
    from offermill.llm import base

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [int(b["text"].str.len().sum())]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcde "), 500).alias("text"))
    for stage in (base.texts, secrets.redact):
        spark.conf.unset(key)
        assert max(r.n for r in stage(docs).mapInPandas(sizes, "n long").collect()) < 2 * base.BATCH_BYTES
    spark.conf.set(key, "4096")
    base.texts(docs)
    assert spark.conf.get(key) == "4096"
    spark.conf.unset(key)
