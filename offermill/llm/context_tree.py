"""Language-model scores by context-tree weighting (operator 9).

Bytes are predicted bit by bit, most significant first, each from the bytes
before it. Every node of the tree, a context of 0 to DEPTH bytes with the bits
already known of the next byte, holds a Krichevsky-Trofimov estimator; a
node's weight says how much better its own estimate fits the training text
than what its longer contexts say together (Willems, Shtarkov, Tjalkens 1995).
The tree grows only where the training text has been: beyond a node that it
never reached, the deepest one that it reached decides alone.

How the work is dealt: first every task counts the words and byte strings of the
training texts that it reads, and buckets of these (by the nearest context
bytes) are added up. Then texts go to chunks of a bounded number of bytes, and
each chunk asks the buckets for what its distinct words and strings are worth.
Strings travel sorted and packed, about a byte each; buckets answer one request
after another, so none is ever held with all that is asked of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.llm.base import remainder, table, texts, written
from offermill.llm.hashing import BLOCK_BYTES, U64, mix, word_hashes

#: Bytes of context; with the byte itself a key has DEPTH + 1 bytes.
DEPTH = 6
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 16 << 20
#: Neither occurs in UTF-8: the byte around texts; and a key that stands for the end token.
EDGE, END_KEY = 0xFF, -1
WORD, STRING = 0, 1
#: Strings that share so many nearest context bytes are in one bucket; nodes above are few enough for every task.
NEAR = 3
#: Buckets of each kind, at least and at most; and chunks that one copy of a bucket answers, about.
BUCKETS, CHUNKS_OF_A_COPY = (64, 4096), 1024


def byte_strings(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes and the final edge of each text, and where each text's begin.

    A key has the nearest context byte first and the byte itself last.
    """
    pad = bytes([EDGE])
    raw = np.frombuffer(b"".join(pad * DEPTH + t.translate(_LOWER) + pad for t in data), np.uint8).astype(U64)
    sizes = np.array([len(t) + 1 for t in data], np.int64)
    key = np.zeros(len(raw) - DEPTH, U64)
    for back in range(1, DEPTH + 1):
        key |= raw[DEPTH - back : len(raw) - back] << U64(8 * (DEPTH + 1 - back))
    key |= raw[DEPTH:]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.ones(len(key), bool)
    for i in begin[1:-1] + np.arange(len(data) - 1) * DEPTH:
        keep[i : i + DEPTH] = False  # the edges before the next text
    return key[keep], begin


_LOWER = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


Counts = tuple[np.ndarray, np.ndarray]


def joined_counts(a: Counts, b: Counts) -> Counts:
    """Sums of two tables of sorted keys and their counts; quick where b is the smaller."""
    if not len(a[0]) or not len(b[0]):
        return b if len(b[0]) else a
    at = np.searchsorted(a[0], b[0])
    known = a[0][np.minimum(at, len(a[0]) - 1)] == b[0]
    n = a[1].copy()
    n[at[known]] += b[1][known]
    return np.insert(a[0], at[~known], b[0][~known]), np.insert(n, at[~known], b[1][~known])


def encoded(column: pd.Series) -> Iterator[list[bytes]]:
    """The texts' bytes, BLOCK_BYTES of characters at a time, so that a chunk is not held twice."""
    part: list[bytes] = []
    size = 0
    for t in column:
        if part and size + len(t) > BLOCK_BYTES:
            yield part
            part, size = [], 0
        part.append(t.encode())
        size += len(t)
    if part:
        yield part


class Tally:
    """Occurrences of the distinct words and byte strings of texts."""

    def __init__(self, kinds: tuple[int, ...] = (WORD, STRING)):
        none = np.zeros(0, np.int64)
        self.found: dict[int, Counts] = {k: (none, none) for k in kinds}
        self.new: dict[int, list[np.ndarray]] = {k: [] for k in kinds}

    def add(self, data: list[bytes]) -> None:
        for kind, new in self.new.items():
            new.append((word_hashes(data)[0] if kind == WORD else byte_strings(data)[0]).astype(np.int64))
            if kind == WORD:
                new.append(np.full(len(data), END_KEY))
            if sum(map(len, new)) > 4 * BLOCK_BYTES:
                self._join(kind)

    def _join(self, kind: int) -> None:
        if self.new[kind]:
            self.found[kind] = joined_counts(self.found[kind], np.unique(np.concatenate(self.new[kind]), return_counts=True))
            self.new[kind] = []

    def tables(self) -> dict[int, Counts]:
        """By kind: sorted keys and their occurrences."""
        for kind in self.found:
            self._join(kind)
        return self.found


_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(values: np.ndarray) -> bytes:
    """Eight-byte values, packed: all first bytes, then all second ones, and so on."""
    return _squeeze.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_expand.decompress(data), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return packed(np.diff(keys, prepend=np.int64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return unpacked(data, np.int64).cumsum()


def by_bucket(kind: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys, in order."""
    near = keys.astype(U64) >> U64(8 * (DEPTH + 1 - NEAR)) if kind == STRING else keys.astype(U64)
    bucket = (mix(near) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        yield int(i), order[cuts[i] : cuts[i + 1]]


def counted(train: DataFrame, chunk_bytes: int, buckets: int) -> DataFrame:
    """kind, bucket, keys and n: what each task found in the texts that it read, every `chunk_bytes`."""

    def rows_of(tally: Tally) -> pd.DataFrame:
        out = [(kind, i, packed_keys(keys[at]), packed(n[at])) for kind, (keys, n) in tally.tables().items() for i, at in by_bucket(kind, keys, buckets)]
        return pd.DataFrame(out, columns=["kind", "bucket", "keys", "n"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, size = Tally(), 0
        for b in batches:
            for data in encoded(b["text"]):
                tally.add(data)
                size += sum(map(len, data))
                if size > chunk_bytes:
                    yield rows_of(tally)
                    tally, size = Tally(), 0
        yield rows_of(tally)

    return train.select("text").mapInPandas(count, "kind int, bucket int, keys binary, n binary")


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a bucket together, in order."""
    return rows.repartition(*order[:3]).sortWithinPartitions(*order)


def merged(counts: DataFrame) -> DataFrame:
    """One row for each bucket: sorted keys, their occurrences in all, and the totals of both. Rows are added up as they come."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = sums = None

        def row() -> pd.DataFrame:
            keys, n = sums
            return pd.DataFrame([(*now, packed_keys(keys), packed(n), int(n.sum()), len(keys))], columns=["kind", "bucket", "keys", "n", "total", "distinct"])

        for b in batches:
            for kind, bucket, keys, n in zip(b["kind"], b["bucket"], b["keys"], b["n"]):
                part = unpacked_keys(keys), unpacked(n, np.int64)
                if now == (kind, bucket):
                    sums = joined_counts(sums, part)
                    continue
                if now is not None:
                    yield row()
                now, sums = (kind, bucket), part
        if now is not None:
            yield row()

    return in_order(counts, "kind", "bucket").mapInPandas(merge, "kind int, bucket int, keys binary, n binary, total long, distinct long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function, for x > 0: Stirling's series after eight steps up."""
    low = np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


#: log_gamma at n + 1/2 and at n + 1, for counts that most nodes have.
_COUNTED = 1 << 16
_HALVES, _WHOLES = log_gamma(np.arange(_COUNTED) + 0.5), log_gamma(np.arange(_COUNTED) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    both = zeros + ones
    few = both < _COUNTED
    z, o, n = (np.where(few, x, 0) for x in (zeros, ones, both))
    out = _HALVES[z] + _HALVES[o] - _WHOLES[n]
    if not few.all():
        z, o, n = zeros[~few], ones[~few], both[~few]
        out[~few] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(n + 1.0)
    return out - math.log(math.pi)


class Nodes:
    """The nodes of one depth and one number of known bits that training reached: sorted ids (context, then known bits with a leading one), counts and weights."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: Nodes | None = None, log_below: np.ndarray | None = None):
        """below: the nodes one byte deeper; or log_below: their logarithms, summed."""
        self.ids, self.zeros, self.ones = ids, zeros, ones
        own = log_kt(zeros, ones)
        if below is not None:
            log_below = np.bincount(np.searchsorted(ids, above(below.ids)), below.log_p, len(ids))
        if log_below is None:
            self.log_p, self.weight = own, np.ones(len(ids))
        else:
            both = np.logaddexp(own, log_below)
            self.log_p, self.weight = both - math.log(2), np.exp(own - both)

    def mixed(self, ids: np.ndarray, bit: np.ndarray, p: np.ndarray | None, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of the bits here, given those one byte deeper (p, and which of these nodes were reached), and which are reached here."""
        if not len(self.ids):
            here = np.zeros(len(ids), bool)
            return (np.full(len(ids), 0.5) if p is None else np.where(seen, p, 0.5)), here
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        here = self.ids[at] == ids
        zeros, ones = self.zeros[at] * here, self.ones[at] * here
        own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        if p is not None:
            w = self.weight[at]
            own = np.where(seen, w * own + (1 - w) * p, own)
        return own, here


#: The nodes of a depth, by the number of known bits.
Level = list[Nodes]


def above(ids: np.ndarray) -> np.ndarray:
    """The nodes, or strings, that those of some ids, one byte deeper, belong to."""
    return ids >> 16 << 8 | ids & 255


def shortened(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys with so many of their context bytes, the nearest ones."""
    return keys >> 8 >> 8 * (DEPTH - depth) << 8 | keys & 255


def node_ids(strings: np.ndarray, known_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each string's node after so many bits of its byte, and the bit that it adds to it."""
    byte = strings & 255
    return strings >> 8 << 8 | 1 << known_bits | byte >> 8 - known_bits, byte >> 7 - known_bits & 1


def added_up(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ids of sorted ones, and the sums of values for each."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], *(np.add.reduceat(v, first) if len(ids) else v for v in values)


def subtree(keys: np.ndarray, n: np.ndarray) -> dict[int, Level]:
    """Nodes of depths NEAR to DEPTH that sorted strings with these occurrences (more than 0 each) make."""
    levels: dict[int, Level] = {}
    for depth in range(DEPTH, NEAR - 1, -1):
        if depth < DEPTH:  # strings that are a byte shorter
            keys = above(keys)
            order = np.argsort(keys, kind="stable")
            keys, n = added_up(keys[order], n[order])
        level = []
        for k in range(8):
            ids, bit = node_ids(keys, k)
            ids, ones, both = added_up(ids, n * bit, n)
            level.append(Nodes(ids, both - ones, ones, levels[depth + 1][k] if depth < DEPTH else None))
        levels[depth] = level
    return levels


def near_nodes(buckets: DataFrame) -> DataFrame:
    """parent, known, zeros, ones, log_p: nodes of depth NEAR, by the node above, summed for each bucket."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, n in zip(b["keys"], b["n"]):
                top = subtree(unpacked_keys(keys), unpacked(n, np.int64))[NEAR]
                rows = pd.concat([pd.DataFrame({"parent": x.ids >> 16, "known": x.ids & 255, "zeros": x.zeros, "ones": x.ones, "log_p": x.log_p}) for x in top])
                yield rows.groupby(["parent", "known"], as_index=False).sum()

    return buckets.mapInPandas(nodes, "parent long, known long, zeros long, ones long, log_p double")


class Upper:
    """Nodes of depths 0 to NEAR - 1: less than 65,536 * 255, that many only where every two bytes come before every other one."""

    def __init__(self, last: pd.DataFrame):
        """last: nodes of depth NEAR - 1, with the logarithms below them summed."""
        rows = last.assign(id=last["parent"].to_numpy(np.int64) << 8 | last["known"].to_numpy(np.int64)).sort_values("id")
        self.levels: dict[int, Level] = {depth: [] for depth in range(NEAR)}
        for k in range(8):
            own = rows[rows["known"].between(1 << k, (2 << k) - 1)]
            ids, zeros, ones, log_below = (own[c].to_numpy() for c in ("id", "zeros", "ones", "log_p"))
            below = Nodes(ids, zeros, ones, log_below=log_below)
            self.levels[NEAR - 1].append(below)
            for depth in range(NEAR - 2, -1, -1):
                ids = above(below.ids)
                order = np.argsort(ids, kind="stable")
                below = Nodes(*added_up(ids[order], below.zeros[order], below.ones[order]), below)
                self.levels[depth].append(below)


def predictions(levels: dict[int, Level], keys: np.ndarray) -> np.ndarray:
    """(n, 8): the probability of each bit of the keys' bytes, by the nodes of the depths given, mixed from the deepest up."""
    out = np.empty((len(keys), 8))
    strings = {depth: shortened(keys, depth) for depth in sorted(levels, reverse=True)}
    for k in range(8):
        p = seen = None
        for depth, own in strings.items():
            p, seen = levels[depth][k].mixed(*node_ids(own, k), p, seen)
        out[:, k] = p
    return out


def log10_predictions(levels: dict[int, Level], keys: np.ndarray) -> np.ndarray:
    """log10 of the probability of each key's byte, worked out for so many keys at once that tables stay small."""
    parts = [np.log10(predictions(levels, keys[i : i + 200_000])).sum(1) for i in range(0, len(keys), 200_000)]
    return np.concatenate([*parts, np.zeros(0)])


class Worth:
    """The values of a chunk's distinct keys, looked up for a block of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        spread = mix(keys.astype(U64))  # one to one
        order = np.argsort(spread)
        self.spread, self.values = spread[order], values[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Sorts hashes with places in their low bits; where high bits alone don't tell the table's keys apart, looks each key up."""
        bits = U64(max(1, len(keys).bit_length()))
        high = self.spread >> bits
        spread = mix(keys.astype(U64))
        if (high[1:] == high[:-1]).any():
            return self.values[np.searchsorted(self.spread, spread)]
        spread = spread >> bits << bits | np.arange(len(keys), dtype=U64)
        spread.sort()
        place = (spread & ((U64(1) << bits) - U64(1))).astype(np.int64)
        spread >>= bits
        first = np.flatnonzero(np.concatenate([[True], spread[1:] != spread[:-1]]))
        out = np.empty(len(keys))
        out[place] = np.repeat(self.values[np.searchsorted(high, spread[first])], np.diff(np.append(first, len(keys))))
        return out


class Answers:
    """What a bucket's keys are worth: occurrences of words, code lengths of strings."""

    def __init__(self, kind: int, keys: np.ndarray, n: np.ndarray, upper: Upper):
        self.kind, self.keys, self.upper = kind, keys, upper
        if kind == WORD:
            self.values = n.astype(float)
        else:
            self.levels = subtree(keys, n) | upper.levels
            self.values = log10_predictions(self.levels, keys)

    def of(self, asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, asked), max(0, len(self.keys) - 1))
        known = self.keys[at] == asked if len(self.keys) else np.zeros(len(asked), bool)
        out = np.zeros(len(asked))
        out[known] = self.values[at[known]]
        if self.kind == STRING and not known.all():
            out[~known] = log10_predictions(self.levels, asked[~known])
        return out


def answered(buckets: DataFrame, requests: DataFrame, copies: int, upper) -> DataFrame:
    """chunk, kind, bucket, keys and packed values of requests (chunk, kind, bucket, keys), by the merged buckets.

    Keys are sent back for strings, which are many and pack well; words are read again.
    A bucket comes before what is asked of it; it goes to `copies` tasks, between which its requests are dealt.
    """
    sources = buckets.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select("kind", "bucket", "copy", F.lit(-1).alias("chunk"), "keys", "n")
    asked = requests.select("kind", "bucket", (F.col("chunk") % copies).alias("copy"), "chunk", "keys", F.lit(None).cast("binary").alias("n"))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, answers = None, None
        for b in batches:
            out = []
            for kind, bucket, chunk, keys, n in zip(b["kind"], b["bucket"], b["chunk"], b["keys"], b["n"]):
                if chunk < 0:
                    now, answers = (kind, bucket), Answers(kind, unpacked_keys(keys), unpacked(n, np.int64), upper.value)
                    continue
                if now != (kind, bucket):  # no training text has anything of it
                    now, answers = (kind, bucket), Answers(kind, np.zeros(0, np.int64), np.zeros(0, np.int64), upper.value)
                out.append((chunk, kind, bucket, keys if kind == STRING else None, packed(answers.of(unpacked_keys(keys)))))
            yield pd.DataFrame(out, columns=["chunk", "kind", "bucket", "keys", "values"])

    return in_order(sources.unionByName(asked), "kind", "bucket", "copy", "chunk").mapInPandas(answer, "chunk int, kind int, bucket int, keys binary, values binary")


def scored(docs: DataFrame, train: Column, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score and score of every text.

    `train`, a condition on doc_id, says which texts are learnt from. A-Z are
    lower-cased. score is the log10 probability that context-tree weighting
    gives to all bytes of the text and its end, base_score that of its words
    and an end by single counts. Null and empty texts consist of the end
    alone. Rows that repeat are counted and scored each; null ids too. An
    empty table gives an empty one; without training texts every bit has
    probability 1/2.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("train", F.coalesce(train, F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 1).alias("n")).first()["n"] or 1
    chunks = max(1, math.ceil(size / chunk_bytes))
    buckets = min(BUCKETS[1], max(BUCKETS[0], 4 * chunks))

    known = written(merged(counted(rows.where("train"), chunk_bytes, buckets)), "counts")
    total = known.where(f"kind = {WORD}").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    last = near_nodes(known.where(f"kind = {STRING}")).groupBy("parent", "known").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log_p")))
    upper = spark.sparkContext.broadcast(Upper(last.toPandas()))

    # by id and text, so that neither a null id nor one that repeats is a chunk of its own
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text").groupBy("chunk")

    def tables(rows: pd.DataFrame, *kinds: int) -> dict[int, Counts]:
        tally = Tally(kinds)
        for data in encoded(rows["text"]):
            tally.add(data)
        return tally.tables()

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = rows["chunk"].iloc[0]
        out = [(chunk, kind, i, packed_keys(keys[at])) for kind, (keys, _) in tables(rows, WORD, STRING).items() for i, at in by_bucket(kind, keys, buckets)]
        return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "keys"])

    def score(rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("doc_id", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        given = {(k, i): v for k, i, v in zip(values["kind"], values["bucket"], values["values"])}
        counts = tables(rows, WORD)[WORD][0]
        c = np.zeros(len(counts))
        for i, at in by_bucket(WORD, counts, buckets):
            c[at] = unpacked(given[WORD, i], np.float64)
        strings = values[values["kind"] == STRING]
        worth = {WORD: Worth(counts, c), STRING: Worth(*(np.concatenate(list(map(x, strings[y]))) for x, y in ((unpacked_keys, "keys"), (lambda v: unpacked(v, np.float64), "values"))))}
        end = float(worth[WORD].of(np.array([END_KEY]))[0])
        out = []
        for data in encoded(rows["text"]):
            words, at = word_hashes(data)
            c = worth[WORD].of(words.astype(np.int64)) if len(words) else np.zeros(0)
            logs = np.concatenate([[0.0], np.cumsum(np.log10(c + 0.5))])
            hits = np.concatenate([[0], np.cumsum(c > 0)])
            keys, begin = byte_strings(data)
            bits = np.add.reduceat(worth[STRING].of(keys.astype(np.int64)), begin[:-1])
            tokens = np.diff(at) + 1
            base = logs[at[1:]] - logs[at[:-1]] + math.log10(end + 0.5) - tokens * math.log10(n + 0.5 * (v + 1))
            out.append(pd.DataFrame({"n_bytes": np.diff(begin) - 1, "n_tokens": tokens, "n_known": hits[at[1:]] - hits[at[:-1]] + (end > 0), "base_score": base, "score": bits}))
        got = pd.concat(out, ignore_index=True)
        return pd.DataFrame({"doc_id": rows["doc_id"].array, "n_bytes": got["n_bytes"], "n_tokens": got["n_tokens"], "n_known": got["n_known"], "train_tokens": n, "base_score": got["base_score"], "score": got["score"]})

    asked = dealt.applyInPandas(ask, "chunk int, kind int, bucket int, keys binary")
    replies = answered(known, asked, -(-chunks // CHUNKS_OF_A_COPY), upper)
    return dealt.cogroup(replies.groupBy("chunk")).applyInPandas(score, "doc_id long, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return out.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
