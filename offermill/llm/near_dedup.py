"""Near-duplicate groups by fast similarity sketches (operator 6).

1. Each text's set of word shingles is sketched (Dahlgaard, Knudsen, Thorup
   2017): rounds of hashed bin placement until every coordinate is filled.
   Equal sets are one class from here on, whatever the number of copies.
2. Bands of coordinates bring classes together that may be similar. Within a
   bucket, two small bits of every coordinate tell most unlike pairs apart;
   pairs that already are in one component need no look at all.
3. The pairs left are verified on their full shingle sets, and links join
   components. First come so few pairs, the most alike, that large groups grow
   together; in the end every pair of separate components that is left is
   verified where its bucket lies, once, and only links leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.llm.base import forget, table, texts, written
from offermill.llm.hashing import BLOCK_BYTES, U64, mix, shingle_sets, stream

#: Coordinates of a sketch.
SIZE = 192
#: A similar pair shares no band with this chance at most, for independent coordinates.
MISSED = 1e-6
#: Members of a bucket that one task compares with so many others at once, and their shingles; larger buckets are cut into such blocks.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Texts that a task holds as sets at once, and their characters; a longer one is taken alone.
ROWS, ROWS_CHARS = 500, 8_000_000
#: Rounds that join what is most alike: bands looked at (None: all).
ROUNDS = (4, None)

_ROUND_SEEDS = stream(2 * SIZE, 7)


def rows_of_band(similarity: float) -> int:
    """Coordinates to a band: as many as keep the chance to miss a pair of that similarity within MISSED."""
    fit = [r for r in range(1, 13) if (1 - similarity**r) ** (SIZE // r) <= MISSED]
    return max(fit, default=1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SIZE values for each set; rows of empty sets are zero.

    In round i < SIZE every element falls into a bin of its own choice, in
    round SIZE + k all fall into bin k; a bin keeps the least value of the
    first round that reaches it. The rounds end as soon as all bins are full.
    """
    out = np.zeros((len(sets), SIZE), U64)
    full = np.zeros((len(sets), SIZE), bool)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(todo):
        return out
    elements, owner = np.concatenate([sets[i] for i in todo]), np.repeat(todo, [len(sets[i]) for i in todo])
    for i in range(2 * SIZE):
        values = mix(elements ^ _ROUND_SEEDS[i])
        bins = (values >> U64(32)) * U64(SIZE) >> U64(32) if i < SIZE else np.full(len(values), i - SIZE, U64)
        cell = owner * SIZE + bins.astype(np.int64)
        free = ~full.ravel()[cell]
        cell, values = cell[free], values[free]
        order = np.argsort(values, kind="stable")[::-1]
        cell, values = cell[order], values[order]
        out.ravel()[cell] = values  # the least is written last
        full.ravel()[cell] = True
        missing = ~full.all(axis=1)
        left = missing[owner]
        if not left.any():
            break
        elements, owner = elements[left], owner[left]
    return out


def signatures(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n, set_hash, bands, tags and bits of each document; documents with empty sets have n = 0.

    A band's tag is half of its hash; bits are two for each coordinate.
    """
    turns = stream(SIZE, 11) | U64(1)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            begin = size = 0
            for i, t in enumerate(batch["text"]):
                if i - begin == ROWS or (size and size + len(t) > ROWS_CHARS):
                    yield signed(batch.iloc[begin:i])
                    begin, size = i, 0
                size += len(t)
            if begin < len(batch):
                yield signed(batch.iloc[begin:])

    def signed(b: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets([t.encode() for t in b["text"]], width)
        sketch = np.concatenate([sketches(part) for part in _parts(sets)])
        with np.errstate(over="ignore"):
            n = SIZE // rows
            bands = (sketch[:, : n * rows] * turns[: n * rows]).reshape(len(sets), n, rows).sum(2, dtype=U64)
            bands = mix(bands + np.arange(n, dtype=U64)).astype(np.int64)
            two = (mix(sketch) & U64(3)).astype(np.uint8)
            sums = [(mix(s).sum(dtype=U64), mix(s ^ U64(0x5BD1E995)).sum(dtype=U64)) for s in sets]
        packed = two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6
        hashes = [f"{x:016x}{y:016x}" for x, y in sums]
        return pd.DataFrame({"doc_id": b["doc_id"].array, "text_hash": b["text_hash"].array, "n": [len(s) for s in sets], "set_hash": hashes, "bands": list(bands), "tags": [t.tobytes() for t in bands.astype(np.uint32)], "bits": [p.tobytes() for p in packed]})

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInPandas(sign, "doc_id long, text_hash long, n long, set_hash string, bands array<long>, tags binary, bits binary")


def _parts(sets: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Lists of sets with about BLOCK_BYTES / 4 elements together."""
    part, size = [], 0
    for s in sets:
        if part and size + len(s) > BLOCK_BYTES // 4:
            yield part
            part, size = [], 0
        part.append(s)
        size += len(s)
    yield part


def similar_bits(similarity: float) -> int:
    """Coordinates whose two bits agree, at least, for a pair of that similarity, less 4.8 standard deviations."""
    p = 0.25 + 0.75 * similarity
    return math.floor(SIZE * (p - 4.8 * math.sqrt(p * (1 - p) / SIZE)))


_PAIRS_UNLIKE = np.array([sum(bool(x >> k & 3) for k in (0, 2, 4, 6)) for x in range(256)], np.uint8)


class Bucket:
    """The pairs of one bucket (or of two blocks of it) that may be similar and are in different components."""

    columns = ("id", "component", "n", "bits", "tags", "band", "block")

    def __init__(self, similarity: float):
        self.unlike, self.ratio = SIZE - similar_bits(similarity), similarity

    def pairs(self, rows: list[np.ndarray], once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of both and how unlike they are, the most alike first. once: only pairs that share no earlier band.

        Rows come sorted by id; among equally alike pairs those of lower ids are first.
        """
        ids, component, n, bits, tags, band, block = rows
        if len(ids) < 2 or component.min() == component.max():
            return (np.zeros(0, np.int32),) * 3
        bits = np.frombuffer(b"".join(bits), np.uint8).reshape(len(ids), -1)
        tags = np.frombuffer(b"".join(tags), np.uint32).reshape(len(ids), -1)
        across = block.min() != block.max()
        left, right, far = [], [], []
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids), dtype=np.int32)
            ok = (component[j] != component[i]) & (np.minimum(n[j], n[i]) >= self.ratio * np.maximum(n[j], n[i]))
            if across:
                ok &= block[j] != block[i]
            j = j[ok]
            if once and len(j):
                j = j[(tags[j] == tags[i]).argmax(1) == band[0]]
            if len(j):
                d = _PAIRS_UNLIKE[bits[j] ^ bits[i]].sum(1, dtype=np.uint8)  # SIZE at most
                j, d = j[d <= self.unlike], d[d <= self.unlike]
                left.append(np.full(len(j), i, np.int32))
                right.append(j)
                far.append(d)
        if not left:
            return (np.zeros(0, np.int32),) * 3
        left, right, far = np.concatenate(left), np.concatenate(right), np.concatenate(far)
        order = np.argsort(far, kind="stable").astype(np.int32)
        return left[order], right[order], far[order]


class Joined:
    """Components that have grown together in a task."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, c: int) -> int:
        r = self.root
        while r.setdefault(c, c) != c:
            r[c] = c = r[r[c]]
        return c

    def apart(self, a: int, b: int) -> bool:
        return self.find(a) != self.find(b)

    def join(self, a: int, b: int) -> None:
        self.root[self.find(a)] = self.find(b)


def in_buckets(batches: Iterator[pd.DataFrame], do) -> Iterator[pd.DataFrame]:
    """do(rows of whole buckets, where each begins and ends) for batches sorted by (key, low, high)."""
    held: list[pd.DataFrame] = []

    def bounds(rows: pd.DataFrame) -> list[int]:
        place = [rows[c].to_numpy() for c in ("key", "low", "high")]
        change = np.logical_or.reduce([p[1:] != p[:-1] for p in place])
        return [0, *(np.flatnonzero(change) + 1).tolist(), len(rows)]

    for b in batches:
        if not len(b):
            continue
        rows = pd.concat([*held, b], ignore_index=True) if held else b
        cuts = bounds(rows)
        held = [rows.iloc[cuts[-2] :]]  # the last bucket may go on in the next batch
        if cuts[-2]:
            yield do(rows.iloc[: cuts[-2]], cuts[:-1])
    if held:
        yield do(held[0], [0, len(held[0])])


def shared_buckets(classes: DataFrame) -> DataFrame:
    """id, band and key of every class in every bucket that holds more than one, and the blocks that the bucket is cut into."""
    keys = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    members = keys.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return keys.join(members, "key").select("id", "band", "key", blocks.alias("blocks"))


def dealt(buckets: DataFrame, classes: DataFrame, components: DataFrame, bands: int | None) -> DataFrame:
    """Members of buckets that hold more than one component, with what Bucket reads.

    A bucket of several blocks meets block by block: each row goes to every
    pair of blocks that has its own.
    """
    own = buckets.where(F.col("band") < bands) if bands else buckets
    own = own.join(components, "id")
    mixed = own.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    placed = own.join(mixed, "key", "left_semi")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("id", "component", "band", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return placed.join(classes.select("id", "n", "bits", "tags"), "id")


def sorted_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id")


def most_alike(members: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of class ids: in each bucket those that would join its components, the most alike first."""
    bucket = Bucket(similarity)

    def pick(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        columns = [rows[c].to_numpy() for c in Bucket.columns]
        for p, q in zip(cuts, cuts[1:]):
            own = [c[p:q] for c in columns]
            joined = Joined()
            for i, j, _ in zip(*bucket.pairs(own, False)):
                if joined.apart(own[1][i], own[1][j]):
                    joined.join(own[1][i], own[1][j])
                    found.add((int(min(own[0][i], own[0][j])), int(max(own[0][i], own[0][j]))))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype=np.int64)

    return sorted_buckets(members).mapInPandas(lambda batches: in_buckets(batches, pick), "a long, b long").distinct()


def all_links(members: DataFrame, docs: DataFrame, similarity: float, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of every bucket, as far as there are any.

    Every pair of different components is verified in the first bucket that
    both are in, unless the links found there have joined them already. Texts
    are sent only of members that are in such a pair.
    """
    bucket = Bucket(similarity)

    def involved(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        keep = np.zeros(len(rows), bool)
        columns = [rows[c].to_numpy() for c in Bucket.columns]
        for p, q in zip(cuts, cuts[1:]):
            left, right, _ = bucket.pairs([c[p:q] for c in columns], True)
            keep[p + left] = keep[p + right] = True
        return rows[keep]

    def link(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        found = []
        columns, text = [rows[c].to_numpy() for c in Bucket.columns], rows["text"].to_numpy()
        for p, q in zip(cuts, cuts[1:]):
            own = [c[p:q] for c in columns]
            left, right, _ = bucket.pairs(own, True)
            sets = shingle_sets([t.encode() for t in text[p:q]], width) if len(left) else []
            joined = Joined()
            for i, j in zip(left, right):
                if joined.apart(own[1][i], own[1][j]) and _linked(sets[i], sets[j], percent):
                    joined.join(own[1][i], own[1][j])
                    found.append((int(own[0][i]), int(own[0][j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    schema = "id long, component long, band int, key long, block int, low int, high int, n long, bits binary, tags binary"
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    few = sorted_buckets(members.select(*columns)).mapInPandas(lambda batches: in_buckets(batches, involved), schema)
    with_text = few.join(docs.withColumnRenamed("doc_id", "id"), "id")
    return sorted_buckets(with_text).mapInPandas(lambda batches: in_buckets(batches, link), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union, by their full shingle sets."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good, size, begin = [], 0, 0
            lengths = (b["text_a"].str.len() + b["text_b"].str.len()).to_numpy()
            for i in range(len(b)):
                size += lengths[i]
                if size > BLOCK_BYTES or i == len(b) - 1:
                    good += _similar(b.iloc[begin : i + 1], width, percent)
                    begin, size = i + 1, 0
            yield pd.DataFrame(good, columns=["a", "b"], dtype=np.int64)

    a, b = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return both.mapInPandas(check, "a long, b long")


def _similar(rows: pd.DataFrame, width: int, percent: int) -> list[tuple[int, int]]:
    text = list(dict.fromkeys([*rows["text_a"], *rows["text_b"]]))
    sets = dict(zip(text, shingle_sets([t.encode() for t in text], width)))
    return [(a, b) for a, b, x, y in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"]) if _linked(sets[x], sets[y], percent)]


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) after links (a, b) between ids: the least id reachable.

    Labels of linked components are lowered until none falls any more; each
    round also jumps to the label's own label, so that few rounds do.
    """
    ends = links.join(components.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(components.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    edges = written(ends.where("ca <> cb").select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = written(both.select(F.col("u").alias("x")).distinct().withColumn("label", F.col("x")), "label")
    while True:
        near = both.join(label.select(F.col("x").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("x")).agg(F.min("near").alias("near"))
        lower = label.join(near, "x", "left").select("x", "label", F.least("label", "near").alias("low"))
        jump = label.select(F.col("x").alias("low"), F.col("label").alias("jump"))
        new = written(lower.join(jump, "low", "left").select("x", F.least("low", "jump").alias("label"), (F.least("low", "jump") < F.col("label")).alias("fell")), "label")
        fell = not new.where("fell").isEmpty()
        forget(label)
        label = new.select("x", "label")
        if not fell:
            break
    out = written(components.join(label.select(F.col("x").alias("component"), F.col("label").alias("new")), "component", "left").select("id", F.coalesce("new", "component").alias("component")), "components")
    forget(edges, label)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if their sets of `width`-word shingles are alike by
    `percent` or more; a component's id is the least doc_id in it, and that
    document is kept. A null, empty or wordless text has an empty set and is
    linked with nothing (a null id is its own, null component); shorter texts
    are one shingle. Rows that repeat a doc_id are one document, with the
    links of all its texts; each row is returned with the size of its own
    set. An empty table gives an empty one.
    """
    rows = texts(docs, id_col, text_col)
    similarity = percent / 100
    signed = written(signatures(rows, width, rows_of_band(similarity)), "signatures")
    # classes of equal sets: all their values are equal but for the ids and texts
    firsts = [F.first(c).alias(c) for c in ("n", "bits", "tags", "bands")]
    least = F.min(F.struct(F.col("doc_id").alias("id"), "text_hash")).alias("least")
    grouped = signed.where("n > 0 and doc_id is not null").groupBy("set_hash").agg(least, *firsts)
    classes = written(grouped.select("set_hash", "least.*", "n", "bits", "tags", "bands"), "classes")
    components = written(classes.select("id", F.col("id").alias("component")).distinct(), "components")
    texts_of = rows
    if _repeats(signed):
        # an id may stand for several classes: each has its own text, and all are one document
        texts_of = written(class_texts(rows, classes), "texts")
        own = signed.where("n > 0 and doc_id is not null").join(classes.select("set_hash", "id"), "set_hash").select("doc_id", "id").distinct()
        first = own.groupBy("doc_id").agg(F.min("id").alias("a"))
        links = written(own.join(first, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "links")
        if not links.isEmpty():
            components = joined(components, links)
    buckets = written(shared_buckets(classes), "buckets")
    for bands in (*ROUNDS, 0):
        members = dealt(buckets, classes, components, bands or None)
        if bands == 0:
            links = written(all_links(members, texts_of, similarity, width, percent), "links")
        else:
            pairs = written(most_alike(members, similarity), "pairs")
            links = written(verified(pairs, _needed(texts_of, pairs), width, percent), "links")
            forget(pairs)
        if not links.isEmpty():
            new = joined(components, links)
            forget(components)
            components = new
        forget(links)
    of_class = classes.select("set_hash", "id").join(components, "id").select("set_hash", F.col("component"))
    out = signed.select("doc_id", "n", "set_hash").join(of_class, "set_hash", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.coalesce(F.col("doc_id") == component, F.lit(True))).alias("kept"))


def class_texts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id and text of the document that stands for each class: one row a class, so that some ids have several."""
    wanted = classes.select(F.col("id").alias("doc_id"), "text_hash").distinct()
    found = rows.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"], "left_semi")
    return found.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text")


def _repeats(signed: DataFrame) -> bool:
    """Whether any doc_id occurs more than once."""
    return not signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def _needed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that occur in pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return docs.join(ids, "doc_id", "left_semi")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
