"""Chroma audio fingerprints of media columns (operator 4).

Sound becomes frames of twelve pitch classes. Filters that compare sums over
rectangles of frames and classes, read from an integral image, give two bits
each; a frame's bits are packed into one 32-bit integer. Recordings are
aligned by the histogram of offsets at which they share integers, and accepted
by the share of differing bits over the overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.llm.base import table, written

RATE = 4000
#: Samples of a frame and between frames.
FRAME, HOP = 1024, 256
#: Frames that a filter spans.
SPAN = 8
#: Integers two recordings must share at one offset, the greatest share of differing bits, and the least overlap in frames.
VOTES, ERRORS, OVERLAP = 3, 0.25, 8
#: Integers of the queries that a task holds at once, and matches of a recording with them that it expands at once.
BLOCK_PRINTS, MATCHES = 1_000_000, 1_000_000
#: Classes in a part of the table, at most, where that makes more parts than four for each core.
PART_ROWS = 100_000
#: Recordings made and sent on at once.
PLAYED = 32
#: Filters, two bits each: kind of pattern, first class, classes, frames. Sixteen of them fill 32 bits.
FILTERS = tuple((k % 4, (5 * k) % 10, 2 + k % 3, (4, 6, 8)[k % 3]) for k in range(16))


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of pitch-class energy, each of unit length; silence and sound shorter than a frame give zeros or nothing."""
    n = 1 + (len(samples) - FRAME) // HOP
    if n < 1:
        return np.zeros((0, 12))
    at = np.arange(n)[:, None] * HOP + np.arange(FRAME)
    power = np.abs(np.fft.rfft(samples[at] * np.hanning(FRAME), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hertz > 80) & (hertz < 1800)
    pitch = np.round(12 * np.log2(hertz[use] / 440.0)).astype(int) % 12
    sums = power[:, use] @ np.eye(12)[pitch]
    size = np.sqrt((sums**2).sum(1, keepdims=True))
    return np.divide(sums, size, out=np.zeros_like(sums), where=size > 1e-9)


def packed(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each SPAN frames in a row."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int64)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    t = np.arange(n)
    area = lambda t0, t1, c0, c1: image[t + t1, c1] - image[t + t0, c1] - image[t + t1, c0] + image[t + t0, c0]
    out = np.zeros(n, np.int64)
    for kind, low, classes, width in FILTERS:
        high, half, middle = min(12, low + classes), width // 2, (2 * low + classes) // 2
        whole = area(0, width, low, high)
        if kind == 0:  # against the rest of the classes
            value = whole / (high - low) - (area(0, width, 0, 12) - whole) / (12 - high + low)
        elif kind == 1:  # earlier against later
            value = area(0, half, low, high) - area(half, width, low, high)
        elif kind == 2:  # lower against higher classes
            value = area(0, width, low, middle) - area(0, width, middle, high)
        else:  # corners against corners
            value = area(0, half, low, middle) + area(half, width, middle, high) - area(0, half, middle, high) - area(half, width, low, middle)
        level = (value > -0.5).astype(np.int64) + (value > 0) + (value > 0.5)
        out = out << 2 | (level ^ level >> 1)  # Gray code: neighbouring levels differ in one bit
    return out


def alignment(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits where a, begun `offset` frames later, and b overlap; 1 if they hardly do."""
    a, b = (a[: len(b) - offset], b[offset : offset + len(a)]) if offset >= 0 else (a[-offset : len(b) - offset], b[: len(a) + offset])
    if len(a) < OVERLAP:
        return 1.0
    return float(np.bitwise_count((a ^ b).astype(np.uint64)).mean() / 32)


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """id, class hash and prints of each recording (16-bit mono samples, RATE a second).

    A null or odd-sized column loses what is no whole sample; recordings
    shorter than SPAN frames have no prints.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [packed(chroma(np.frombuffer((a or b"")[: len(a or b"") // 2 * 2], "<i2").astype(float))) for a in b["audio"]]
            yield pd.DataFrame({"id": b["id"], "class_hash": [hashlib.md5(p.tobytes()).hexdigest() for p in got], "prints": list(got)})

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio")).mapInPandas(make, "id long, class_hash string, prints array<long>")


class Asked:
    """A block of queries: their prints, and the spots where a print begins, in order of the print."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids, self.prints = np.array(ids, np.int64), prints
        at = [begins(p) for p in prints]
        owner, at = np.repeat(np.arange(len(ids)), [len(x) for x in at]), np.concatenate([*at, np.zeros(0, np.int64)])
        found = np.array([prints[o][t] for o, t in zip(owner, at)], np.int64)
        order = np.argsort(found, kind="stable")
        self.found, self.owner, self.at = found[order], owner[order], at[order]
        self.runs, self.length = np.bincount(owner, minlength=len(ids)), np.array([len(p) for p in prints], np.int64)
        self.flat, self.start = np.concatenate([*prints, np.zeros(0, np.int64)]).astype(np.int64), self.length.cumsum() - self.length

    def histogram(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, offset and votes of all that a recording shares with the block; MATCHES at a time are expanded."""
        spots = begins(own)
        low, high = np.searchsorted(self.found, own[spots], "left"), np.searchsorted(self.found, own[spots], "right")
        n, width = high - low, max([len(own), *map(len, self.prints)]) + 1
        keys, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        part = n.cumsum() // MATCHES
        for k in np.unique(part):
            use = part == k
            times = n[use]
            i = np.repeat(low[use] - times.cumsum() + times, times) + np.arange(times.sum())
            key = (2 * width) * self.owner[i] + np.repeat(spots[use], times) - self.at[i] + width
            keys, votes = summed(np.concatenate([keys, key]), np.concatenate([votes, np.ones(len(key), np.int64)]))
        return keys // (2 * width), keys % (2 * width) - width, votes

    def aligned(self, class_id: int, own: np.ndarray, votes: int, errors: float) -> list[tuple[int, int, int, int, float]]:
        """(query, class, offset, votes, error) of the queries that align at any offset with the votes.

        The offset of most votes that aligns is taken, the least shift first.
        Where a side has fewer runs than `votes`, all offsets are tried.
        """
        asked, offset, n = self.histogram(own)
        other = self.ids[asked] != class_id
        few = (self.runs[asked] < votes) | (len(begins(own)) < votes)
        rows = [(q, *best) for q in np.unique(asked[other & few]).tolist() if (best := by_runs(self.prints[q], own, votes, errors))]
        keep = (n >= votes) & other & ~few
        asked, offset, n = asked[keep], offset[keep], n[keep]
        order = np.lexsort((-offset, np.abs(offset), -n, asked))
        asked, offset, n = asked[order], offset[order], n[order]
        first = firsts(asked)
        error = np.full(len(asked), np.inf)
        error[first] = self.errors_at(asked[first], offset[first], own)
        rest = np.ones(len(asked), bool)
        rest[first] = False
        rest &= ~np.isin(asked, asked[error <= errors])
        error[rest] = self.errors_at(asked[rest], offset[rest], own)
        good = np.flatnonzero(error <= errors)
        good = good[firsts(asked[good])]
        rows += zip(asked[good].tolist(), offset[good].tolist(), n[good].tolist(), error[good].tolist())
        return [(int(self.ids[q]), class_id, o, v, e) for q, o, v, e in rows]

    def errors_at(self, asked: np.ndarray, offset: np.ndarray, own: np.ndarray) -> np.ndarray:
        """alignment() of queries with a recording, each at its offset; about MATCHES frames at a time."""
        skip, after = np.maximum(0, -offset), np.maximum(0, offset)
        n = np.minimum(self.length[asked] - skip, len(own) - after)
        out = np.ones(len(asked))
        long = np.flatnonzero(n >= OVERLAP)
        part = n[long].cumsum() // MATCHES
        for k in np.unique(part):
            at = long[part == k]
            m = n[at]
            begin = m.cumsum() - m
            step = np.arange(m.sum()) - np.repeat(begin, m)
            differ = self.flat[np.repeat(self.start[asked[at]] + skip[at], m) + step] ^ own[np.repeat(after[at], m) + step]
            out[at] = np.add.reduceat(np.bitwise_count(differ), begin, dtype=np.int64) / m / 32
        return out


def by_runs(a: np.ndarray, b: np.ndarray, votes: int, errors: float) -> tuple[int, int, float] | None:
    """Offset, equal frames and error of the best of all offsets at which so many frames are equal and that align.

    Cheap where one side has few runs of equal prints: a pass over all offsets for each of them.
    """
    turned = len(begins(b)) < len(begins(a))
    few, many = (b, a) if turned else (a, b)
    offset = np.arange(1 - len(few), len(many))
    n = np.minimum(len(few), len(many) - offset) - np.maximum(0, -offset)
    equal, differ = np.zeros(len(offset), np.int64), np.zeros(len(offset), np.int64)
    spots = begins(few)
    for begin, end in zip(spots, [*spots[1:], len(few)]):
        low, high = np.clip(offset + begin, 0, len(many)), np.clip(offset + end, 0, len(many))
        for out, own in ((equal, many == few[begin]), (differ, np.bitwise_count(many ^ few[begin]))):
            sums = np.concatenate([[0], own.cumsum(dtype=np.int64)])
            out += sums[high] - sums[low]
    error = differ / n / 32
    good = np.flatnonzero((n >= OVERLAP) & (equal >= votes) & (error <= errors))
    if not len(good):
        return None
    shift = -offset if turned else offset
    i = good[np.lexsort((-shift[good], np.abs(shift[good]), -equal[good]))[0]]
    return int(shift[i]), int(equal[i]), float(error[i])


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Places of values that differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def begins(prints: np.ndarray) -> np.ndarray:
    """Places of prints that differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of n for each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def matches(prints: DataFrame, votes: int = VOTES, errors: float = ERRORS, block: int = BLOCK_PRINTS) -> DataFrame:
    """asked and class (ids), offset, votes and error of aligned recordings of different prints.

    `prints` has class (the least id of equal prints), prints and query
    (whether any recording of the class is a query). Integers that stay for
    several frames are counted once, where they begin, unless a recording has
    fewer than `votes` beginnings: then equal frames count. Queries meet all rows
    in blocks of about `block` integers, where they lie, so that no vote is
    shuffled and a common integer is no hot key.
    """
    spark = prints.sparkSession
    asked = prints.where("query").select("class", "prints")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("prints"))).first()[0] or 0) // block))
    out = []
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == k).orderBy("class").toPandas()  # about `block` integers
        sent = spark.sparkContext.broadcast((own["class"].tolist(), [np.asarray(p, np.int64) for p in own["prints"]]))

        def link(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Asked(*sent.value)
            for b in batches:
                rows = [r for c, p in zip(b["class"].tolist(), b["prints"]) for r in index.aligned(c, np.asarray(p, np.int64), votes, errors)]
                yield pd.DataFrame(rows, columns=["asked", "class", "offset", "votes", "error"])

        found = prints.select("class", "prints").mapInPandas(link, "asked long, class long, offset long, votes long, error double")
        out.append(written(found, "links"))
        sent.unpersist()
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links


def aligned_recordings(media: DataFrame, id_col: str, audio_col: str, query_every: int = 20) -> DataFrame:
    """Every recording with its class and, for queries, what it aligns with among all others.

    Columns: id, n_prints, class_id (the least id of equal prints), query,
    and for the class of a query n_links (other classes aligned), best_class,
    best_offset (frames) and best_error. Queries are the ids divisible by
    query_every. Recordings without prints are a class of their own each and
    align with nothing; rows without an id are left out; an empty table gives
    an empty one.
    """
    prints = written(fingerprints(media, id_col, audio_col).where("id is not null"), "prints")
    query = F.col("id") % query_every == 0
    some = prints.where(F.size("prints") > 0)
    grouped = some.groupBy("class_hash").agg(F.min("id").alias("class"), F.first("prints").alias("prints"), F.max(query).alias("query"))
    # comparing costs far more than reading: small tables are spread over all cores too
    parts = max(4 * media.sparkSession.sparkContext.defaultParallelism, some.count() // PART_ROWS)
    classes = written(grouped.repartition(parts, "class"), "classes")
    links = matches(classes.select("class", "prints", "query"))
    best = links.groupBy("asked").agg(F.count("*").alias("n_links"), F.min(F.struct("error", "class", "offset")).alias("best"))
    ids = prints.select("id", "class_hash", F.size("prints").cast("long").alias("n_prints"), query.alias("query"))
    of_class = classes.select("class_hash", "class").join(best.withColumnRenamed("asked", "class"), "class", "left")
    out = ids.join(of_class, "class_hash", "left")
    shown = lambda c: F.when(F.col("query"), c)
    return out.select("id", "n_prints", F.coalesce("class", "id").alias("class_id"), "query", shown(F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"), shown(F.col("best.class")).alias("best_class"), shown(F.col("best.offset").cast("long")).alias("best_offset"), shown(F.col("best.error")).alias("best_error"))


def sounded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Recordings made from number sequences, for want of recorded sound: each number is a tone of a twelfth of its range.

    A tone lasts two hops. Nulls in a sequence, and null sequences, are silent.
    """

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 2 * HOP
        tones = np.vstack([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * np.arange(n) / RATE) for k in range(12)] + [np.zeros(n)])
        tones = (12000 * tones).astype("<i2")
        for b in batches:
            for at in range(0, len(b), PLAYED):
                yield played(b.iloc[at : at + PLAYED], tones)

    def played(b: pd.DataFrame, tones: np.ndarray) -> pd.DataFrame:
        out = []
        for v in b["v"]:
            x = np.asarray([] if v is None else v, float)
            step = np.where(np.isnan(x), 12, np.clip(np.floor(6 + 24 * np.nan_to_num(x)), 0, 11)).astype(int)
            out.append(tones[step].tobytes())
        return pd.DataFrame({"id": b["id"].array, "audio": out})

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInPandas(play, "id long, audio binary")


def op4_audio_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aligned_recordings(sounded(table(spark, sf_dir, "embeddings")), "id", "audio")
    return out.withColumnRenamed("id", "vec_id")
