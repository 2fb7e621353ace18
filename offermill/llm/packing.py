"""Best-fit packing after Martello-Toth dominance reduction (operator 7).

Whole documents are tokenised once, where they lie; from then on only lengths
move. How many pieces of each length there are is all that packing needs, so
the plan is made for a histogram of at most `capacity` rows, whatever the
number of documents, and then dealt to the pieces by their rank among those of
equal length.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offermill.llm.base import Remembered, Sent, table, texts, written
from offermill.llm.vocabulary import Vocabulary

#: Words whose ids a task remembers.
REMEMBERED = 250_000
#: The pre-tokens of the lower-case vocabulary (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ranks are counted apart in parts of the rows: so many at least, and one for so many pieces.
RANK_PARTS, RANK_PIECES = 64, 500_000


class WordEncoder(Sent):
    """Ids of whole texts, as little-endian unsigned 32-bit integers, as the library gives them."""

    made = ("vocabulary",)

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)

    marks = frozenset(".,!?:;")

    def start(self) -> None:
        self.vocabulary.open()
        self.find = regex.compile(PRE_TOKEN).findall
        self.far = re.compile("[^\x00-\u02ff]").search
        self.known, self.far_known = Remembered(self.ids_of, REMEMBERED), Remembered(self.far_ids, REMEMBERED)

    def ids_of(self, chunk: str) -> bytes:
        """Lower-case text up to U+02FF, where composing has nothing to do: cut into pre-tokens, merged.

        A mark after a word is a pre-token of its own, and the word is likelier to be known.
        """
        if chunk.isalpha():
            ids = self.vocabulary.merged(chunk)
        elif chunk[-1:] in self.marks and chunk[:-1].isalpha():
            return self.known[chunk[:-1]] + self.known[chunk[-1]]
        else:
            ids = [i for p in self.find(chunk) for i in self.vocabulary.merged(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """No pre-token holds white space, so what stands between spaces can be encoded apart, and remembered."""
        if "<" not in text:
            return self.words(text)
        out, at = [], 0
        for m in self.vocabulary.find_special.finditer(text):
            out += self.words(text[at : m.start()]), int(self.vocabulary.special[m[0]]).to_bytes(4, "little")
            at = m.end()
        return b"".join([*out, self.words(text[at:])])

    def words(self, text: str) -> bytes:
        """Beyond U+02FF the library does all steps, with Unicode tables of its own."""
        if self.far(text):
            return b"".join(map(self.far_known.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.known.__getitem__, text.lower().replace("\n", " ").split(" ")))

    def far_ids(self, chunk: str) -> bytes:
        ids = self.vocabulary.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut after every `capacity` of them."""
    encoder = docs.sparkSession.sparkContext.broadcast(WordEncoder(path))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, end = encoder.value, int(end_id).to_bytes(4, "little")
        own.start()
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"]):
                ids = own.encode(text) + end
                rows += [(doc_id, k, k * capacity, len(c) // 4, zlib.crc32(c)) for k, c in enumerate(ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Bins of a histogram of lengths: (first sequence, number of alike sequences, lengths in order)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {int(k): int(v) for k, v in counts.items() if v > 0}
        self.sizes, self.bins, self.sequences = sorted(self.left), [], 0
        self.fixed_pieces = 0

    def close(self, lengths: tuple[int, ...], times: int) -> None:
        self.bins.append((self.sequences, times, lengths))
        self.sequences += times

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.left[n] -= times
            if not self.left[n]:
                del self.left[n]
                self.sizes.remove(n)

    def largest(self, room: int, used: tuple[int, ...] = ()) -> int:
        """The largest length up to `room` of which a piece is left when `used` are taken; 0: none."""
        i = bisect_right(self.sizes, room)
        while i and self.left[self.sizes[i - 1]] <= used.count(self.sizes[i - 1]):
            i -= 1
        return self.sizes[i - 1] if i else 0

    def smallest_sum(self, n: int, used: int) -> int:
        """The sum of the n shortest pieces left when one of length `used` is taken; over the capacity if there are fewer."""
        total = 0
        for s in self.sizes:
            k = min(n, self.left[s] - (s == used))
            total, n = total + k * s, n - k
            if not n:
                return total
        return self.capacity + 1

    def best_pair(self, room: int, used: int) -> tuple[int, int]:
        """The largest sum of two pieces that fit, and the largest shorter one of any two that fit."""
        best = shorter = 0
        top = bisect_right(self.sizes, room)
        j = top - 1
        for i in range(top):
            a = self.sizes[i]
            if 2 * a > room:
                break
            while j >= 0 and self.sizes[j] > room - a:
                j -= 1
            b = self.largest(room - a, (used, a))
            if b >= a and self.left[a] > (a == used):
                best, shorter = max(best, a + b), a
        return best, shorter

    def reduce(self) -> int:
        """Fixes, from the longest piece down, each set that dominates all others which hold that piece.

        A set dominates another if the other's pieces can be put into groups,
        each no longer than one of the set's own pieces: putting it in place
        never costs a sequence (Martello and Toth). Sets of up to three pieces
        are tried, wherever no more than two pieces fit beside the longest:
        the longest alone; with the largest that fits, if that fills the
        sequence or is no shorter than any two together; with the two largest
        that fit one after the other, if no pair that fits exceeds them in
        either place. Returns the number of sequences fixed.
        """
        before = self.sequences
        for j in reversed(self.sizes.copy()):
            while self.left.get(j, 0):
                room, n = self.capacity - j, self.left[j]
                k = self.largest(room, (j,))
                if not k:
                    self.fix((j,), n)
                    continue
                if j + k == self.capacity or self.smallest_sum(2, j) > room:
                    self.fix((j, k), n)
                    continue
                if self.smallest_sum(3, j) <= room:
                    break
                pair, shorter = self.best_pair(room, j)
                if k >= pair:
                    self.fix((j, k), self.repeats((j, k)))
                    continue
                b = self.largest(room - k, (j, k))
                if b and b >= shorter:
                    self.fix((j, k, b), self.repeats((j, k, b)))
                    continue
                break
        return self.sequences - before

    def repeats(self, lengths: tuple[int, ...]) -> int:
        """How often a set can be fixed for the same reasons: they change only where fewer than four pieces of a length are left."""
        return max(1, min((self.left[n] - 4) // lengths.count(n) for n in lengths))

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        """The set, as often as its pieces allow; `times` at most."""
        times = min([times, *(self.left[n] // lengths.count(n) for n in lengths)])
        self.fixed_pieces += times * len(lengths)
        self.take(lengths, times)
        self.close(lengths, times)

    def best_fit(self) -> None:
        """Best-fit decreasing for what is left: each length goes, as many at a time as there are, where least room stays."""
        rooms: list[int] = []
        kinds: dict[int, list[tuple[tuple[int, ...], int]]] = {}

        def put(lengths: tuple[int, ...], times: int) -> None:
            room = self.capacity - sum(lengths)
            if not room:
                self.close(lengths, times)
                return
            if room not in kinds:
                insort(rooms, room)
            kinds.setdefault(room, []).append((lengths, times))

        for n in reversed(self.sizes.copy()):
            left = self.left[n]
            while left and (i := bisect_left(rooms, n)) < len(rooms):
                lengths, times = kinds[room := rooms[i]].pop()
                if not kinds[room]:
                    del kinds[room], rooms[i]
                # as many of this length as a sequence holds are put into it at once
                each = min(room // n, left)
                done = min(times, left // each)
                if times > done:
                    if room not in kinds:
                        insort(rooms, room)
                    kinds.setdefault(room, []).append((lengths, times - done))
                put(lengths + (n,) * each, done)
                left -= each * done
            each = self.capacity // n
            if left >= each:
                put((n,) * each, left // each)
            if left % each:
                put((n,) * (left % each), 1)
        for same in kinds.values():
            for lengths, times in same:
                self.close(lengths, times)
        self.left, self.sizes = {}, []

    def slots(self) -> pd.DataFrame:
        """For each length, ranges of ranks and where they go: sequence + (rank - first), offset."""
        used: dict[int, int] = {}
        rows = []
        for sequence, times, lengths in self.bins:
            offset = 0
            for n in lengths:
                first = used.get(n, 0)
                rows.append((n, first, sequence, offset))
                used[n] = first + times
                offset += n
        return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack_lengths(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset: no sequence is longer than `capacity`, and none has a gap.

    The frame is read more than once: give a stored one. Pieces are told apart
    by (doc_id, piece); repeated rows get places of their own. An empty table
    gives an empty one; a null doc_id is packed like any other.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()  # a row for each length: `capacity` at most
    plan = pack_lengths({r["length"]: r["count"] for r in counted}, capacity)
    slots = plan.slots()
    places = spark.sparkContext.broadcast({n: g[["first", "sequence", "offset"]].to_numpy().T.copy() for n, g in slots.groupby("length")})

    # A rank among the pieces of a length: those of earlier parts and those before it in its own part.
    # Pieces of one length are spread over all parts, so a very common length is no hot key.
    parts = max(RANK_PARTS, sum(r["count"] for r in counted) // RANK_PIECES)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    dealt = pieces.withColumn("part", part)
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for n, at in b.groupby("length").indices.items():
                first, seq, off = places.value[n]
                rank = b["rank"].to_numpy()[at]
                i = np.searchsorted(first, rank, "right") - 1
                sequence[at], offset[at] = seq[i] + rank - first[i], off[i]
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A null or empty text is one piece of the end id alone; texts longer than
    `capacity` are cut and no others. Equal rows are equal pieces, each with a
    place of its own. An empty table gives an empty one.
    """
    stored = written(pieces(texts(docs, id_col, text_col), path or public_tokenizers.path("word_bpe_49k.json"), capacity, end_id), "pieces")
    return pack(stored, capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
