"""N-best SentencePiece segmentation and decoding (operator 2).

A text is the lattice of all vocabulary pieces that match in it. Forward
Viterbi scores say how good the best way to each place is; searched backward
from the end, they are exact heuristics for A*, which then meets the
segmentations in order, best first. No piece goes on over a space that follows
a letter, nor holds a character that stands in no longer piece, so each stretch
between such places is searched for itself and the text's N best are put
together from the stretches'.

With exact heuristics the search goes straight to the best segmentation, and
what is then on top of its heap is the score of the second best. That is enough
for nearly all stretches; the search goes on only in the N - 1 of a text whose
second best lose least, as no others can be in one of its N best.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from offermill.llm.base import Remembered, Sent, table, texts

#: Stretches whose best segmentation a worker remembers, and whose N best.
REMEMBERED, REMEMBERED_WAYS = 600_000, 20_000
SPACE = "▁"
#: Below the worst piece's score by so much: a character that only bytes can spell, for each byte.
UNKNOWN = 10.0
_NEVER = float("-inf")
#: What is remembered of a stretch, before its ids of four bytes.
HEAD = struct.Struct("<ddd")

Way = tuple[float, tuple[int, ...]]


class Pieces:
    """The pieces of a model file with their scores; its size is the vocabulary's."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.text: list[str] = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.text[i]: (i, float(model.get_score(i))) for i in plain}
        self.worst = min((s for _, s in self.ids.values() if s > -1e6), default=0.0) - UNKNOWN
        self.joined = {c for p in self.ids if len(p) > 1 for c in p}

    def open(self) -> None:
        """Once per worker: what finds all pieces of a text, and the bytes of each piece."""
        self.find = ahocorasick.Automaton()
        for p, (i, s) in self.ids.items():
            self.find.add_word(p, (len(p), s, (i,)))
        self.find.make_automaton()
        self.known = {p for p in self.ids if len(p) == 1}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.text)]
        # printable characters that many texts have and no longer piece has are stretches of their own
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in self.joined))
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]+" * bool(alone)).findall
        # of a stretch: parts over whose ends no piece goes
        self.parts = re.compile("|".join([f"{SPACE}*[{re.escape(k)}]+" for k in self.kinds()] + [f"{SPACE}*[^{SPACE}]|{SPACE}+"])).findall

    def kinds(self) -> list[str]:
        """Characters that longer pieces, or chains of them, have in common, the space aside: no piece has characters of two kinds."""
        kind: dict[str, str] = {}
        for p in self.ids:
            if len(own := set(p) - {SPACE}) > 1 or len(own) == 1 and p.strip(SPACE)[1:]:
                one = "".join(sorted(set().union(*(kind.get(c, c) for c in own))))
                kind |= dict.fromkeys(one, one)
        return sorted(set(kind.values()))

    def matches(self, text: str) -> Iterable[tuple[int, tuple[int, float, tuple[int, ...]]]]:
        """All pieces in a text: (place of the last character, (length, score, ids)), in order of place, the longest first."""
        found = self.find.iter(text)
        if self.known.issuperset(text):
            return found
        spelt = [(e, (1, self.worst * len(c.encode()), tuple(self.byte[x] for x in c.encode()))) for e, c in enumerate(text) if c not in self.known]
        return sorted([*found, *spelt], key=lambda m: (m[0], -m[1][0]))

    def arcs(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place, what ends there: (begin, score, ids), the longest first."""
        ends: list[list] = [[] for _ in range(len(text) + 1)]
        for e, (n, s, own) in self.matches(text):
            ends[e + 1].append((e + 1 - n, s, own))
        return ends

    def best(self, text: str) -> tuple[float, tuple[int, ...], float]:
        """Score and ids of a stretch's best segmentation, and what the second best loses against it (infinite: there is none).

        This is n_best() up to its first result. The search takes the best arc
        at each place, of equal ones the one that begins last; of the arcs
        that it passes by, the one that loses least is the heap's top.
        """
        n = len(text)
        # of the best way to the place after each character: its score, its last arc, and the score by any other arc; the place before all is -1
        top, taken, other = [_NEVER] * n + [0.0], [None] * n, [_NEVER] * n
        for e, arc in self.matches(text):
            score = top[e - arc[0]] + arc[1]
            if score >= top[e]:
                other[e], top[e], taken[e] = top[e], score, arc
            elif score > other[e]:
                other[e] = score
        e, found, loss = n - 1, [], -_NEVER
        while e >= 0:
            size, _, own = taken[e]
            if top[e] - other[e] < loss:
                loss = top[e] - other[e]
            found.append(own)
            e -= size
        return top[n - 1], found[0] if len(found) == 1 else tuple(chain.from_iterable(reversed(found))), loss

    def n_best(self, text: str, n: int) -> list[Way]:
        """The n best segmentations of a stretch, or all: score and ids; of equal scores the one whose last difference begins later first."""
        ends = self.arcs(text)
        best = [0.0]
        for arcs in ends[1:]:
            best.append(max(best[b] + s for b, s, _ in arcs))
        # (minus the whole way's score, tie, place, score behind, ids behind)
        heap: list = [(-best[-1], 0, len(text), 0.0, ())]
        found: list[Way] = []
        tie = 0
        while heap and len(found) < n:
            _, _, e, behind, ids = heapq.heappop(heap)
            if not e:
                flat, link = [], ids
                while link:
                    flat += link[0]
                    link = link[1]
                found.append((behind, tuple(flat)))
                continue
            for b, s, own in ends[e]:
                tie -= 1
                heapq.heappush(heap, (-(best[b] + s + behind), tie, b, s + behind, (own, ids)))
        return found

    def decode(self, ids: list[int] | tuple[int, ...]) -> str:
        """The text of a sequence of ids: bytes are joined, and the space before the text goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class Segmenter(Sent):
    """N best segmentations of whole texts."""

    made = ("pieces", "n")

    def __init__(self, path: str, n: int):
        self.pieces, self.n = Pieces(path), n

    def start(self) -> None:
        """Once per worker: its later tasks find what the earlier ones remembered."""
        if not hasattr(self, "known"):
            self.pieces.open()
            self.known = Remembered(self._packed, REMEMBERED)
            self.ways = Remembered(lambda s: self.pieces.n_best(s, self.n), REMEMBERED_WAYS)

    def _packed(self, stretch: str) -> bytes:
        """Score, loss and whether the best way spells the stretch, as HEAD says, and its ids: what a text's stretches have is joined and read at once.

        A word with marks after it is made of what is known of both.
        """
        parts = self.pieces.parts(stretch)
        if len(parts) > 1:
            known = [self.known[p] for p in parts]
            scores, losses, exact = zip(*map(HEAD.unpack_from, known))
            return HEAD.pack(sum(scores), min(losses), min(exact)) + b"".join([k[HEAD.size :] for k in known])
        score, ids, loss = self.pieces.best(stretch)
        spelt = b"".join(map(self.pieces.raw.__getitem__, ids)) == stretch.encode()
        return HEAD.pack(score, loss, spelt) + struct.pack(f"<{len(ids)}i", *ids)

    def segment(self, text: str) -> tuple[list[int], list[tuple[float, int]]]:
        """Ids of the best segmentation, and (score, number of pieces) of the n best."""
        ways, scores = self.segmentations(text)
        return ways[0].tolist(), [(s, len(w)) for s, w in zip(scores, ways)]

    def segmentations(self, text: str) -> tuple[list[np.ndarray], list[float]]:
        """Ids and scores of the n best segmentations, the best first. An empty text has no pieces."""
        return self._found(text)[:2]

    def decoded(self, text: str) -> tuple[list[np.ndarray], list[float], bool]:
        """The same, and whether decoding each of them gives the text again.

        A best way whose stretches all spell themselves decodes to the text, unless that holds the space mark.
        A way that spells the same bytes as the best one decodes as it does, so only
        the stretches in which they differ are spelt.
        """
        ways, scores, alike, spelt = self._found(text)
        decodes = lambda w: self.pieces.decode(w.tolist()) == text
        return ways, scores, (SPACE not in text if spelt else decodes(ways[0])) and all(same or decodes(w) for w, same in zip(ways, alike))

    def _found(self, text: str) -> tuple[list[np.ndarray], list[float], list[bool], bool]:
        """Ids and scores of the n best segmentations, whether each spells the bytes that the best one does, and whether all stretches of that spell themselves."""
        if not text:
            return [np.array([], np.int32)], [0.0], [True], True
        stretches = self.pieces.stretches(SPACE + text.replace(" ", SPACE))
        packed = list(map(self.known.__getitem__, stretches))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        values = np.frombuffer(b"".join(packed), "<i4")
        heads = (np.cumsum(sizes) - sizes)[:, None] + np.arange(HEAD.size // 4)
        scores, losses, exact = values[heads].view("<f8").T
        rest = np.ones(len(values), bool)
        rest[heads] = False
        best, sizes, score = values[rest], sizes - HEAD.size // 4, float(scores.sum())
        # the n best differ from the best in stretches where the second best loses least: n - 1 of them can matter
        second = np.argsort(losses, kind="stable")[: self.n - 1]
        # (what is lost, pieces more, which way each of these stretches goes)
        lists: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())]
        asked = sorted(k for k in second.tolist() if losses[k] < -_NEVER)
        for k in asked:
            ways = self.ways[stretches[k]]
            own = [(ways[0][0] - s, len(i) - len(ways[0][1]), w) for w, (s, i) in enumerate(ways)]
            lists = heapq.nsmallest(self.n, [(a + c, b + d, way + (w,)) for a, b, way in lists for c, d, w in own])
        begins = [int(sizes[:k].sum()) for k in asked]
        spelt = lambda k, w: b"".join(map(self.pieces.raw.__getitem__, self.ways[stretches[k]][w][1]))
        found, alike = [], []
        for _, _, way in lists:
            pieces, at = [], 0
            alike.append(all(spelt(k, w) == spelt(k, 0) for k, w in zip(asked, way) if w))
            for k, begin, w in zip(asked, begins, way):
                if w:  # the best way of the others is there already
                    pieces += [best[at:begin], np.array(self.ways[stretches[k]][w][1], np.int32)]
                    at = begin + int(sizes[k])
            found.append(np.concatenate([*pieces, best[at:]]) if pieces else best)
        return found, [score - loss for loss, _, _ in lists], alike, bool(exact.all())


@lru_cache(4)
def segmenter_of(path: str, n: int) -> Segmenter:
    return Segmenter(path, n)


ROW = "doc_id long, ids array<int>, ways array<array<int>>, scores array<double>, sizes array<int>, round_trip boolean"


def n_best_segmentations(docs: DataFrame, path: str | None = None, n: int = 4, id_col: str = "doc_id", text_col: str = "text", then: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str = ROW) -> DataFrame:
    """doc_id, ids of the best segmentation, ways (ids), scores and sizes of the n best (fewer if there are fewer), and round_trip.

    round_trip says whether decoding gives the text again, by each of the n
    best; a text that itself holds the space mark does not. Null and empty texts have no ids and one
    segmentation of score 0; repeated rows and null ids come as they are; an
    empty table gives an empty one. What is sent to the tasks is the vocabulary.
    Where less is wanted than the ids of all ways, `then` makes rows of `schema`
    of these rows, some at a time, so that the ids needn't leave the task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(segmenter_of(path or public_tokenizers.path("piece_bpe_32k.model"), n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        own.start()
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                got = [own.decoded(t) for t in part["text"]]
                rows = pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "ids": [ways[0] for ways, _, _ in got],
                        "ways": [ways for ways, _, _ in got],
                        "scores": [scores for _, scores, _ in got],
                        "sizes": [[len(w) for w in ways] for ways, _, _ in got],
                        "round_trip": [same for _, _, same in got],
                    }
                )
                yield then(rows) if then else rows

    return texts(docs, id_col, text_col).mapInPandas(run, schema)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def digests(rows: pd.DataFrame) -> pd.DataFrame:
    """n_pieces, ids_crc32 and ways_crc32 in place of the ids."""
    sums = [[crc32(w) for w in ways] for ways in rows["ways"]]
    made = {"n_pieces": rows["ids"].map(len), "ids_crc32": rows["ids"].map(crc32), "ways_crc32": pd.Series(sums, index=rows.index, dtype=object)}
    return rows.assign(**made)[["doc_id", "n_pieces", "ids_crc32", "ways_crc32", "scores", "sizes", "round_trip"]]


def op2_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_pieces long, ids_crc32 long, ways_crc32 array<long>, scores array<double>, sizes array<int>, round_trip boolean"
    return n_best_segmentations(table(spark, sf_dir, "documents"), then=digests, schema=schema)
