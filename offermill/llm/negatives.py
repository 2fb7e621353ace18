"""Hard negatives by bit-sliced integer products (operator 12).

Vectors become integers. The bits of their components are looked at plane by
plane, the most significant first: what the planes so far add to the product
with an anchor, and the least and the most that the rest can add, bound the
score, and each plane halves the width. A row that can no longer be among those
asked for is dropped, so the last planes are looked at for few rows only.

Anchors are dealt to blocks and rows to parts; every block meets every part in
a task of its own, with as many of both as memory allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offermill.llm.base import table, written

#: A component x counts as floor(SCALE x); rows with one of REACH or more, either way, take no part, so that sums of up to 32,767 products are 64-bit integers.
SCALE, REACH = 256, 1 << 16
#: Bytes of anchors in a block and of rows in a part, about (a task holds one of each), and the least parts, so that small tables use several tasks.
BLOCK_BYTES, PART_BYTES, PARTS = 4 << 20, 16 << 20, 32
#: Anchors and rows whose products are held at once, and the share of pairs below which they are looked at one by one.
HELD_ANCHORS, HELD_ROWS, FEW = 256, 4096, 0.1

_LEAST, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame) -> DataFrame:
    """row, anchor, vec_id, label and the components as whole numbers (32-bit, packed) of the rows (anchor, vec_id, label, v) that take part."""
    good = F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < REACH))  # NaN is above all numbers
    numbered = rows.where(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "anchor", "vec_id", "label", "v")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(vec_id=b["vec_id"].astype("Int64"), v=[np.floor(np.asarray(v, np.float64) * SCALE).astype("<i4").tobytes() for v in b["v"]])

    return numbered.mapInPandas(pack, "row long, anchor boolean, vec_id long, label long, v binary")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Packed vectors as rows of a matrix; shorter ones are filled up with 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, "<i4")
        out[i, : len(x)] = x
    return out


class Foremost:
    """Which scores can still be among the k highest of each anchor."""

    def __init__(self, anchors: int, k: int):
        self.k, self.floor = k, np.full((anchors, 1), _LEAST)

    def tighten(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> None:
        """No score below the k-th highest lower bound counts."""
        self.floor[:, 0] = _kth(np.where(alive, low, _LEAST), self.k)

    def can(self, low: np.ndarray, high: np.ndarray, floor: Callable) -> np.ndarray:
        return high >= floor(self.floor[:, 0])


class Between(Foremost):
    """Which scores can still be among the k highest of those within one of an anchor's ranges."""

    def __init__(self, least: np.ndarray, most: np.ndarray, k: int):
        self.k, self.least, self.most, self.floor = k, least, most, least.copy()

    def tighten(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> None:
        for c in range(self.least.shape[1]):
            surely = alive & (low >= self.least[:, c, None]) & (high <= self.most[:, c, None])
            self.floor[:, c] = np.maximum(self.least[:, c], _kth(np.where(surely, low, _LEAST), self.k))

    def can(self, low: np.ndarray, high: np.ndarray, of: Callable) -> np.ndarray:
        out = np.zeros(low.shape, bool)
        for c in range(self.least.shape[1]):
            out |= (high >= of(self.floor[:, c])) & (low <= of(self.most[:, c]))
        return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, or the least number where there are fewer."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), _LEAST)


def sliced_products(a: np.ndarray, x: np.ndarray, alive: np.ndarray, wanted: Foremost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, a[i] . x[j]) of the pairs of `alive` that may be wanted: all that are, and few others."""
    bits = max(1, int(max(x.max(initial=0), -x.min(initial=0) - 1)).bit_length())  # planes below the sign
    up, down = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
    real = a.astype(np.float64)  # sums of |a| are below 2^53, so products with bits are exact
    product = lambda k: (real @ ((x >> k) & 1).T.astype(np.float64)).astype(np.int64) << k
    sums = -product(bits)
    for k in range(bits, -1, -1):  # sums hold the planes from k on; the rest is 0 to 2^k - 1 in each component
        if k < bits:
            sums += product(k)
        rest = (1 << k) - 1
        low, high = sums + (down * rest)[:, None], sums + (up * rest)[:, None]
        wanted.tighten(low, high, alive)
        alive = alive & wanted.can(low, high, lambda t: t[:, None])
        if alive.mean() < FEW:
            break
    i, j = np.nonzero(alive)
    score = sums[i, j]
    for k in range(k - 1, -1, -1):
        bit = (x >> k) & 1
        step = max(1, (1 << 22) // max(1, a.shape[1]))
        for s in range(0, len(i), step):
            score[s : s + step] += (a[i[s : s + step]] * bit[j[s : s + step]]).sum(1) << k
        rest = (1 << k) - 1
        keep = wanted.can(score + down[i] * rest, score + up[i] * rest, lambda t: t[i])
        i, j, score = i[keep], j[keep], score[keep]
    return i, j, score


def _foremost(found: list[pd.DataFrame], keys: list[str], k: int) -> pd.DataFrame:
    """The k highest scores of each key; equal ones by smaller id (none: last), then by row."""
    rows = pd.concat(found).sort_values([*keys, "score", "vec_id", "row"], ascending=[True] * len(keys) + [False, True, True], kind="stable")
    return rows[rows.groupby(keys).cumcount() < k]


def _tiles(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray]]:
    width = max((len(v) // 4 for v in (*anchors["v"], *rows["v"])), default=0)
    for s in range(0, len(rows), HELD_ROWS):
        part = rows.iloc[s : s + HELD_ROWS]
        x = _matrix(part["v"], width)
        for t in range(0, len(anchors), HELD_ANCHORS):
            some = anchors.iloc[t : t + HELD_ANCHORS]
            yield some, _matrix(some["v"], width), part, x


def _pairs(anchors: pd.DataFrame, rows: pd.DataFrame, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    at = lambda f, c: f[c].to_numpy(np.int64)
    return pd.DataFrame({"anchor": at(anchors, "row")[i], "row": at(rows, "row")[j], "vec_id": rows["vec_id"].astype("Int64").fillna(_NO_ID).to_numpy(np.int64)[j], "score": score})


def _nearest(k: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k foremost rows of each anchor's own label in this part."""
        found = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor", "row", "vec_id", "score")})]
        for some, a, part, x in _tiles(anchors, rows):
            fit = (some["label"].to_numpy()[:, None] == part["label"].to_numpy()) & (some["row"].to_numpy()[:, None] != part["row"].to_numpy())
            found.append(_foremost([_pairs(some, part, *sliced_products(a, x, fit, Foremost(len(a), k)))], ["anchor"], k))
        return _foremost(found, ["anchor"], k)

    return run


def _hard(k: int, low_percent: int, high_percent: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k foremost rows of other labels in this part for each positive of an anchor, of scores within its bounds."""
        found = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor", "row", "vec_id", "score", "place")})]
        for some, a, part, x in _tiles(anchors, rows):
            given = [[int(s) for s in scores] for scores in some["scores"]]
            most = max(map(len, given))
            # an anchor with fewer positives has ranges that hold nothing
            least = np.array([[-(-low_percent * s // 100) for s in g] + [1] * (most - len(g)) for g in given], np.int64)
            top = np.array([[high_percent * s // 100 for s in g] + [0] * (most - len(g)) for g in given], np.int64)
            fit = some["label"].to_numpy()[:, None] != part["label"].to_numpy()
            i, j, score = sliced_products(a, x, fit, Between(least, top, k))
            pairs = _pairs(some, part, i, j, score)
            inside = [pairs[(score >= least[i, c]) & (score <= top[i, c])].assign(place=c) for c in range(most)]
            found.append(_foremost(inside, ["anchor", "place"], k))
        return _foremost(found, ["anchor", "place"], k)

    return run


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int, run: Callable, schema: str) -> DataFrame:
    """What `run` makes of every block of anchors and every part of rows; each of these has a task's group of its own."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    a = anchors.select("*", dealt(0, blocks).alias("block"), every(parts).alias("part"))
    r = rows.select("row", "vec_id", "label", "v", dealt(1, parts).alias("part"), every(blocks).alias("block"))
    r = r.toDF(*r.columns)  # columns of their own, as both sides come from one table
    return a.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInPandas(run, schema)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `is_anchor` and `label` are expressions over the columns of `rows`. Each
    component x becomes floor(256 x); a score is the inner product with the
    anchor, where a shorter vector counts as filled up with 0. An anchor's
    positives are the `positives` other rows of its label with the highest
    scores (equal ones by smaller id, then by where the row stands); for each
    of them come the `negatives` foremost rows of another label whose score is
    from low_percent to high_percent of the positive's (none if that is
    negative; of a score of 0 only 0).

    Rows with a null label, a null vector, or a component that is null, not
    finite, or beyond what 64-bit sums allow (65,536 either way) take no part.
    A row without an id is no anchor and comes after others of equal score; a
    row that repeats an id is a row of its own. Empty vectors score 0. An
    empty table gives an empty one.
    """
    spark = rows.sparkSession
    taken = rows.select(F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = written(whole_vectors(taken), "vectors")
    size = vectors.agg(F.sum(F.length("v") + 32).alias("all"), F.sum(F.when(F.col("anchor"), F.length("v") + 32)).alias("anchors")).first()
    blocks, parts = 1 + (size["anchors"] or 0) // BLOCK_BYTES, max(PARTS, 1 + (size["all"] or 0) // PART_BYTES)
    anchors = vectors.where("anchor").select("row", "label", "v")

    order = [F.desc("score"), "vec_id", "row"]
    near = _met(anchors, vectors, blocks, parts, _nearest(positives), "anchor long, row long, vec_id long, score long")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)) - 1).where(F.col("place") < positives)
    near = written(near.select("anchor", "place", "vec_id", "score"), "positives")

    scores = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("s")).select(F.col("anchor").alias("row"), F.col("s.score").alias("scores"))
    hard = _met(anchors.join(scores, "row"), vectors, blocks, parts, _hard(negatives, low_percent, high_percent), "anchor long, place int, row long, vec_id long, score long")
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= negatives)

    ids = vectors.where("anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    known = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    both = hard.select("anchor", "place", "rank", known("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(near.select("anchor", "place", known("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "place"])
    return both.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


SQL = """
with rows as (
    select row_number() over () as i, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
    select a.i as anchor, a.vec_id as anchor_id, r.i, r.vec_id, r.label = a.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score
    from rows a join rows r on a.i <> r.i where a.vec_id % 100 = 0),
positives as (
    select anchor, anchor_id, i as positive, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor order by score desc, vec_id, i) <= 5),
negatives as (
    select anchor, positive, p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
        row_number() over (partition by anchor, positive order by score desc, vec_id, s.i) as rank
    from positives p join scored s using (anchor)
    where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negatives where rank <= 10
"""
