"""A uniform shuffle into shards of exact sizes (operator 11).

In a uniform shuffle the numbers of rows that go from each partition to each
shard follow a multivariate hypergeometric law. They are drawn first, exactly,
as a matrix; then every partition is permuted for itself and cut by its line of
the matrix, the pieces are exchanged, and every shard is permuted again. The
outcome is a uniform choice among all orders of the rows, and no shard is ever
corrected afterwards.

The matrix is drawn in two steps, so that no place holds it whole: the driver
draws the lines of up to BLOCKS blocks of partitions, and one task for each
block divides its line among the block's partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offermill.llm.base import table, texts, written

#: Blocks of partitions that the driver draws for, at most; rows of a shard that one task sorts, about; and the least cells of a shard.
BLOCKS, CELL_ROWS, CELLS = 1024, 50_000, 8
#: Below this population numpy draws.
SMALL = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` out of good + bad are good.

    Beyond what numpy draws: rejection from the universal hat of log-concave
    laws over the integers (Devroye 1987), flat around the mode and exponential
    beyond it.
    """
    if good + bad < SMALL:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    least, most = max(0, drawn - bad), min(drawn, good)
    if least == most:
        return least
    mode = min(most, max(least, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def log_weight(x: int) -> float:
        return -(math.lgamma(x + 1) + math.lgamma(good - x + 1) + math.lgamma(drawn - x + 1) + math.lgamma(bad - drawn + x + 1))

    top, log_choose = log_weight(mode), lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = min(1.0, math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn)))
    w = 1 + p / 2
    while True:
        u, v, sign = rng.random(), rng.random(), rng.choice((-1, 1))
        away = v * w / p if u <= w / (1 + w) else (w + rng.exponential()) / p
        x = mode + int(sign) * round(away)
        if least <= x <= most and math.log(rng.random()) + min(0.0, w - p * away) <= log_weight(x) - top:
            return x


def divided(rng: np.random.Generator, drawn: int, left: list[int]) -> list[int]:
    """How many of each colour are among `drawn` out of left[c] of colour c."""
    out, total = [], sum(left)
    for n in left:
        total -= n
        out.append(hypergeometric(rng, n, total, drawn))
        drawn -= out[-1]
    return out


def matrix_lines(rng: np.random.Generator, rows: list[int], columns: list[int]) -> list[list[int]]:
    """A random matrix of the margins that a uniform shuffle gives: rows[i] go out of place i, columns[j] into shard j."""
    left, out = list(columns), []
    for n in rows:
        out.append(divided(rng, n, left))
        left = [a - b for a, b in zip(left, out[-1])]
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart; the first shards have one more."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """part and ends of every partition of counts (part, n): where its pieces for the shards end, in its own order."""
    spark = counts.sparkSession
    top = counts.agg(F.max("part").alias("p")).first()["p"]
    width = -(-((top or 0) + 1) // BLOCKS)
    block = F.floor(F.col("part") / width).cast("long")
    totals = sorted(map(tuple, counts.groupBy(block.alias("b")).agg(F.sum("n")).collect()))  # BLOCKS rows at most
    lines = matrix_lines(np.random.default_rng([seed, 0]), [n for _, n in totals], shard_sizes(sum(n for _, n in totals), shards))
    drawn = spark.createDataFrame([(b, line) for (b, _), line in zip(totals, lines)], "block long, line array<long>")

    def divide(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("part")
        rng = np.random.default_rng([seed, 1, int(block["block"].iloc[0])])
        lines = matrix_lines(rng, block["n"].astype(int).tolist(), [int(n) for n in block["line"].iloc[0]])
        return pd.DataFrame({"part": block["part"], "ends": [np.cumsum(line).tolist() for line in lines]})

    return counts.withColumn("block", block).join(drawn, "block").groupBy("block").applyInPandas(divide, "part long, ends array<long>")


def uniform_shards(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The rows of docs with shard (0 to shards - 1) and slot (their place in it, from 0), uniformly at random.

    Sizes of shards differ by one at most. All columns and all rows stay, so
    nulls, repeated rows and rows without an id have places of their own; an
    empty table gives an empty one, and with fewer rows than shards the last
    shards are empty. Columns of docs named shard or slot are replaced. The
    outcome depends on the seed and on how the rows lie in partitions; it is
    fixed once the permuted partitions are written, whatever is lost later.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    data = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("data")) if names else docs.select(F.lit(None).cast("int").alias("data"))

    # permute locally: a sort of each partition by random keys
    here = data.select(F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("at"), "data")
    keyed = here.withColumn("key", F.xxhash64(F.lit(seed), F.lit("first"), "at")).sortWithinPartitions("key", "at")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = written(keyed.select("part", place.alias("place"), "data"), "permuted")

    # draw the matrix
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    ends = written(communication_matrix(counts, shards, seed), "matrix")

    # exchange, and permute again: the shard's order is that of random keys, whose high bits say in which cell a row is
    cells = max(CELLS, -(-total // shards // CELL_ROWS))
    key = F.xxhash64(F.lit(seed), F.lit("second"), "part", "place")
    cut = rows.join(ends, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place")))).withColumn("key", key)
    cut = cut.withColumn("cell", F.floor((F.shiftrightunsigned("key", 32) * F.lit(cells)) / float(1 << 32)).cast("long"))
    sizes = cut.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "cell").orderBy("key", "part", "place")
    slots = cut.drop("ends").withColumn("rank", F.row_number().over(order)).join(before, ["shard", "cell"])
    kept = [F.col(f"data.`{c}`") for c in names]
    return slots.select(*kept, F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("rank") - 1).alias("slot"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, uniformly shuffled into 40 shards whose counts are at most one apart (law `rows`)."""
    placed = uniform_shards(texts(table(spark, sf_dir, "documents")), 40)
    size = F.octet_length("text").cast("long") + 16
    return placed.select("doc_id", size.alias("size"), F.crc32("text").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
