"""Document fingerprints by consistent weighted sampling (operator 8), in DataFrame functions only.

A text is its words with their counts. For each of SAMPLES draws a word has a
rate r and a cost c, both gamma(2, 1), and a shift b, all from the word's hash;
with t = floor(ln(count) / r + b) the word stands at ln c - r (t - b + 1), and
the text's sample is the (word, t) that stands lowest (Ioffe 2010); see
_least_draws for how they are drawn. Two texts
share a sample with the probability of their generalised Jaccard similarity,
the sum of the lesser counts over that of the greater ones.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offermill.llm.base import table, texts, written

#: Draws in a fingerprint; each is four hexadecimal digits of it.
SAMPLES = 64
#: Draws that are made at once.
BLOCK = 4
#: Bits that say where a word stands; with the 24 below them they are a positive number.
PLACE = 39
#: Characters between words.
WHITE = " \t\n\x0b\x0c\r"
#: Documents in a stretch of the order by id, about, and the number of stretches, at least and at most.
STRETCH, STRETCHES = 1_000_000, (32, 2_000)


def _uniform(h: Column, low: int, bits: int) -> Column:
    """Some bits of a hash as a number between 0 and 1, never either."""
    return (F.shiftrightunsigned(h, low).bitwiseAND((1 << bits) - 1) + F.lit(0.5)) / F.lit(float(1 << bits))


def _least_draws(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block and d0, d1, ...: the draws of each block of the words (word, log_n) of each key, each the least of the words' stands.

    x and y are exponential, and e is one more; a rate r = ln(1 + y / x) + e is
    gamma(2, 1), as is the cost c = x + y apart from it, and b = e / r is a
    uniform shift. With these ln c - r (t - b + 1) is ln x - r t. What stands in
    its place is 1 - exp(-x exp(-r t)), which rises with it: the uniform number
    that x is made of where t is 0, as it is for a word that occurs once. So
    such words take one hash a draw and no logarithm.

    High bits say where a word stands (lower is nearer), the low 24 tell (word,
    t). The steps are selections of their own, so that no hash or logarithm is
    computed twice, and a block is small enough to be compiled as a whole.
    """
    n, each = range(BLOCK), lambda f: [c for k in range(BLOCK) for c in f(k)]
    often = lambda c: F.when(F.col("log_n") > 0, c)
    c = lambda name, k: F.col(f"{name}{k}")
    rows = words.select(*keys, "word", "log_n", F.explode(F.array(*map(F.lit, range(SAMPLES // BLOCK)))).alias("block"))
    rows = rows.select(*keys, "block", "log_n", *each(lambda k: (F.xxhash64("word", "block", F.lit(k)).alias(f"h{k}"), often(F.xxhash64("block", F.lit(k), "word")).alias(f"g{k}"))))
    rows = rows.select(*keys, "block", "log_n", *each(lambda k: (
        c("h", k), often(-F.log1p(-_uniform(c("h", k), 64 - PLACE, PLACE))).alias(f"x{k}"), often(-F.log(_uniform(c("g", k), 0, 32))).alias(f"y{k}"), often(-F.log(_uniform(c("g", k), 32, 32))).alias(f"e{k}"),
    )))
    rows = rows.select(*keys, "block", "log_n", *each(lambda k: (c("h", k), c("x", k), c("e", k), often(F.log1p(c("y", k) / c("x", k)) + c("e", k)).alias(f"r{k}"))))
    rows = rows.select(*keys, "block", *each(lambda k: (c("h", k), c("x", k), c("r", k), often((F.col("log_n") + c("e", k)) / c("r", k)).cast("long").alias(f"t{k}"))))
    stand = lambda k: (-F.expm1(-c("x", k) * F.exp(-c("r", k) * c("t", k))) * float(1 << PLACE)).cast("long")
    low = lambda k: (F.shiftrightunsigned(c("h", k), 1) + c("t", k) * 7919).bitwiseAND((1 << 24) - 1)
    draw = lambda k: F.when(c("t", k) > 0, F.shiftleft(stand(k), 24).bitwiseOR(low(k))).otherwise(F.shiftrightunsigned(c("h", k), 1))
    return rows.groupBy(*keys, "block").agg(*(F.min(draw(k)).alias(f"d{k}") for k in n))


def fingerprints(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint and edited_fingerprint of the texts `text` and `edited` of each key of bodies.

    A word that both texts have as often is drawn for once. Fingerprints are
    bytes here; their digits are written last. If bodies are
    dealt by keys, nothing is shuffled.
    """
    parts = lambda c: F.split(F.btrim(F.lower(c), F.lit(WHITE)), "[ \\t-\\r]+")
    sides = bodies.select(*keys, F.posexplode(F.array("text", "edited")).alias("side", "body"))
    words = sides.select(*keys, "side", F.explode(parts(F.col("body"))).alias("word")).select(*keys, "side", F.xxhash64("word").alias("word"))
    counted = words.groupBy(*keys, "word").agg(F.count_if(F.col("side") == 0).alias("own"), F.count_if(F.col("side") == 1).alias("new"))
    kind = lambda which, n: F.struct(F.lit(which).alias("kind"), n.alias("n"))
    kinds = F.when(F.col("own") == F.col("new"), F.array(kind(0, F.col("own")))).otherwise(F.filter(F.array(kind(1, F.col("own")), kind(2, F.col("new"))), lambda x: x["n"] > 0))
    weighed = counted.select(*keys, "word", F.explode(kinds).alias("k")).select(*keys, "word", "k.kind", F.log("k.n").alias("log_n"))
    drawn = _least_draws(weighed, [*keys, "kind"])
    sides = (("a", 2), ("b", 1))  # words of kind 0 count for both texts, of kind 1 and 2 for one of them
    least = drawn.groupBy(*keys, "block").agg(*(F.min(F.when(F.col("kind") != other, F.col(f"d{k}"))).alias(f"{side}{k}") for side, other in sides for k in range(BLOCK)))
    bits = 64 // BLOCK  # of each draw, so that a block's digits are one number
    packed = lambda side: reduce(Column.bitwiseOR, (F.shiftleft(F.shiftrightunsigned(F.xxhash64(f"{side}{k}"), 64 - bits), 64 - bits * (k + 1)) for k in range(BLOCK)))
    least = least.select(*keys, "block", packed("a").alias("a"), packed("b").alias("b"))
    blocks = range(SAMPLES // BLOCK)
    both = least.groupBy(*keys).agg(*(F.max(F.when(F.col("block") == j, F.col(side))).alias(f"{side}{j}") for side, _ in sides for j in blocks))
    whole = lambda side: F.unhex(F.concat(*(F.lpad(F.hex(f"{side}{j}"), 16, "0") for j in blocks)))
    return both.select(*keys, whole("a").alias("fingerprint"), whole("b").alias("edited_fingerprint"))


def likeness(a: str, b: str) -> Column:
    """The share of draws that two fingerprint columns have in common."""
    same = lambda i: F.col(a).substr(i * 4 + 1, F.lit(4)) == F.col(b).substr(i * 4 + 1, F.lit(4))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), same)) / F.lit(float(SAMPLES))


def next_rows(ids: DataFrame) -> DataFrame:
    """The columns of ids (id, copy and others), next_id and next_copy: the next row by falling id, then rising copy (after the last: the first).

    The order is cut into stretches at quantiles; each is sorted for itself,
    and only the greatest id of each is known outside it.
    """
    total = ids.count()
    low, high = STRETCHES
    stretches = min(high, max(low, math.ceil(total / STRETCH)))
    cuts = ids.agg(F.percentile_approx("id", [i / stretches for i in range(1, stretches)], 20 * stretches).alias("q")).first()["q"] or []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: x < F.col("id"))) if cuts else F.lit(0)
    placed = ids.withColumn("stretch", at)
    tops = {r["stretch"]: r["top"] for r in placed.groupBy("stretch").agg(F.max("id").alias("top")).collect()}  # one row a stretch
    order = sorted(tops)
    over = {s: tops[order[i - 1]] for i, s in enumerate(order)}  # after the lowest stretch: the greatest of all
    then = F.create_map(*(F.lit(x) for kv in over.items() for x in kv))[F.col("stretch")] if over else F.lit(None).cast("long")
    w = Window.partitionBy("stretch").orderBy(F.desc("id"), "copy")
    return placed.select(*ids.columns, F.coalesce(F.lead("id").over(w), then).alias("next_id"), F.coalesce(F.lead("copy").over(w), F.lit(0)).alias("next_copy"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many, or all, of the next document by falling id. Null and
    empty texts have the fingerprint of one empty word. Each row is a document:
    of rows that repeat an id the longest text comes first, then the greatest;
    rows without an id come last. An empty table gives an empty one; one
    document is its own next.
    """
    rows = texts(docs, id_col, text_col).withColumn("n", F.char_length("text").cast("long"))
    # ids that are missing stand after all others; the flag tells them from the least one
    rows = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("doc_id").isNull().alias("unknown"), "n", "text")
    if rows.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        rows = rows.withColumn("copy", F.lit(0))
    else:
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("unknown", F.desc("n"), F.desc("text"))) - 1)
    order = written(next_rows(rows.select("id", "copy", "unknown", "n")), "order")
    rows = rows.select("id", "copy", "text")  # the same in both joins, so that it is dealt once

    # the document's own text and what it takes from the next one's meet by id and copy
    key = ["id", "copy"]
    owners = order.select(F.col("next_id").alias("id"), F.col("next_copy").alias("copy"), F.col("id").alias("owner"), F.col("copy").alias("owner_copy"), "unknown", "n")
    head = rows.join(owners, key).select(F.col("owner").alias("id"), F.col("owner_copy").alias("copy"), "unknown", "n", F.expr("substring(text, 1, cast(n div 2 as int))").alias("head"))
    edited = F.concat(F.expr("substring(text, 1, cast(n - n div 2 as int))"), F.col("head"))
    both = rows.join(head, key).select(*key, "unknown", "n", "text", edited.alias("edited"))
    digest = both.select(*key, "unknown", F.col("n").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha256"))
    pair = written(digest.join(fingerprints(both, key), key), "prints")
    after = order.select(*key, "next_id", "next_copy").join(pair.select(F.col("id").alias("next_id"), F.col("copy").alias("next_copy"), F.col("fingerprint").alias("next_fingerprint")), ["next_id", "next_copy"])
    out = pair.join(after.select(*key, "next_fingerprint"), key)
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    out = out.select(F.when(~F.col("unknown"), F.col("id")).alias("doc_id"), "n_chars", *map(digits, ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")))
    return out.select(*out.columns[:-1], likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
