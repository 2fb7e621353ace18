"""Toxicity by a counterfactual-regularised classifier (operator 1).

A linear model over words and their beginnings and ends. Besides fitting the
labels it is punished for every change of score that comes from swapping a
group's name for another's in a labelled sentence, so that a group's mention
alone says nothing (Garg et al. 2019, "counterfactual logit pairing"). A
sentence that names no group has a name put to its end first: names share
beginnings and ends with words that the labels make suspicious, whether or not
any labelled sentence names them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.llm.base import Remembered, Sent, remainder, table, texts
from offermill.llm.quality import sample_ids, sigmoid

#: Labelled documents that weights are fitted on, at most: a bounded sample, by hash of the id.
SAMPLE = 10_000
#: Features that the model has, at most: those that tell the labels apart best.
MOST_FEATURES = 20_000
#: Labelled rows that are sent to where the texts lie, at most (16 bytes each); beyond, texts and labels are shuffled to meet.
MOST_SENT = 500_000
#: Features of so many rows are multiplied at once while weights are fitted.
BLOCK = 1 << 19
#: Word scores that a task remembers.
REMEMBERED = 250_000
#: Names of groups, by sets within which they are swapped.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "homosexual", "heterosexual", "schwul", "lesbisch"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "muslimisch", "christlich", "jüdisch", "musulman", "chrétien", "juif", "musulmán", "cristiano", "judío"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese", "arab"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals", "einwanderer", "flüchtlinge", "immigrés", "inmigrantes"),
    ("disabled", "blind", "deaf", "old", "young", "elderly", "behindert", "handicapé", "discapacitado"),
)

_WORD = re.compile(r"\w+").findall
_SET_OF = {term: i for i, terms in enumerate(IDENTITY_TERMS) for term in terms}


def words(text: str) -> set[str]:
    return set(_WORD(text.lower()))


def swaps(found: list[str]) -> Iterator[tuple[str, str | None]]:
    """All swaps of a name in a text for another of its set: (name, other), other None where the text has that one too."""
    for a in found:
        for b in IDENTITY_TERMS[_SET_OF[a]]:
            if b != a:
                yield a, None if b in found else b


def put_in(text: str) -> str:
    """The name that a text without any has put to its end: by its hash, of all sets alike."""
    at = zlib.crc32(text.encode())
    terms = IDENTITY_TERMS[at % len(IDENTITY_TERMS)]
    return terms[at // len(IDENTITY_TERMS) % len(terms)]


def features_of(word: str) -> list[int]:
    """Hashes of the word, of its first 3 to 6 letters and of its last 4, where it has more."""
    parts = [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5, 6) if len(word) > k)]
    if len(word) > 5:
        parts.append(f"{word[-4:]}$")
    return [zlib.crc32(p.encode()) for p in parts]


def label_counts(marked: DataFrame) -> DataFrame:
    """feature, in_toxic, in_other: in how many of the documents (text, toxic) each feature occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Remembered(features_of, REMEMBERED // 5)
        for b in batches:
            n: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(b["text"], b["toxic"]):
                for f in {f for w in words(text) for f in known[w]}:
                    n[f][toxic] += 1
            if n:
                yield pd.DataFrame({"feature": list(n), "in_other": [v[0] for v in n.values()], "in_toxic": [v[1] for v in n.values()]})

    counted = marked.select("text", F.col("toxic").cast("int")).mapInPandas(count, "feature long, in_other long, in_toxic long")
    return counted.groupBy("feature").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_other").alias("in_other"))


class ToxicityModel(Sent):
    """Weights by feature; a text's raw score is the bias and the sum over its distinct words."""

    made = ("index", "weights", "bias")

    def __init__(self, selected: list[int], swap_strength: float = 1.0, decay: float = 5e-5, rounds: int = 400, rate: float = 0.1):
        names = [features_of(t)[0] for terms in IDENTITY_TERMS for t in terms]  # the names as whole words only
        self.index = {f: i for i, f in enumerate(dict.fromkeys([*selected, *names]))}
        self.swap_strength, self.decay, self.rounds, self.rate = swap_strength, decay, rounds, rate
        self.weights, self.bias = np.zeros(len(self.index)), 0.0

    def columns(self, word: str) -> list[int]:
        return [self.index[f] for f in features_of(word) if f in self.index]

    def row(self, text: str) -> tuple[dict[int, int], list[str]]:
        """The text's features with the number of words that have them, and the group names in it, or the one put in."""
        found = words(text)
        return Counter(i for w in found for i in self.columns(w)), sorted(found & _SET_OF.keys()) or [put_in(text)]

    def swap_table(self, names: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What swaps change: for each kind of swap the weights that come in (1) and go out (-1), and its share of all swaps.

        A swap changes the raw score by the weights of the name that comes in
        less those of the one that goes, or by the latter alone where the text
        has the other name already; whatever else is in the text. So a kind
        counts as often as sentences have it.
        """
        kinds = Counter(k for found in names for k in swaps(found))
        total = sum(kinds.values())
        pairs = [(self.columns(a), self.columns(b) if b else [], k / total) for (a, b), k in kinds.items()]
        at = np.array([p for p, (x, y, _) in enumerate(pairs) for _ in (*x, *y)], np.int64)
        column = np.array([i for x, y, _ in pairs for i in (*x, *y)], np.int64)
        sign = np.array([v for x, y, _ in pairs for v in (*[-1.0] * len(x), *[1.0] * len(y))])
        return at, column, sign, np.array([k for *_, k in pairs])

    def penalty(self, names: list[list[str]]) -> float:
        """The mean square of what swaps change."""
        at, column, sign, share = self.swap_table(names)
        return float((share * np.bincount(at, sign * self.weights[column], len(share)) ** 2).sum())

    def fit(self, columns: list[np.ndarray], counts: list[np.ndarray], names: list[list[str]], toxic: np.ndarray) -> ToxicityModel:
        """fit_rows() of features and counts that lie row by row."""
        sizes = np.array([len(c) for c in columns], np.int64)
        return self.fit_rows(sizes, np.concatenate([*columns, np.zeros(0, np.int32)]), np.concatenate([*counts, np.zeros(0, np.int32)]), names, toxic)

    def fit_rows(self, sizes: np.ndarray, columns: np.ndarray, counts: np.ndarray, names: list[list[str]], toxic: np.ndarray) -> ToxicityModel:
        """Logistic loss + decay + swap_strength times the mean square of what swaps change.

        Of each row: how many features it has, all rows' features one after
        another and the number of words that have each, the group names in it
        (or put in), and its label. Without rows of both kinds the model says
        the same of everything: toxic only if all labels do.
        """
        n = len(toxic)
        if not n or toxic.min() == toxic.max():
            self.bias = 6.0 if n and toxic.min() else -6.0
            return self
        columns, values = columns.astype(np.int32), counts.astype(np.float32)
        ends = np.concatenate([[0], sizes.cumsum()])
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], BLOCK), "right") - 1, n))
        parts = [(slice(i, j), slice(ends[i], ends[j]), np.repeat(np.arange(j - i, dtype=np.int32), sizes[i:j])) for i, j in zip(cuts, cuts[1:])]
        s_at, s_col, s_val, s_share = self.swap_table(names)
        # what few rows show is trusted less
        decay = self.decay * np.maximum(1.0, n / 50 / np.maximum(1, np.bincount(columns, minlength=len(self.index))))
        w, b = np.zeros(len(self.index)), float(np.log(toxic.mean() / (1 - toxic.mean())))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, self.rounds + 1):
            g, off_sum = decay * w, 0.0
            for rows, own, at in parts:
                off = sigmoid(b + np.bincount(at, values[own] * w[columns[own]], rows.stop - rows.start)) - toxic[rows]
                g += np.bincount(columns[own], values[own] * off[at], len(w)) / n
                off_sum += off.sum()
            if len(s_share):
                change = np.bincount(s_at, s_val * w[s_col], len(s_share))
                g += 2 * self.swap_strength * np.bincount(s_col, s_val * (s_share * change)[s_at], len(w))
            gb = off_sum / n
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            step = self.rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= step * m / (np.sqrt(v) + 1e-8)
            b -= step * mb / (np.sqrt(vb) + 1e-8)
        self.weights, self.bias = w, b
        return self

    def start(self) -> None:
        self.known = Remembered(lambda w: float(sum(self.weights[i] for i in self.columns(w))), REMEMBERED)

    def raw(self, text: str) -> float:
        return self.bias + sum(map(self.known.__getitem__, words(text)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, most: int = MOST_FEATURES, **options) -> ToxicityModel:
    """Features are chosen by counts over all labelled rows where `training` holds, weights fitted on `sample` of these, at most.

    `docs` has doc_id and text, `labels` doc_id and toxic. Null marks count as
    none; a document that is marked twice is toxic if any mark is 1.
    """
    marks = labels.where(training & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    t, o = max(1, totals.get(1, 0)), max(1, totals.get(0, 0))
    marked = docs.where(training).join(F.broadcast(marks) if t + o <= MOST_SENT else marks.hint("merge"), "doc_id")
    p = (F.col("in_toxic") + F.col("in_other")) / (t + o)
    z = (F.col("in_toxic") / t - F.col("in_other") / o) / F.sqrt(p * (1 - p) * (1 / t + 1 / o) + 1e-12)
    chosen = label_counts(marked).withColumn("z", F.abs(z)).where("in_toxic + in_other >= 3 and z > 4.5").orderBy(F.desc("z"), "feature").limit(most)
    model = ToxicityModel([r["feature"] for r in chosen.collect()], **options)  # `most` rows at most

    sent = docs.sparkSession.sparkContext.broadcast(model)
    ids = F.broadcast(sample_ids(marks, sample).join(marks, "doc_id"))  # `sample` ids at most: texts stay where they are

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sent.value.row(text) for text in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "columns": [list(c) for c, _ in found], "counts": [list(c.values()) for c, _ in found], "names": [n for _, n in found]})

    got = docs.where(training).join(ids, "doc_id").select("doc_id", "text", "toxic").mapInPandas(rows, "doc_id long, toxic int, columns array<int>, counts array<int>, names array<string>").orderBy("doc_id").toArrow()
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(got["columns"]).to_numpy().astype(np.int64)
    return model.fit_rows(sizes, flat("columns"), flat("counts"), got["names"].to_pylist(), got["toxic"].to_numpy().astype(float))


def toxicity_score(spark: SparkSession, model: ToxicityModel, text_col: str) -> Column:
    """The model's score (0 to 1) of a text column; null texts count as empty."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        own.start()
        for b in batches:
            yield pd.Series(sigmoid(np.array([own.raw(t) for t in b.fillna("")], float)))

    return score(F.col(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) of every document, learnt where `training`, a condition on doc_id, holds.

    Null and empty texts have the score of a text without words; repeated rows
    and null ids are scored as they come; an empty table gives an empty one,
    and without labels of both kinds every score is the same, near 0 unless
    all labels are 1.
    """
    rows = texts(docs, id_col, text_col)
    score = toxicity_score(docs.sparkSession, fit_toxicity(rows, labels, training, sample, **options), "text")
    return rows.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
