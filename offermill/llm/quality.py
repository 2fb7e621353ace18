"""Quality classifier by positive-unlabelled learning (operator 5).

Trusted positives are the documents marked good; all documents of the training
folds, whatever their marks, are the unlabelled web text. A logistic model minimises the non-negative
unbiased risk (Kiryo et al. 2017): the positive part of the unlabelled text is
taken off by the class prior, which is itself estimated from the two samples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.llm.base import remainder, table, texts

#: Documents of either kind that the model is fitted on, at most: a bounded sample, by hash of the id.
SAMPLE = 15_000
#: A word as a classifier sees it: a run without white space.
_SYMBOLS = re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")
_MARKED_END = re.compile(r"[^\w\s.,;:'\")\]]{2,}(?=\s|$)")
_ODD = re.compile(r"[|#$%&*<>{}\[\]\\^~=_@+]")
_STOPS = re.compile(r"[.!?](?=\s|$)")

FEATURES = 20


def features(text: str) -> list[float]:
    """Shares and rates that describe how a text is made, not what it is about. Empty text: all zero."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    m, kinds = len(words), set(words)
    lines = text.split("\n")
    letters = sum(map(len, words))
    upper, symbols, digits = len(_UPPER.findall(text)), len(_SYMBOLS.findall(text)), len(_DIGIT.findall(text))
    runs = sum(map(str.__eq__, words, words[1:]))
    pairs = list(zip(words, words[1:]))
    repeated_pairs = 1 - len(set(pairs)) / max(1, len(pairs))
    repeated_lines = 1 - len(set(lines)) / len(lines)
    marked = len(_MARKED_END.findall(text))
    odd = len(_ODD.findall(text))
    stops = len(_STOPS.findall(text))
    mean = letters / m
    return [
        1.0,
        runs / m,
        repeated_pairs,
        repeated_lines,
        len(kinds) / m,
        len(kinds) / m * np.log1p(m) / 8,
        upper / letters,
        float(upper > 0.5 * letters),
        symbols / letters,
        marked / m,
        odd / letters,
        digits / letters,
        text.count("!") / m,
        text.count("|") / m,
        stops / m,
        float(stops == 0),
        mean / 10,
        abs(mean - 5.5) / 10,
        np.log1p(m) / 10,
        len(lines) / m,
    ]


def feature_rows(column: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in column], float).reshape(len(column), FEATURES)


def with_features(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": list(feature_rows(b["text"]))})

    return docs.mapInPandas(rows, "doc_id long, x array<double>")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the scores of both (best-bin estimate).

    For every threshold the share of unlabelled scores above it, over that of
    the positives, bounds the prior from above but for chance; the least upper
    confidence bound decides.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    at = np.quantile(positive, np.linspace(0, 0.95, 96))
    p = 1 - np.searchsorted(np.sort(positive), at, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at, "left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


class PuModel:
    """A logistic model of standardised features and their products with themselves."""

    def __init__(self, prior: float | None = None, rounds: int = 600, rate: float = 0.05, decay: float = 1e-4):
        self.prior, self.rounds, self.rate, self.decay = prior, rounds, rate, decay

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        z[:, 0] = 1
        return np.hstack([z, np.minimum(z[:, 1:] ** 2, 16) / 4])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x)) if len(x) else np.zeros(0)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray) -> PuModel:
        """Without a positive or an unlabelled row the model says 1/2 of everything."""
        both = np.vstack([positive, unlabelled])
        self.mean, self.spread = (both.mean(0), both.std(0) + 1e-6) if len(both) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.weights = np.zeros(2 * FEATURES - 1)
        if not len(positive) or not len(unlabelled):
            self.prior = self.prior or 0.5
            return self
        p, u = self.inputs(positive), self.inputs(unlabelled)
        if self.prior is None:
            # positives against unlabelled, on one half; the other half's scores give the prior
            w = self._descend(lambda w: self._plain(w, p[::2], u[::2]))
            self.prior = estimate_prior(p[1::2] @ w, u[1::2] @ w)
        self.weights = self._descend(lambda w: self._risk(w, p, u))
        return self

    def _descend(self, gradient) -> np.ndarray:
        """Adam, full batch."""
        w = np.zeros_like(self.weights)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, self.rounds + 1):
            g = gradient(w) + self.decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w

    def _plain(self, w: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        return p.T @ (sigmoid(p @ w) - 1) / len(p) + u.T @ sigmoid(u @ w) / len(u)

    def _risk(self, w: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Gradient of pi R_p(+) + max(0, R_u(-) - pi R_p(-)), logistic loss.

        Where the estimate of the negatives' risk falls below zero, it is
        raised again and the rest waits: that is the non-negative step.
        """
        gp, gu, pi = p @ w, u @ w, self.prior
        negative = self.negative_risk(w, p, u)
        d_negative = u.T @ sigmoid(gu) / len(u) - pi * p.T @ sigmoid(gp) / len(p)
        if negative < 0:
            return -d_negative
        return pi * p.T @ (sigmoid(gp) - 1) / len(p) + d_negative


    def negative_risk(self, w: np.ndarray, p: np.ndarray, u: np.ndarray) -> float:
        """The negatives' share of the risk as both samples estimate it: R_u(-) - pi R_p(-); below zero only by overfitting."""
        return float(np.logaddexp(0, u @ w).mean() - self.prior * np.logaddexp(0, p @ w).mean())

    def risk(self, w: np.ndarray, p: np.ndarray, u: np.ndarray) -> float:
        """pi R_p(+) + max(0, R_u(-) - pi R_p(-))."""
        return float(self.prior * np.logaddexp(0, -(p @ w)).mean()) + max(0.0, self.negative_risk(w, p, u))


def sample_ids(ids: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """So many ids at most, those of least hash: the same ones every time."""
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)) if seed else F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_quality(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> PuModel:
    """A model fitted on `sample` documents marked 1 and as many of all documents, at most, of the rows where `training` holds.

    `docs` has doc_id and text, `labels` doc_id and quality. That a row is
    marked 0 is not used, but it is one of all documents: the risk and the
    prior are those of the whole. Null marks count as none, and a document that
    is marked twice is positive if any mark is 1. Only features are sent to
    the driver.
    """
    marks = labels.where(training & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    positive = sample_ids(marks.where("quality = 1"), sample).withColumn("positive", F.lit(True))
    everything = sample_ids(docs.where(training & F.col("doc_id").isNotNull()), sample, seed=1).withColumn("positive", F.lit(False))
    chosen = F.broadcast(positive.unionByName(everything))  # 2 * sample ids at most
    picked = with_features(docs.join(chosen.select("doc_id"), "doc_id", "left_semi")).join(chosen, "doc_id").orderBy("doc_id")
    rows = picked.toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), FEATURES)
    is_positive = rows["positive"].to_numpy(bool)
    return PuModel().fit(x[is_positive], x[~is_positive])


def quality_score(spark: SparkSession, model: PuModel, text_col: str) -> Column:
    """The model's score (0 to 1) of a text column; null texts count as empty."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(feature_rows(column.fillna(""))))

    return score(F.col(text_col))


def quality_classifier(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) of every document, learnt where `training`, a condition on doc_id, holds.

    Null and empty texts are scored as texts without any feature; repeated
    rows and null ids as they come; an empty table gives an empty one, and
    without labels every score is 1/2.
    """
    rows = texts(docs, id_col, text_col)
    score = quality_score(docs.sparkSession, fit_quality(rows, labels, training, sample), "text")
    return rows.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
