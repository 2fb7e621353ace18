"""A training-data pipeline of corpus operators: from raw documents to packed sequences.

Each stage reads all that the one before it kept. The classifiers learn from
`labels`, from the labelled documents that reached them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.llm.base import table, texts, written
from offermill.llm.near_dedup import near_duplicates
from offermill.llm.packing import packed_documents
from offermill.llm.quality import fit_quality, quality_score
from offermill.llm.secrets import redact
from offermill.llm.toxicity import fit_toxicity, toxicity_score

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 1/2 or more)."""
    model = fit_quality(texts(docs), table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(quality_score(spark, model, "text") >= 0.5).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject (score below 1/2)."""
    model = fit_toxicity(texts(docs), table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(toxicity_score(spark, model, "text") < 0.5).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more.

    Documents without an id stay. Of a document whose id repeats every
    different text stays; of equal rows, or such as differ in other columns
    only, the one whose other columns are least.
    """
    kept = near_duplicates(docs, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "rest.*")
    return one.unionByName(docs.where("doc_id is null").select(*COLUMNS)).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew."""
    clean = redact(docs)
    return clean.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a sequence of 4096 tokens."""
    return packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Classifiers, sketches and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
