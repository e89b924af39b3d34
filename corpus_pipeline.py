"""From raw documents to packed training sequences.

Stages, each written as Parquet and read again by the next: quality (rejected documents go), near-duplicates (one
document of each group stays, five-word shingles at 0.8), benchmark decontamination (documents that hold a benchmark
passage go), personal data (spans are masked), packing (pieces of 4096-token sequences). All but the last return the
columns of their input, extra ones included. SQL cannot express the classifier, so ORACLE_SQL is None; tests hold the
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common, decontaminate, minhash, packing, pii, quality
from threadloom.operators.cutting import Workspace


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled rows outside the held-out fold."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), common.remainder("doc_id", 4) != 2)
    if model is None:
        return docs
    name = common.free_name(docs, "score")
    return quality.with_score(docs, model, name).filter(F.col(name) >= quality.ACCEPT).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return minhash.drop_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.remove_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    work = Workspace(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return docs
