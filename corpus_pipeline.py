"""The corpus pipeline: toxicity, near-dedup, benchmark decontamination, PII, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; ``n_chars`` follows the text. Null and repeated
rows are handled as the operators state; rows of one repeated doc_id stay or go together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, decontaminate, minhash, packing, pii, toxicity

#: Near copies share so many in a hundred of their five-word shingles; op7 has its own threshold.
SIMILAR = 80

ORACLE_SQL = None  # a learned model, hashing and masking: not SQL; tests hold the stages against brute force


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    gone = minhash.near_duplicates(docs, SIMILAR).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without spans of benchmark items, and without documents that are mostly such."""
    return _counted(decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark")))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind."""
    return _counted(pii.mask(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", mask_private),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
