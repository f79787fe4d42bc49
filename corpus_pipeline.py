"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality rules: documents that the vote model or the base rules reject go;
2. near-dedup: candidates by BK-trees of five-word fingerprints at 4 bits, and by MinHash bands beyond those; one document of each
   component of texts at five-word Jaccard 0.8 or more stays (least id, then least text hash);
3. decontamination: documents that contain a benchmark item go;
4. secret scans: reported spans are blanked in the texts; who owns a value is counted over ``documents``, copies included;
5. packing: boundary records of the token windows.

The first four return the columns of ``documents``, the last one its pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, overlaps, packing, quality, secrets
from tallyloom.llm.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return overlaps.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, corpus=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.byte_bpe())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: EM, fingerprints and tokens are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
