"""Review queue and overrides: people's answers laid over the cells at read time."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import modal_level, threshold_value
from tallyloom.functions.schemas import schema

OVERRIDES = schema("doc_id string, question_id string, human_answer string, reviewer string, ts timestamp, source_run_id string")


def review_queue(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Unchunked cells strictly below their question's threshold; questions without one have none."""
    limits = thresholds.filter("threshold is not null").select("question_id", "threshold")
    rows = cells.filter("chunk_count = 1").join(F.broadcast(limits), "question_id")
    rows = rows.filter(threshold_value(F.col("type"), F.col("noul"), F.col("confidence")) < F.col("threshold"))
    return rows.select(
        "doc_id", "question_id", "type", F.col("noul").alias("model_noul"), F.col("choice").alias("model_choice"), F.col("score").alias("model_score"), F.when(F.col("type") == "score", modal_level(F.col("probabilities"))).alias("model_modal_level"), "confidence"
    )


def with_fields(queue: DataFrame, corpus: DataFrame, fields: list[str]) -> DataFrame:
    docs = corpus.select("doc_id", *(F.col(f"`{f}`").cast("string").alias(f) for f in fields))
    return queue.join(docs, "doc_id", "left").withColumns({f: F.coalesce(F.col(f"`{f}`"), F.lit("")) for f in fields} | {"human_answer": F.lit("")})


def overrides_from(filled: DataFrame, reviewer: str, run_id: str, ts: datetime.datetime | None = None) -> DataFrame:
    """Answered rows of a filled queue; blank ones are skipped."""
    when = F.lit(ts).cast("timestamp") if ts else F.current_timestamp()
    rows = filled.filter(F.trim(F.coalesce("human_answer", F.lit(""))) != "")
    return rows.select("doc_id", "question_id", F.trim("human_answer").alias("human_answer"), F.lit(reviewer).alias("reviewer"), when.alias("ts"), F.lit(run_id).alias("source_run_id"))


def append_overrides(overrides: DataFrame, path: str) -> None:
    overrides.select(*OVERRIDES.fieldNames()).write.mode("append").parquet(path)


def merged(cells: DataFrame, overrides: DataFrame, latest_only: bool = False) -> DataFrame:
    """Cells with ``human_answer`` and ``value`` (the human's answer first). Two overrides of a cell give two rows unless ``latest_only``."""
    own = overrides
    if latest_only:
        own = overrides.groupBy("doc_id", "question_id").agg(F.max_by("human_answer", F.struct("ts", "human_answer")).alias("human_answer"))
    joined = cells.join(own.select("doc_id", "question_id", "human_answer"), ["doc_id", "question_id"], "left")
    return joined.withColumn("value", F.coalesce("human_answer", "choice", F.col("noul").cast("string"), F.col("score").cast("string")))
