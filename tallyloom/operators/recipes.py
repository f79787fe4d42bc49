"""Queries over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import text_value, threshold_value


def pivot_wide(cells: DataFrame, question_ids: list[str], value: Column | None = None) -> DataFrame:
    """A row per document, a column per question (named, so the plan needs no pass to find them)."""
    own = text_value(F.col("noul"), F.col("choice"), F.col("score")) if value is None else value
    return cells.select("doc_id", "question_id", own.alias("value")).groupBy("doc_id").pivot("question_id", question_ids).agg(F.first("value", True))


def threshold_counts(cells: DataFrame, least: float) -> DataFrame:
    """Answers and confident answers per question; the threshold value counts where it exceeds ``least``."""
    tv = threshold_value(F.col("type"), F.col("noul"), F.col("confidence"))
    return cells.groupBy("question_id").agg(F.count_if(tv > least).alias("n_confident"), F.count(F.lit(1)).alias("n"))


def weekly_coverage(cells: DataFrame, corpus: DataFrame, id_col: str, ts_col: str, least: float) -> DataFrame:
    """Confident answers by week, and their running share of all answers. Weeks start on Monday, UTC."""
    tv = threshold_value(F.col("type"), F.col("noul"), F.col("confidence"))
    times = corpus.select(F.col(id_col).cast("string").alias("doc_id"), F.date_trunc("week", F.col(ts_col)).alias("week"))
    # Files of few bytes can hold very many ids, so sizes in bytes must not choose a broadcast of them: every task would hold them all.
    weeks = cells.join(times.hint("merge"), "doc_id").groupBy("week").agg(F.count(F.lit(1)).alias("total"), F.count_if(tv > least).alias("confident"))
    # One row for each week from here on.
    so_far = Window.orderBy("week").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return weeks.select("week", "total", "confident", F.sum("total").over(so_far).alias("running"), (F.sum("total").over(so_far) / F.sum("total").over(Window.partitionBy())).alias("share"))


def most_uncertain(cells: DataFrame, question_id: str, k: int) -> DataFrame:
    tv = threshold_value(F.col("type"), F.col("noul"), F.col("confidence"))
    return cells.filter(F.col("question_id") == question_id).select("doc_id", tv.alias("tv")).orderBy("tv", "doc_id").limit(k)
