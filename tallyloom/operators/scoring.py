"""Scores of questions against gold: one row per question, never one number over questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import is_adjacent, is_correct, is_unclear, kish, ten_bin, threshold_value, wilson

TARGET, LEAST_N, FLOOR = 0.99, 30, 0.90


def judged(joined: DataFrame) -> DataFrame:
    """Gold rows that say something, with ``correct``, ``adjacent`` and the threshold value."""
    rows = joined.filter(~is_unclear(F.col("gold_answer")))
    c = F.col
    return rows.withColumns(
        {
            "correct": is_correct(c("type"), c("noul"), c("choice"), c("modal_level"), c("gold_answer")).cast("int"),
            "adjacent": F.when(c("type") == "score", F.coalesce(is_adjacent(c("modal_level"), c("gold_answer")), F.lit(False)).cast("int")),
            "tv": threshold_value(c("type"), c("noul"), c("confidence")),
        }
    )


def accuracy(joined: DataFrame) -> DataFrame:
    """question_id, type, n, n_unclear, n_eff, accuracy (weighted), lo, hi, unweighted, adjacent."""
    use = ~is_unclear(F.col("gold_answer"))
    rows = joined.select("question_id", "type", use.alias("use"), F.col("weight").alias("w"), *(F.col(x) for x in ("noul", "choice", "modal_level", "gold_answer")))
    c = F.col
    right = F.when(c("use"), is_correct(c("type"), c("noul"), c("choice"), c("modal_level"), c("gold_answer")).cast("double"))
    near = F.when(c("use") & (c("type") == "score"), F.coalesce(is_adjacent(c("modal_level"), c("gold_answer")), F.lit(False)).cast("double"))
    rows = rows.withColumns({"right": right, "near": near, "uw": F.when(c("use"), c("w"))})
    g = rows.groupBy("question_id", "type").agg(
        F.count_if("use").alias("n"), F.count_if(~c("use")).alias("n_unclear"), F.sum("uw").alias("sw"), F.sum(c("uw") * c("uw")).alias("sw2"), F.sum(c("uw") * c("right")).alias("swr"), F.avg("right").alias("unweighted"), F.sum(c("uw") * c("near")).alias("swn")
    )
    g = g.withColumn("n_eff", F.coalesce(kish(c("sw"), c("sw2")), F.lit(0.0))).withColumn("accuracy", F.when(c("sw") > 0, c("swr") / c("sw")))
    lo, hi = wilson(c("accuracy"), c("n_eff"))
    return g.select("question_id", "type", "n", "n_unclear", "n_eff", "accuracy", lo.alias("lo"), hi.alias("hi"), "unweighted", F.when(c("sw") > 0, c("swn") / c("sw")).alias("adjacent"))


def reliability(joined: DataFrame, probability: bool = False) -> DataFrame:
    """Ten bins per question: n, weighted_n, mean_value, weighted_target.

    Of the confidence against being correct (choice, score), or of a noul's probability against gold being true.
    """
    rows = judged(joined)
    if probability:
        rows = rows.filter("type = 'noul'").withColumns({"v": F.col("noul"), "t": (F.lower(F.trim("gold_answer")) == "true").cast("int")})
    else:
        rows = rows.filter("type <> 'noul'").withColumns({"v": F.col("confidence"), "t": F.col("correct")})
    w = F.col("weight")
    g = rows.groupBy("question_id", ten_bin(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weighted_n"), (F.sum(w * F.col("v")) / F.sum(w)).alias("mean_value"), (F.sum(w * F.col("t")) / F.sum(w)).alias("weighted_target"))
    return g.withColumns({"bin_lower": F.col("bin") / 10, "bin_upper": (F.col("bin") + 1) / 10})


def calibration_error(joined: DataFrame, probability: bool = False) -> DataFrame:
    """(question_id, ece): weighted mean distance of the bins' targets from their values."""
    g = reliability(joined, probability).groupBy("question_id")
    return g.agg((F.sum(F.col("weighted_n") * F.abs(F.col("weighted_target") - F.col("mean_value"))) / F.sum("weighted_n")).alias("ece"))


def thresholds(joined: DataFrame, target: float = TARGET, least_n: int = LEAST_N) -> DataFrame:
    """(question_id, threshold, coverage): the lowest value at or above which enough rows are right often enough.

    Rows are pre-aggregated by value, so the suffix sums run over distinct values. Null where none qualifies.
    """
    rows = judged(joined)
    w = F.col("weight")
    by = rows.groupBy("question_id", "tv").agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col("correct")).alias("wc"))
    above = Window.partitionBy("question_id").orderBy(F.desc("tv")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = by.select("question_id", "tv", *(F.sum(c).over(above).alias(f"s{c}") for c in ("w", "w2", "wc")))
    total = by.groupBy("question_id").agg(F.sum("w").alias("tw"))
    ok = s.filter((kish(F.col("sw"), F.col("sw2")) >= least_n) & (F.col("swc") / F.col("sw") >= target))
    first = ok.groupBy("question_id").agg(F.min(F.struct("tv", "sw")).alias("f"))
    return total.join(first, "question_id", "left").select("question_id", F.col("f.tv").alias("threshold"), (F.col("f.sw") / F.col("tw")).alias("coverage"))


def verdicts(scored: DataFrame, gates: DataFrame, floor: float = FLOOR, least_n: int = LEAST_N) -> DataFrame:
    """``verdict`` for ``scored(question_id, n, accuracy)``; a missing gate is strict."""
    gate = F.coalesce("gate", F.lit("strict"))
    v = F.when((F.col("n") < least_n) | F.col("accuracy").isNull(), "INSUFFICIENT").when(F.col("accuracy") >= floor, "PASS").when(gate == "exploratory", "FAIL — exploratory only").otherwise("FAIL")
    return scored.join(F.broadcast(gates), "question_id", "left").withColumn("verdict", v)


def strict_failure(judged_questions: DataFrame) -> DataFrame:
    return judged_questions.agg(F.coalesce(F.bool_or(F.col("verdict") == "FAIL"), F.lit(False)).alias("failed"))


def score_questions(joined: DataFrame, target: float = TARGET) -> DataFrame:
    """Everything about each question in one row."""
    out = accuracy(joined)
    out = out.join(calibration_error(joined).withColumnRenamed("ece", "ece_confidence"), "question_id", "left")
    out = out.join(calibration_error(joined, True).withColumnRenamed("ece", "ece_probability"), "question_id", "left")
    return out.join(thresholds(joined, target), "question_id", "left")
