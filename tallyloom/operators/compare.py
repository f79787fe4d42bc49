"""Variants of questions against a reference, and projections against the full record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import modal_level
from tallyloom.plans.questions import QuestionSet

#: Least agreement and most drift by type.
FLOORS = {"noul": (0.97, 0.05), "choice": (0.95, None), "score": (0.92, 0.15)}


def agreement(reference: DataFrame, variant: DataFrame) -> DataFrame:
    """(question_id, type, n, agreement, drift) over the documents that both have.

    noul: same side of a half, mean distance. choice: same option, mean distance of the reference option's
    probability. score: same modal level, mean distance of scores.
    """
    cols = ("noul", "choice", "score", "probabilities")
    r = reference.select("doc_id", "question_id", "type", *(F.col(c).alias(f"r_{c}") for c in cols))
    v = variant.select("doc_id", "question_id", *(F.col(c).alias(f"v_{c}") for c in cols))
    c = F.col
    own = F.coalesce(F.try_element_at("r_probabilities", c("r_choice")), F.lit(0.0)) - F.coalesce(F.try_element_at("v_probabilities", c("r_choice")), F.lit(0.0))
    same = F.when(c("type") == "noul", (c("r_noul") > 0.5) == (c("v_noul") > 0.5)).when(c("type") == "choice", c("r_choice") == c("v_choice")).otherwise(modal_level(c("r_probabilities")) == modal_level(c("v_probabilities")))
    moved = F.when(c("type") == "noul", F.abs(c("r_noul") - c("v_noul"))).when(c("type") == "choice", F.abs(own)).otherwise(F.abs(c("r_score") - c("v_score")))
    both = r.join(v, ["doc_id", "question_id"])
    return both.groupBy("question_id", "type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(same.cast("double")), F.lit(0.0)).alias("agreement"), F.coalesce(F.avg(moved), F.lit(0.0)).alias("drift"))


def with_floors(agreed: DataFrame, floors: dict = FLOORS) -> DataFrame:
    ok = None
    for kind, (least, most) in floors.items():
        own = F.col("agreement") >= least
        own = own if most is None else own & (F.col("drift") <= most)
        ok = F.when(F.col("type") == kind, own) if ok is None else ok.when(F.col("type") == kind, own)
    return agreed.withColumn("passed", ok.otherwise(False))


def variant_report(agreed: DataFrame, name: str, reference: QuestionSet, variant: QuestionSet) -> DataFrame:
    """One variant's rows with the token counts of both wordings."""
    ids = [(q.id, q.schema_tokens, variant[q.id].schema_tokens) for q in reference.questions if any(x.id == q.id for x in variant.questions)]
    tokens = agreed.sparkSession.createDataFrame(ids, "question_id string, schema_tokens_reference int, schema_tokens_variant int")
    return with_floors(agreed).join(F.broadcast(tokens), "question_id").select(F.lit(name).alias("variant"), "question_id", "type", "agreement", "drift", "schema_tokens_reference", "schema_tokens_variant", "passed")


def ablation(projected: DataFrame, full: DataFrame) -> DataFrame:
    """(question_id, projected, full_record, winner) of two frames with (question_id, accuracy)."""
    p, f = projected.select("question_id", F.col("accuracy").alias("projected")), full.select("question_id", F.col("accuracy").alias("full_record"))
    win = F.when(F.col("projected").isNull() | F.col("full_record").isNull(), "insufficient data").when(F.col("projected") > F.col("full_record"), "projected").when(F.col("projected") < F.col("full_record"), "full-record").otherwise("tie")
    return p.join(f, "question_id", "full").withColumn("winner", win)
