"""Samples of cells for people to label, and gold rows back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import is_unclear, modal_level, stratum_label


def with_strata(cells: DataFrame, strata: int = 5) -> DataFrame:
    """noul: a bin of the probability; choice and score: option or modal level, and a bin of the confidence."""
    modal = F.when(F.col("type") == "score", modal_level(F.col("probabilities")))
    own = F.when(F.col("type") == "noul", stratum_label(F.col("noul"), strata)).otherwise(
        F.concat_ws(":", F.when(F.col("type") == "choice", F.col("choice")).otherwise(modal), stratum_label(F.col("confidence"), strata))
    )
    return cells.withColumn("modal_level", modal).withColumn("stratum", own)


def allocate(pools: dict[str, int], n: int) -> dict[str, int]:
    """Equal shares; what a small stratum cannot use goes to the others, extras to the first by name."""
    taken, left = dict.fromkeys(pools, 0), n
    open_strata = sorted(k for k, v in pools.items() if v)
    while left > 0 and open_strata:
        share, extra = divmod(left, len(open_strata))
        for k, name in enumerate(open_strata):
            more = min(share + (k < extra), pools[name] - taken[name])
            taken[name] += more
            left -= more
        open_strata = [s for s in open_strata if taken[s] < pools[s]]
    return taken


def seeded_rank(seed: int, *keys: Column) -> Column:
    """A deterministic order that looks random."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)


def stratified_sample(cells: DataFrame, n: int, strata: int = 5, seed: int = 0) -> DataFrame:
    """``n`` cells, equal per stratum, with ``stratum_weight`` = pool / taken.

    The strata's sizes (a few dozen rows) reach the driver; rows are ranked inside their stratum by a seeded digest. The
    same pass counts each stratum's digests below 1, 1/2, 1/4 .. of their range, so only rows below the least such bound
    that leaves enough are ranked: a stratum of a third of all rows isn't sorted in one task.
    """
    rows = with_strata(cells, strata).withColumn("_rank", seeded_rank(seed, F.col("doc_id")))
    lead, halvings = F.conv(F.substring("_rank", 1, 8), 16, 10).cast("bigint"), range(0, 32)
    sized = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("pool"), *(F.count_if(lead < (1 << 32 - k)).alias(f"b{k}") for k in halvings)).collect()
    pools = {r["stratum"]: r["pool"] for r in sized}
    taken = allocate(pools, n)
    if not pools:
        return rows.drop("_rank").withColumn("stratum_weight", F.lit(None).cast("double"))
    bounds = {r["stratum"]: min(1 << 32 - k for k in halvings if r[f"b{k}"] >= taken[r["stratum"]]) for r in sized}
    plan = cells.sparkSession.createDataFrame([(k, pools[k], taken[k], bounds[k]) for k in pools], "stratum string, pool bigint, taken bigint, bound bigint")
    near = rows.join(F.broadcast(plan), "stratum").filter(lead < F.col("bound"))
    w = Window.partitionBy("stratum").orderBy("_rank", "doc_id")
    out = near.withColumn("_n", F.row_number().over(w)).filter("_n <= taken")
    return out.withColumn("stratum_weight", F.col("pool") / F.col("taken")).drop("_n", "_rank", "pool", "taken", "bound")


def random_rows(df: DataFrame, k: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """``k`` rows, uniform and repeatable: the least seeded digests (a distributed top-k)."""
    return df.orderBy(seeded_rank(seed, F.col(key)), key).limit(k)


def label_rows(sample: DataFrame, corpus: DataFrame, fields: list[str]) -> DataFrame:
    """The sample as label rows: what the model said, the document's fields (empty if it is gone), room for gold and notes."""
    docs = corpus.select(F.col("doc_id"), *(F.col(f"`{f}`").cast("string").alias(f) for f in fields))
    return sample.join(docs, "doc_id", "left").select(
        "doc_id", "question_id", "type", "stratum", "stratum_weight", F.col("noul").alias("model_noul"), F.col("choice").alias("model_choice"), F.col("score").alias("model_score"), F.col("modal_level").alias("model_modal_level"),
        "confidence", *(F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f) for f in fields), F.lit("").alias("gold_answer"), F.lit("").alias("notes"),
    )


def gold_join(gold: DataFrame, cells: DataFrame) -> DataFrame:
    """Gold rows with the model's answers; a gold row without a weight weighs 1. Inner on document and question.

    Of several cells of one document and question the latest counts.
    """
    own = cells.select("doc_id", "question_id", "type", "noul", "choice", "score", "confidence", modal_level(F.col("probabilities")).alias("modal_level"), "ts")
    last = own.groupBy("doc_id", "question_id").agg(F.max_by(F.struct("type", "noul", "choice", "score", "confidence", "modal_level"), "ts").alias("c")).select("doc_id", "question_id", "c.*")
    weight = F.coalesce(F.col("stratum_weight"), F.lit(1.0)) if "stratum_weight" in gold.columns else F.lit(1.0)
    return gold.select("doc_id", "question_id", "gold_answer", weight.alias("weight")).join(last, ["doc_id", "question_id"])


def unknown_gold(gold: DataFrame, cells: DataFrame) -> DataFrame:
    """Gold rows whose document has no cell."""
    return gold.join(cells.select("doc_id", "question_id").distinct(), ["doc_id", "question_id"], "left_anti")


def bad_gold(joined: DataFrame, options: DataFrame) -> DataFrame:
    """Gold values that are none of the question's: ``options(question_id, options array)``."""
    g = F.lower(F.trim("gold_answer"))
    wrong = F.when(F.col("type") == "noul", ~g.isin("true", "false")).when(F.col("type") == "choice", ~F.array_contains("options", F.trim("gold_answer"))).otherwise(
        F.trim(F.col("gold_answer")).try_cast("int").isNull() | ~F.array_contains("options", F.trim(F.col("gold_answer")).try_cast("int").cast("string"))
    )
    return joined.join(F.broadcast(options), "question_id").filter(~is_unclear(F.col("gold_answer")) & wrong)
