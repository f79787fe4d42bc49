"""Answering a folder that files arrive in: a file stream, one commit of whole documents per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.answering import BatchAnswerer, ColumnAnswerer
from tallyloom.operators.runs import cells_of, charged_tokens, remaining, run
from tallyloom.plans.questions import QuestionSet, call_groups, micro_usd_to_usd, require_fields, tokens_to_micro_usd
from tallyloom.sources import files


def answer_stream(spark: SparkSession, source: str, schema: T.StructType, id_field: str, qs: QuestionSet, answerer: ColumnAnswerer, out: str, checkpoint: str, files_per_batch: int = 64):
    """Answer what is in ``source`` and not yet answered, then stop; the query that did it.

    A batch is written under its number, so a batch that is run again replaces itself, and leaves out the ids that other
    batches have committed: each document's cells are committed once, by the batch that saw it first. Restarting with
    the same ``checkpoint`` resumes.
    """
    require_fields(call_groups(qs), schema.fieldNames())
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    docs = docs.withColumn("doc_id", F.col(f"`{id_field}`").cast("string")).filter("doc_id is not null and doc_id <> ''")

    def commit(batch: DataFrame, number: int) -> None:
        one = batch.dropDuplicates(["doc_id"])
        if files.has_rows(out):
            known = spark.read.parquet(out).filter(F.col("batch") != number).select("doc_id").distinct()
            one = remaining(one, known)
        cells_of(one, qs, answerer).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OutOfBudget(RuntimeError):
    """A stream's budget is spent; with a larger one it goes on where it stopped."""


def run_stream(
    spark: SparkSession, source: str, schema: T.StructType, id_field: str, qs: QuestionSet, answerer: ColumnAnswerer | BatchAnswerer, root: str, checkpoint: str, budget_usd: float = 1.0, files_per_batch: int = 64, **options
):
    """As ``answer_stream``, with everything a run has: each micro-batch is a run of its own under ``root``.

    All batches share the cache, so a state that came before is not asked again, and the budget, which counts what all of
    them were charged. Long states are chunked, unfit ones go to the batch's quarantine. A batch that broke off is
    resumed under its number; an id that an earlier batch answered is left out. When the budget is spent the query
    fails with ``OutOfBudget`` and keeps the batch for the next start.
    """
    require_fields(call_groups(qs), schema.fieldNames())
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def commit(batch: DataFrame, number: int) -> None:
        run_id, path = f"batch-{number:09d}", f"{root}/batches/{number:09d}.parquet"
        manifest = f"{root}/{run_id}/manifest.json"
        if not files.exists(manifest):  # else the rows are there, and some may be answered
            one = batch
            if any(n.startswith("batch-") and files.has_rows(f"{root}/{n}/cells") for n in files.names(root)):
                cells = spark.read.schema("doc_id string").parquet(f"{root}/batch-*/cells/wave=*/question_id=*")
                known = cells.select(F.col("doc_id").alias("_known")).distinct()
                one = batch.join(known, F.col(f"`{id_field}`").cast("string") == F.col("_known"), "left_anti")
            one.write.mode("overwrite").parquet(path)
        elsewhere = charged_tokens(spark, root) - charged_tokens(spark, root, run_id)
        left = budget_usd - micro_usd_to_usd(tokens_to_micro_usd(elsewhere))
        done = run(spark, path, qs, answerer, root, max(0.0, left), id_field=id_field, resume=run_id if files.exists(manifest) else None, run_id=run_id, **options)
        if done.exhausted:
            raise OutOfBudget(f"{run_id}: {done.processed} documents answered before the budget was spent")

    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_stream(events: DataFrame, ts_col: str = "ts", late: str = "7 days") -> DataFrame:
    """Rows by week (from Monday) of a stream; rows later than the watermark are left out of closed weeks."""
    weeks = events.withWatermark(ts_col, late).groupBy(F.window(ts_col, "7 days", startTime="4 days"))
    return weeks.agg(F.count(F.lit(1)).alias("total")).select(F.col("window.start").alias("week"), "total")
