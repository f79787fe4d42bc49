"""Corpora in and tables out."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.schemas import schema
from tallyloom.sources import files
from tallyloom.sources.files import read_json, write_json  # noqa: F401

CELL_SCHEMA = schema(
    "doc_id string, question_id string, type string, noul double, choice string, score double, probabilities map<string,double>, legend map<string,string>, confidence double, confidence_source string, gate string, "
    "chunk_count int, projection_id string, call_id string, run_id string, model string, questionset_hash string, question_body_hash string, input_tokens bigint, ts timestamp"
)
CELL_COLUMNS = [f.name for f in CELL_SCHEMA]
LABEL_HEAD = "doc_id,question_id,type,stratum,stratum_weight,model_noul,model_choice,model_score,model_modal_level,confidence".split(",")
LABEL_NUMBERS = {"stratum_weight", "model_noul", "model_score", "confidence"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All strings; an empty cell is an empty string, a missing one null. Quoted line breaks are kept."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: Parquet (file or folder), CSV, JSON lines, ORC."""
    kind = Path(path.rstrip("/")).suffix.lower()
    if kind == ".csv":
        return read_csv(spark, path)
    if kind in (".jsonl", ".ndjson"):
        return spark.read.json(path)
    if kind in (".parquet", ".orc"):
        return spark.read.format(kind[1:]).load(path)
    raise ValueError(f"cannot read {path}: not .parquet, .csv, .jsonl or .orc")


def count_rows(spark: SparkSession, path: str) -> int:
    return read_source(spark, path).count()


def plain(df: DataFrame) -> DataFrame:
    """Fields that JSON has no form for (times, decimals, binary) as strings."""
    odd = (T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType)
    cast = {f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema if isinstance(f.dataType, odd)}
    cast |= {f.name: F.base64(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.BinaryType)}
    return df.withColumns(cast) if cast else df


PLACE, FILE, MANY_FILES = "__row_place", "__row_file", 100_000


def with_places(df: DataFrame) -> DataFrame | None:
    """``df`` with each row's number over all files, if its files number their rows: rows of earlier files plus the row's own."""
    try:
        located = df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:
        return None
    sizes = located.groupBy(FILE).agg((F.max(PLACE) + 1).alias("n"))
    # A row for each file: the running sum over them is small.
    before = sizes.select(FILE, (F.sum("n").over(Window.orderBy(FILE)) - F.col("n")).alias("__rows_before"))
    if before.count() <= MANY_FILES:
        before = F.broadcast(before)
    return located.join(before, FILE).withColumn(PLACE, F.col(PLACE) + F.col("__rows_before")).drop(FILE, "__rows_before")


def normalize(df: DataFrame, id_field: str | None = None, order: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine): ``doc_id``, ``row_index`` and ``id_source`` in front of the fields.

    Without ``id_field`` the id is the hash of the row's fields. The first row of an id stays; rows without an id and
    later rows of one go to quarantine with a reason. ``order`` (columns) is the row order; the default is the place in
    the files: by path, then by row. Parquet tells it, however the files are split; of other formats it is the scan's.
    """
    fields = plain(df)
    position = F.monotonically_increasing_id()
    if order is None and (placed := with_places(fields)) is not None:
        fields, position = placed, F.col(PLACE)
    if id_field:
        own = F.col(f"`{id_field}`").cast("string")
        doc_id = F.when(own != "", own)
    else:
        doc_id = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    rows = fields.select(doc_id.alias("doc_id"), position.alias("row_index"), F.lit("field" if id_field else "content").alias("id_source"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("fields"))
    by = [F.col(f"fields.`{c}`") for c in order] if order else [F.col("row_index")]
    # The least row of an id by a partial aggregate: a group of copies is not sorted in one task.
    first = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*[c.alias(f"k{n}") for n, c in enumerate(by)], F.col("row_index"))).alias("first"))
    joined = rows.join(first.select("doc_id", F.col("first.row_index").alias("first_index")), "doc_id", "left")
    kept = joined.filter("row_index = first_index").select("doc_id", "row_index", "id_source", "fields.*") if "doc_id" not in df.columns else joined.filter("row_index = first_index").select("doc_id", "row_index", "id_source", *(F.col(f"fields.`{c}`").alias(c) for c in df.columns if c != "doc_id"))
    reason = F.when(F.col("doc_id").isNull(), "missing id").otherwise("duplicate id")
    bad = joined.filter("first_index is null or row_index <> first_index").select("row_index", "doc_id", reason.alias("reason"), F.to_json("fields").alias("raw"))
    return kept, bad


def first_documents(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents in row order; taken before finished ones are left out."""
    return docs.orderBy("row_index").limit(n)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV; number columns are doubles, empty ones null. Files of doc_id and gold_answer only are read, too."""
    df = read_csv(spark, path)
    return df.select(*((F.col(f"`{c}`").try_cast("double") if c in LABEL_NUMBERS else F.col(f"`{c}`")).alias(c) for c in df.columns))


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One CSV file for people: labels, review queues, reports."""
    files.write_one(df, path, overwrite)


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """By question, so that a question's scan reads its own files."""
    cells.select(*CELL_COLUMNS).write.mode(mode).partitionBy("question_id").parquet(path)


def read_cells(spark: SparkSession, path: str, question_id: str | None = None, chunked: bool = True) -> DataFrame:
    df = spark.read.schema(CELL_SCHEMA).parquet(path).select(*CELL_COLUMNS)
    if question_id is not None:
        df = df.filter(F.col("question_id") == question_id)
    return df if chunked else df.filter("chunk_count = 1")
