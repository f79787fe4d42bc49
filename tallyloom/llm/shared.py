"""Helpers every training-data operator uses: word rules, shared storage, stars.

Words are maximal runs of anything but space and U+0009..U+000D. ``bytes.split``
and ``WORD_GAP`` implement the same rule on the Python and the JVM side.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; on a cluster
    a machine-local folder would lose data, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    atexit.register(shutil.rmtree, own.removeprefix("file://"), ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tallyloom-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    A lost executor then costs a re-read instead of a recomputation, and what is
    non-deterministic (task attempts, row order) is fixed once.
    """
    path = shared_path(df.sparkSession, label)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote. Only for tables that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tallyloom-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def boxed(docs: DataFrame) -> DataFrame:
    """The rows as one struct column ``_row``, so that no column of theirs meets an operator's; ``select("_row.*")`` undoes it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def text_key(text: Column) -> Column:
    """Second half of a row's key: tells rows apart that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


#: Links of one node that may meet in one task, and nodes of more links (each with one number) that may be broadcast.
HUB, HUBS = 1_000_000, 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``: label = smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until nothing changes; that is proven to end. Each
    round is a partial aggregate and an equi-join, written to the shared folder, so neither the links nor the
    components ever meet in one place. The stars' centres get more and more links; a node of more than ``HUB`` has its
    minimum broadcast to them instead of meeting them in one task, and the bar rises so that such nodes are
    ``HUBS`` at most. Self loops keep a node listed. An empty input gives an empty result.
    """

    def minima(pairs: DataFrame, n: int) -> DataFrame:
        low = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count(F.lit(1)).alias("n"))
        if n <= HUB:
            return pairs.join(low.drop("n"), "a")
        bar = max(HUB, n // HUBS)  # n pairs have n / bar such nodes at most
        known = pairs.join(F.broadcast(low.filter(F.col("n") > bar).drop("n")), "a", "left")
        return known.filter("low is not null").unionByName(known.filter("low is null").drop("low").join(low.filter(F.col("n") <= bar).drop("n"), "a"))

    def written(links: DataFrame) -> tuple[DataFrame, tuple]:
        out = materialize(links, "links")
        return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now, seen = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        before, stars = now, None
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = minima(both, 2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        if 2 * seen[0] > HUB:  # read three times
            stars = large = materialize(large, "large-stars")
        small = minima(large, 2 * seen[0])
        small = small.select("b", "low").union(small.select("a", "low")).toDF("a", "b").filter("a <> b").distinct()
        now, mark = written(small)
        for done in (before, stars):  # what comes now reads the new links alone
            if done is not None:
                discard(done)
        if mark == seen:
            break
        seen = mark
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )
