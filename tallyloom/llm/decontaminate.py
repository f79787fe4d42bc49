"""Benchmark decontamination: short items found inside long documents by containment.

Items are short, documents are not, so the similarity is containment: the share
of an item's distinct word shingles that a document holds. Items are partitioned
by their number of shingles into size classes (powers of two). An item of n
shingles that a document contains to t or more lacks at most n - ceil(t n) of
them there, so of any n - ceil(t n) + 1 shingles one at least is in the
document. Each item's sketch is that many shingles of least hash - a bottom-k
MinHash whose size follows the class's upper bound - and no pair can be missed.

A document's sketch is its shingle hashes up to the widest class's bound, the
greatest hash that any item's sketch holds: none above it can meet one. As
items' sketches are least hashes, that leaves out a good part of a document's
shingles before anything is joined; small items (a few shingles) widen it. The
classes share one equi-join, as equal hashes part them anyway (broadcast if the
sketches, counted first, are few; else by exchange). Pairs that share a
sketch hash are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import WORD_GAP, boxed, materialize, text_key

#: Sketch hashes (8 + 8 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    """Words in lower case, without what is neither letter nor digit at their ends or inside."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.array_remove(F.split(low, WORD_GAP), "")


def shingles(words: Column, size: int) -> Column:
    """Space-joined runs of ``size`` words; fewer words make none."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(size))))).otherwise(F.array().cast("array<string>"))


def hashes(words: Column, size: int) -> Column:
    """Their XXH64-based hashes without building them."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def sketches(items: DataFrame, item_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """(item, grams, n, size_class, sketch): distinct shingles and the least hashes that no match can lack."""
    rows = items.select(F.col(f"`{item_col}`").alias("item"), plain_words(F.col(f"`{text_col}`").cast("string")).alias("words"))
    rows = rows.select("item", F.array_distinct(shingles(F.col("words"), size)).alias("grams"), F.array_sort(F.array_distinct(hashes(F.col("words"), size))).alias("least"))
    rows = rows.filter(F.size("grams") > 0).withColumn("n", F.size("grams"))
    rows = rows.withColumn("size_class", F.ceil(F.log2("n")).cast("int"))
    upper = F.pow(F.lit(2), F.col("size_class"))
    need = (upper - F.ceil(F.lit(threshold) * upper)).cast("int") + 1  # at least that of every n in the class
    return rows.select("item", "grams", "n", "size_class", F.slice("least", 1, F.least(need, F.size("least"))).alias("sketch"))


def contained(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    extra_key: bool = False,
) -> DataFrame:
    """(id_col, item_col, n_shingles, n_shared, containment) of all pairs at ``threshold`` or more.

    Null texts are empty; an item of fewer than ``size`` words has no shingle and matches nothing. Identical rows of
    either table give one pair; rows that repeat an id with other texts give a row each where they match. Null ids are
    kept. Other columns are not read. An empty table on either side gives no pairs.
    """
    sk = materialize(sketches(items, item_col, item_text_col, size, threshold).withColumn("no", F.xxhash64(F.col("item").cast("string"), F.array_join("grams", " "))), "item-sketches")
    keys = sk.select("no", F.explode("sketch").alias("h")).distinct()
    n_keys, bound = keys.agg(F.count(F.lit(1)), F.max("h")).first()
    few = n_keys <= BROADCAST_ROWS

    def sketch(words: Column) -> Column:
        """A document's hashes within the widest class's bound."""
        return F.array_distinct(F.filter(hashes(words, size), lambda h: h <= F.lit(bound)))

    hint = F.broadcast if few else (lambda x: x)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("key"), plain_words(text).alias("words"))
    if few:  # the words ride along and are copied only where a hash is found
        grams = rows.select("id", "key", "words", F.explode(sketch(F.col("words"))).alias("h"))
        pairs = grams.join(hint(keys), "h").groupBy("id", "key", "no").agg(F.first("words").alias("words"))
    else:
        grams = rows.select("id", "key", F.explode(sketch(F.col("words"))).alias("h"))
        pairs = grams.join(keys, "h").select("id", "key", "no").distinct()
        mine = rows.withColumnsRenamed({"id": "id2", "key": "key2"})
        pairs = pairs.join(mine, pairs.id.eqNullSafe(mine.id2) & (pairs.key == mine.key2)).select("id", "key", "no", "words").dropDuplicates(["id", "key", "no"])
    n_items = sk.count()
    both = pairs.join((F.broadcast if n_items <= BROADCAST_ROWS // 10 else (lambda x: x))(sk.dropDuplicates(["no"]).select("no", "item", "grams", "n")), "no")
    both = both.withColumn("n_shared", F.size(F.array_intersect("grams", shingles(F.col("words"), size))))
    both = both.filter(F.col("n_shared") >= threshold * F.col("n"))
    return both.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long"), (F.col("n_shared") / F.col("n")).alias("containment"), *(["key"] if extra_key else [])
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    bad = contained(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), items, "id", "text", extra_key=True, **options)
    bad = materialize(bad.select(F.col("id").alias("_d_id"), F.col("key").alias("_d_key")).distinct(), "contaminated")
    own = lambda c: F.col("_row").getField(c)
    return boxed(docs).join(bad, own(id_col).eqNullSafe(F.col("_d_id")) & (text_key(own(text_col)) == F.col("_d_key")), "left_anti").select("_row.*")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item to 0.8 or more."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH plain AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark
), grams AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))) AS g FROM plain WHERE len(w) >= 5
), sizes AS (SELECT id, count(*) AS n FROM grams WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(s.n) AS n_shingles, count(*) AS n_shared, count(*) / any_value(s.n) AS containment
FROM grams d JOIN grams b ON d.g = b.g AND d.side = 'd' AND b.side = 'b' JOIN sizes s ON s.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(s.n)
"""
