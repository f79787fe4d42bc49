"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence.

A rule is a host and a path. It fits its host and all subdomains where the
url's path starts with the rule's path. A url is expanded into every suffix of
its host (at label borders) that has as many labels as some rule's host, times
every prefix of its path that has the length of some rule's path, so a url of
very many labels costs what its length costs. Each expression's SHA-256 meets
the rules' in an equi-join on the first hex digits, and the full digests decide.
Of the fitting rules the longest wins; of equally long ones a block, then the
first by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import materialize

#: Rules (a few hundred bytes each at most) that may be broadcast.
BROADCAST_ROWS = 200_000
PREFIX_DIGITS = 8
#: (action, host, path) of the registered query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def label_count(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or without ``://``. The path ends before ``?`` or ``#``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    ``rules(action, host, path)``; ``rule`` is the winner's host and path joined, null where none fits, and then
    ``verdict`` is ``default``. Null urls have an empty host and path and fit only rules of such; rules with a null
    are left out; repeated rows and rules change nothing; a null id keeps its row. Other columns are not read.
    """
    good = rules.select(F.col("action").cast("string").alias("action"), ascii_lower(F.col("host").cast("string")).alias("rule_host"), F.col("path").cast("string").alias("rule_path"))
    good = good.filter("action is not null and rule_host is not null and rule_path is not null").distinct()
    good = good.withColumn("digest", F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    good = materialize(good, "url-rules")
    hint = F.broadcast if good.count() <= BROADCAST_ROWS else (lambda x: x)
    # One row: the path lengths and label counts that rules have.
    shapes = good.agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"), F.sort_array(F.collect_set(label_count("rule_host"))).alias("counts"))

    host, path = split_url(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    # Every row asks for its host and path; equal ones ask once.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = urls.select("host", "path").distinct().repartition(tasks, "host", "path")  # few bytes that grow tenfold: not to be coalesced by their size
    asked = asked.crossJoin(F.broadcast(shapes)).withColumn("labels", label_count("host"))
    asked = asked.select(
        "host", "path", F.expr("transform(filter(counts, n -> n <= labels), n -> substring_index(host, '.', -n))").alias("suffixes"),
        F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)).alias("prefixes"),
    )
    terms = asked.select("host", "path", F.explode("suffixes").alias("suffix"), "prefixes").select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    terms = terms.withColumn("full", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    hits = terms.join(hint(good), "short").filter("full = digest")
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct((-F.length(rule)).alias("n"), (F.col("action") != "block").alias("late"), rule.alias("rule"), F.col("action").alias("action"))
    won = hits.groupBy("host", "path").agg(F.min(rank).alias("won")).withColumnsRenamed({"host": "host2", "path": "path2"})
    # Pages of one url meet in one task otherwise: the winners go to each of 16 salts.
    won = won.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(15))))
    out = urls.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    out = out.join(won.hint("merge"), (F.col("host") == F.col("host2")) & (F.col("path") == F.col("path2")) & (F.col("salt") == F.col("salt2")), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(list(RULES), "action string, host string, path string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP7_SQL = r"""
WITH rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), fits AS (
  SELECT page_id, h || p AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, action DESC, h || p) AS k
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.k = 1
"""
