"""Secret scans judged by corpus-wide ownership.

Candidates come from two sets of patterns. The base kinds (assign, access, hex)
are reported whenever they match. Further kinds (token formats, private keys,
credentials in headers and urls, long runs of mixed letters and digits) match
much that is public, so their spans are added only if the corpus says that the
value is somebody's own. Each candidate's value, of either set, is hashed and
aggregated over the whole table by distinct owners and distinct repositories: a
value that many owners or very many repositories hold is a widely copied
example, any other is live. Base spans carry the same verdict beside them.

Positions are code points. Spark has no function for the places of all matches,
but the text between matches (split) and the matches (regexp_extract_all) of
the same pattern add up to them. The sums are taken in blocks, so a text of very
many matches costs little more than each match by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import boxed, materialize, text_key

SALTS = 16
#: Most distinct owners, and most distinct repositories (documents, unless a column names them), of a value that is
#: still somebody's own. On a table of 51,282 documents of 20 owners values have 1 to 3 owners or 18 and more, and 1 to 5
#: documents or 57 and more.
MOST_OWNERS, MOST_REPOSITORIES = 4, 100


@dataclass(frozen=True)
class Kind:
    """A pattern with its value's group, and what a match must have to count.

    ``hint`` is a cheap pattern that every text with a match fits. A ``spare`` kind's match is left out where a match of
    another kind covers it.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None
    spare: bool = False


#: Runs of hex digits and AKIA runs are maximal, so their length can stand in the pattern. A short assignment
#: consumes its text without counting, so its length is tested on the match.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)password|passwd|secret|token|api_?key"),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
EXTRA = (
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY"),
    Kind("forge", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", 0, 1, "gh[pousr]_|glpat-"),
    Kind("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox[abprs]-"),
    Kind("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
    Kind("bearer", r"\b[Bb]earer\x20+([A-Za-z0-9._~+/-]{16,}=*)", 1, 16, "[Bb]earer"),
    Kind("basic", r"://[^\s/:@]+:([^\s/:@]{6,})@", 1, 6, "://"),
    # 20 or more letters and digits that change at least three times; runs of hex digits and access keys are base kinds.
    Kind("mixed", r"(?<![A-Za-z0-9_-])(?![0-9a-f]{24,}+(?![A-Za-z0-9_-]))(?!AKIA)(?=(?:[A-Za-z_-]*+[0-9]++){3}[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+", spare=True),
)
SPAN = "struct<kind:int,name:string,start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(array: Column, size: Column) -> Column:
    """``array`` as an array of arrays of ``size`` elements; an empty one gives an empty one."""
    n = F.size(array)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(array, k * size + 1, size))


def running(numbers: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running results of an associative ``op`` (sums unless given) over an array of ints.

    A fold that appends copies what it has, so it runs over blocks of about the cube root of the size, and over the
    blocks' results: n elements cost n ** (4 / 3) copies.
    """

    def fold(xs: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            return F.concat(acc, F.array(F.when(last.isNull(), x).otherwise(op(last, x))))

        return F.aggregate(xs, F.array().cast("array<int>"), step)

    def joined(parts: Column) -> Column:
        ends = fold(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(let(F.get(e, k - 1), lambda before: F.transform(p, lambda x: op(before, x)))))))

    return let(numbers, lambda xs: let(F.transform(in_blocks(xs, F.greatest(F.lit(1), F.ceil(F.cbrt(F.size(xs))).cast("int"))), fold), joined))


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """array<SPAN> of the kind's matches in ``text``: leftmost, not overlapping; failing ones dropped."""
    lit = F.lit(kind.pattern)
    gaps, whole = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, lit, F.lit(0))
    values = F.regexp_extract_all(text, lit, F.lit(kind.group)) if kind.group else whole

    def span(r: Column, end: Column) -> Column:
        start = end - F.length(r["m"])
        return F.struct(F.lit(order).alias("kind"), F.lit(kind.name).alias("name"), start.alias("start"), end.alias("end"), r["v"].alias("value"))

    # One gap more than matches: the last one is not in front of any.
    rows = F.filter(F.arrays_zip(gaps.alias("g"), whole.alias("m"), values.alias("v")), lambda r: r["m"].isNotNull())
    found = let(rows, lambda xs: F.zip_with(xs, running(F.transform(xs, lambda r: F.length(r["g"]) + F.length(r["m"]))), span))
    found = F.filter(found, lambda x: F.length(x["value"]) >= kind.least)
    return F.when(text.rlike(kind.hint or kind.pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["name"].alias("name"), x["end"].alias("end"), x["value"].alias("value")))
    return F.array_sort(keyed)


def without_covered(spans: Column, spare: list[int]) -> Column:
    """Sorted ``spans`` without those of the ``spare`` kinds that one of another kind covers."""
    if not spare:
        return spans
    other = lambda x: ~x["kind"].isin(spare)
    # A covering span starts at the same place or before, and spare kinds come last at a place.
    reach = lambda xs: running(F.transform(xs, lambda x: F.when(other(x), x["end"]).otherwise(0)), F.greatest)
    keep = lambda xs: F.filter(F.zip_with(xs, reach(xs), lambda x, r: F.when(other(x) | (x["end"] > r), x)), lambda x: x.isNotNull())
    return let(spans, keep)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(ordered(spans), lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ownership(candidates: DataFrame, most_owners: int, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """(value_hash, n_owners, n_repositories, example) of ``candidates(value_hash, owner, repository)``.

    An example has more than ``most_owners`` owners or more than ``most_repositories`` repositories.
    Distinct pairs first, so a value that a third of all rows hold is pre-aggregated before it meets in one place.
    """
    by_owner = candidates.select("value_hash", "owner").distinct().groupBy("value_hash").agg(F.count("owner").alias("n_owners"))
    by_repo = candidates.select("value_hash", "repository").distinct().groupBy("value_hash").agg(F.count("repository").alias("n_repositories"))
    return by_owner.join(by_repo, "value_hash").withColumn("example", (F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories))


def found_spans(
    docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str | None, base: tuple[Kind, ...], extra: tuple[Kind, ...]
) -> DataFrame:
    """(id, key, owner, repository, base, more) for every row: the matches of both sets of kinds. Small: no texts."""
    col = lambda c: F.col(f"`{c}`")
    repository = F.xxhash64(col(id_col)) if repository_col is None else F.when(col(repository_col).isNotNull(), F.xxhash64(col(repository_col)))
    rows = docs.select(
        col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), text_key(col(text_col)).alias("key"), col(owner_col).cast("string").alias("owner"), repository.alias("repository")
    )
    found = {k.name: spans_of(F.col("text"), k, n) for n, k in enumerate((*base, *extra))}
    none = F.array().cast(f"array<{SPAN}>")
    rows = rows.select("id", "key", "owner", "repository", F.concat(none, *(found[k.name] for k in base)).alias("base"), F.concat(none, *(found[k.name] for k in extra)).alias("more"))
    spare = [n for n, k in enumerate((*base, *extra)) if k.spare]
    few = F.filter(without_covered(ordered(F.concat("base", "more")), spare), lambda x: x["kind"] >= len(base))
    named = F.transform(few, lambda x: F.struct(*(x[c] for c in ("kind", "name", "start", "end", "value")))).cast(f"array<{SPAN}>")
    rows = rows.withColumn("more", F.when(F.size("more") > 0, named).otherwise(none))
    return materialize(rows, "secret-spans")


def candidates(rows: DataFrame) -> DataFrame:
    """A row for each distinct candidate of ``found_spans``, with its value's hash."""
    one = rows.filter("size(base) + size(more) > 0").select("id", "key", "owner", "repository", F.explode(F.concat("base", "more")).alias("span"))
    return one.withColumn("value_hash", F.sha2(F.col("span.value"), 256)).distinct()


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str | None = None,
    base: tuple[Kind, ...] = BASE,
    extra: tuple[Kind, ...] = EXTRA,
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
    corpus: DataFrame | None = None,
) -> DataFrame:
    """(id, key, base, added, judged) for every row: arrays of spans. ``added`` holds the live ones of ``extra``; ``judged``
    all candidates of both sets with n_owners, n_repositories and live, in no order.

    A value is live if ``most_owners`` owners and ``most_repositories`` repositories at most hold it. They are counted over
    ``corpus``, a table with the same columns of which ``docs`` are a part (the default is ``docs`` itself): where copies
    have been left out of ``docs``, the table they came from tells a copied example from a value of one owner.
    A repository is a document unless ``repository_col`` names a column. Null text counts as empty. A null owner is no
    owner, a null repository no repository: neither makes a value an example. Rows that repeat an id are kept apart by their text;
    identical rows share their spans. Other columns are not read. An empty table gives none.
    """
    how = (id_col, text_col, owner_col, repository_col, base, extra)
    rows = found_spans(docs, *how)
    one = candidates(rows)
    counted = one if corpus is None else candidates(found_spans(corpus, *how))
    owned = ownership(counted, most_owners, most_repositories)
    if corpus is not None:  # only values that the rows hold
        owned = owned.join(one.select("value_hash").distinct(), "value_hash", "left_semi")
    owned = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one = one.withColumn("salt", F.pmod(F.col("key"), F.lit(SALTS)).cast("int"))
    verdict = F.struct("span.*", F.coalesce("n_owners", F.lit(0)).alias("n_owners"), F.coalesce("n_repositories", F.lit(0)).alias("n_repositories"), (~F.coalesce("example", F.lit(False))).alias("live"))
    judged = one.join(owned.hint("merge"), ["value_hash", "salt"], "left").groupBy(F.col("id").alias("id2"), F.col("key").alias("key2")).agg(F.collect_list(verdict).alias("judged"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
    plain = lambda x: F.struct(*(x[c] for c in ("kind", "name", "start", "end", "value")))
    added = F.transform(F.filter("judged", lambda x: x["live"] & (x["kind"] >= len(base))), plain).cast(f"array<{SPAN}>")
    out = rows.join(judged, same, "left").withColumn("judged", F.coalesce("judged", F.array().cast(judged.schema["judged"].dataType)))
    return out.select("id", "key", "base", added.alias("added"), "judged")


def digest(found: DataFrame, id_col: str, base: tuple[Kind, ...] = BASE) -> DataFrame:
    """Counts by base kind, digest of the base spans, all spans, and the candidates by verdict, of ``scan``'s rows."""

    def count(name: str) -> Column:
        return F.size(F.filter("base", lambda x: x["name"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(k.name) for k in base]
    return found.select(
        F.col("id").alias(id_col), *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
        F.size(F.filter("judged", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("judged", lambda x: ~x["live"])).cast("long").alias("n_examples"),
        F.array_max(F.transform("judged", lambda x: x["n_owners"])).alias("most_owners"), F.array_max(F.transform("judged", lambda x: x["n_repositories"])).alias("most_repositories"),
    )


def blanked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of what the sorted ``spans`` cover; overlapping ones become one.

    A substring counts code points from its text's start, so the text is first cut into about as many parts as each part
    has spans.
    """

    def cut(cuts: Column) -> Column:
        def block(b: Column) -> Column:
            lo, hi = F.get(b, F.lit(0))["a"], F.get(b, F.size(b) - 1)["b"]
            return let(F.struct(F.substring(text, lo + 1, hi - lo).alias("t"), lo.alias("lo")), lambda p: F.transform(b, lambda c: F.concat(F.substring(p["t"], c["a"] - p["lo"] + 1, c["b"] - c["a"]), F.lit(mark))))

        return F.flatten(F.transform(in_blocks(cuts, F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(cuts))).cast("int"))), block))

    def pieces(xs: Column, ends: Column) -> Column:
        """Places (a, b) of the text in front of each span that no earlier one reaches into, then the rest."""
        cuts = F.zip_with(xs, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), lambda x, before: F.struct(before.alias("a"), x["start"].alias("b")))
        cuts = F.filter(cuts, lambda c: c["b"] >= c["a"])
        return F.concat(F.array_join(let(cuts, cut), ""), F.substring(text, F.get(ends, F.size(ends) - 1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(spans, lambda xs: let(running(F.transform(xs, lambda x: x["end"]), F.greatest), lambda ends: pieces(xs, ends)))).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span's text replaced by ``mark``; overlapping spans become one. Columns stay; ``n_chars`` follows the text."""
    found = scan(docs, id_col, text_col, owner_col, **options).filter("size(base) + size(added) > 0")
    found = found.select(F.col("id").alias("_s_id"), F.col("key").alias("_s_key"), ordered(F.concat("base", "added")).alias("_s_spans")).dropDuplicates(["_s_id", "_s_key"])
    own = lambda c: F.col("_row").getField(c)
    text = own(text_col)
    out = boxed(docs).join(found, own(id_col).eqNullSafe(F.col("_s_id")) & (text_key(text) == F.col("_s_key")), "left")
    out = out.select("_row", "_s_spans", F.when(F.col("_s_spans").isNotNull(), blanked(text.cast("string"), F.col("_s_spans"), mark)).alias("_s_text"))
    new = {text_col: F.when(F.col("_s_spans").isNull(), text).otherwise(F.col("_s_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_s_spans").isNull(), own("n_chars")).otherwise(F.length("_s_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(new.get(c, own(c)).alias(c) for c in docs.columns))


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Base and owner-specific spans of every document."""
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id")
