"""Quality rules by weak supervision: rules vote or abstain, EM weighs the votes.

Every rule looks at one statistic of a text and says good, bad or nothing. The
votes of a document form a pattern; patterns are counted over the whole table
(at most 3 ** rules of them, however many rows), and expectation-maximisation
over those counts estimates each rule's accuracy on good and on bad documents.
The posterior probability of "good" replaces all-must-pass filtering: a rule
that good documents often fail (many capitals, narrow lines) weighs little, and
one bad vote of it does not cost a document its place.

The two classes are told apart by agreement alone, so each kind of junk should
make two rules or more vote bad; a kind that a single rule sees would be taken
for that rule's errors. No accuracy is bounded.

Everything on the rows is built-in expressions without an exchange; only the
pattern counts are aggregated. The statistics of a text are computed inside its
row, so a long text needs memory in proportion to itself and nothing is dealt.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import boxed, materialize, words_of

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_symbol_words", "n_letterless", "n_ended", "n_distinct", "n_capitalised")
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_AT = 50, 50, 0.5
#: Pseudo-votes of EM as a part of the rows: right 9 times of 10 on good documents, 5 of 10 on bad ones, 8 of 10 documents good.
PRIOR_WEIGHT, GOOD_RIGHT, BAD_RIGHT, GOOD_SHARE = 1e-3, 0.9, 0.5, 0.8


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions on the statistics; neither holds: the rule abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "n_symbols > 0.05 * word_chars", "n_symbols <= 0.005 * word_chars"),
    Rule("symbol_words", "n_symbol_words > 0.2 * n_words", "n_symbol_words <= 0.02 * n_words"),
    Rule("letterless", "n_letterless > 0.2 * n_words", "n_letterless <= 0.05 * n_words"),
    Rule("line_ends", "n_ended < 0.9 * n_lines", "n_ended >= n_lines"),
    Rule("capitals", "n_upper > 0.3 * word_chars", "n_upper <= 0.1 * word_chars"),
    Rule("capitalised", "n_capitalised > 0.12 * n_words", "n_capitalised <= 0.09 * n_words"),
    Rule("marks", "n_marks > 0.3 * n_words", "n_marks <= 0.05 * n_words"),
    Rule("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    Rule("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    Rule("variety", "n_distinct < 0.4 * n_words", "n_distinct >= 0.6 * n_words"),
    Rule("word_length", "word_chars > 6.5 * n_words or word_chars < 3 * n_words", "word_chars <= 6 * n_words and word_chars >= 3.5 * n_words"),
    Rule("line_width", "n_words < 16 * n_lines", "n_words >= 24 * n_lines"),
)


BLANK = r"\x20\x09-\x0D"


def with_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """(_row, stats): the rows of ``docs`` as structs, and their statistics."""
    name = F.col
    # Each step's columns are used twice or more, so no step is inlined into a later lambda.
    df = boxed(docs).withColumn("t", F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit("")))
    df = df.withColumns({"w": words_of(name("t")), "l": F.filter(F.split(name("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w = name("w")
    tri = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("h", tri)
    h = name("h")
    placed = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
    df = df.withColumn("s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
    s = name("s")
    # Neighbours of equal hash: both their windows occur twice or more.
    twice = F.flatten(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    df = df.withColumn("p", F.sort_array(F.array_distinct(twice)))
    p = name("p")
    covered = F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda x, y: x + y)
    stats = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(name("t"), F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(name("l")) - F.size(F.array_distinct(name("l"))),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size(name("l")),
        "n_upper": F.regexp_count(name("t"), F.lit(r"\p{Lu}")),
        "n_marks": F.regexp_count(name("t"), F.lit(r"[!?]")),
        # Every pattern passes over a word or a line's end once, however long.
        "n_symbol_words": F.regexp_count(name("t"), F.lit(rf"[#*$%&|<>][^{BLANK}]*+")),
        "n_letterless": F.regexp_count(name("t"), F.lit(rf"(?<![^{BLANK}])[^\p{{L}}{BLANK}]++(?![^{BLANK}])")),
        "n_ended": F.regexp_count(name("t"), F.lit(r"[.!?:;\u2026][\"'\u201d\u2019\u00bb)]*+[\x20\x09\x0B-\x0D]*+(?:\n|\z)")),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_capitalised": F.regexp_count(name("t"), F.lit(rf"(?<![^{BLANK}])\p{{Lu}}")),
    }
    # A generated column: rules that read it don't evaluate its expressions again, each for itself.
    return df.select("_row", F.explode(F.array(F.struct(*(v.cast("long").alias(k) for k, v in stats.items())))).alias("stats"))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def votes(stats: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """A string with a letter for each rule: b, g, or - where it abstains."""
    import re

    def bind(sql: str) -> Column:
        return F.expr(re.sub(rf"\b({'|'.join(STATS)})\b", rf"{stats}.\1", sql))

    return F.concat(*(F.when(bind(r.bad), "b").when(bind(r.good), "g").otherwise("-") for r in rules))


@dataclass(frozen=True)
class VoteModel:
    """P(good), and for each rule its accuracies: P(says good | good) and P(says bad | bad), where it votes.

    Abstaining says nothing. ``converged`` is whether EM came to rest within its rounds.
    """

    good: float
    accuracies: tuple[tuple[float, float], ...]
    rounds: int = 0
    converged: bool = True

    def weights(self) -> list[dict[str, float]]:
        return [{"g": log(a / (1 - b)), "b": log((1 - a) / b), "-": 0.0} for a, b in self.accuracies]

    def log_odds(self, pattern: str) -> float:
        return log(self.good / (1 - self.good)) + sum(w[v] for v, w in zip(pattern, self.weights(), strict=True))

    def posterior(self, pattern: str) -> float:
        return 1 / (1 + exp(-max(-700.0, min(700.0, self.log_odds(pattern)))))

    def column(self, pattern: Column) -> Column:
        """The same posterior as an expression on a pattern column."""
        total = F.lit(log(self.good / (1 - self.good)))
        for k, w in enumerate(self.weights()):
            at = F.substring(pattern, k + 1, 1)
            total = total + F.when(at == "g", w["g"]).when(at == "b", w["b"]).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_votes(counts: dict[str, int], n_rules: int, rounds: int = 1000) -> VoteModel:
    """EM over pattern counts, from each pattern's share of good votes; an empty table gives the prior.

    Pseudo-votes (a thousandth of the rows, one at least) keep every probability off 0 and 1.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    said = np.array([list(p) for p in patterns], "U1").reshape(len(patterns), n_rules)
    g, b = (said == "g").astype(float), (said == "b").astype(float)
    weight = max(1.0, PRIOR_WEIGHT * n.sum())
    now = np.clip((g.sum(1) + 1e-9) / (g.sum(1) + b.sum(1) + 2e-9), 0.05, 0.95)
    converged = False
    for k in range(1, rounds + 1):
        on_good, on_bad = n * now, n * (1 - now)
        prior = (on_good.sum() + 10 * GOOD_SHARE * weight) / (n.sum() + 10 * weight)
        right = (on_good @ g + GOOD_RIGHT * weight) / (on_good @ (g + b) + weight)
        caught = (on_bad @ b + BAD_RIGHT * weight) / (on_bad @ (g + b) + weight)
        odds = np.log(prior / (1 - prior)) + g @ np.log(right / (1 - caught)) + b @ np.log((1 - right) / caught)
        after = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved = np.abs(after - now).max(initial=0.0)
        now = after
        if moved < 1e-10:
            converged = True
            break
    if not converged:
        warnings.warn(f"EM still moved by {moved:.1e} after {rounds} rounds", stacklevel=2)
    return VoteModel(float(prior), tuple(zip(right.tolist(), caught.tolist())), k, converged)


def fit(rows: DataFrame, pattern_col: str, rules: tuple[Rule, ...] = RULES) -> VoteModel:
    """Model of the vote patterns of ``rows``; 3 ** len(rules) rows reach the driver at most."""
    counts = {r[0]: r[1] for r in rows.groupBy(pattern_col).count().collect()}
    return fit_votes(counts, len(rules))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col, statistics, base_failed, votes, quality (posterior) and kept for every row.

    A null text counts as empty (no words: base_failed). Null ids and repeated
    rows keep their rows; other columns are not read. An empty table gives none.
    """
    rows = with_stats(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text")
    rows = materialize(rows.select(F.col("_row.id").alias("id"), "stats", votes("stats", rules).alias("votes")), "quality-votes")
    model = fit(rows, "votes", rules)
    quality = model.column(F.col("votes"))
    return rows.select(
        F.col("id").alias(id_col),
        *(F.col(f"stats.{s}").alias(s) for s in STATS),
        base_failed(F.col("stats")).alias("base_failed"),
        "votes",
        quality.alias("quality"),
        (~base_failed(F.col("stats")) & (quality >= KEEP_AT)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    No exchange: rows that the base rules keep are written with their votes, which the fit and the verdict read again;
    rows that fail them leave only their votes.
    """
    rows = with_stats(docs, text_col).select("_row", base_failed(F.col("stats")).alias("failed"), votes("stats", rules).alias("votes"))
    rows = materialize(rows.select(F.when(~F.col("failed"), F.col("_row")).alias("_row"), "failed", "votes"), "voted-documents")
    model = fit(rows, "votes", rules)
    return rows.filter(~F.col("failed") & (model.column(F.col("votes")) >= KEEP_AT)).select("_row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics, base verdict and the vote model's verdict for every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
