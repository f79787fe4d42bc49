"""Column functions: everything a plan computes in the row, JVM-side."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.plans.questions import PRICE, CallGroup

Z95 = 1.959963984540054


def one_space(text: Column) -> Column:
    """White space runs (Unicode, U+001C..1F too) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def text_tokens(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.ceil(F.length(text) / F.lit(float(chars_per_token))).cast("long")


def state_of(names: tuple[str, ...]) -> Column:
    """Struct of the fields a group sees, sorted."""
    return F.struct(*(F.col(f"`{n}`").alias(n) for n in sorted(names)))


def state_json(names: tuple[str, ...]) -> Column:
    return F.to_json(state_of(names), {"ignoreNullFields": "false"})


def state_tokens(names: tuple[str, ...], chars_per_token: float = 4.0) -> Column:
    """Tokens of the state's JSON with a space after each comma and colon (flat states)."""
    return F.ceil((F.length(state_json(names)) + F.lit(2 * len(names) - 1)) / F.lit(float(chars_per_token))).cast("long")


def micro_usd(tokens: Column) -> Column:
    return F.ceil(tokens * F.lit(PRICE).cast("double")).cast("long")


def stratum_label(value: Column, strata: int = 5) -> Column:
    width = 1.0 / strata
    k = F.least(F.floor(value / F.lit(width)).cast("int"), F.lit(strata - 1))
    return F.concat(F.format_string("%.1f", k * F.lit(width)), F.lit("-"), F.format_string("%.1f", (k + 1) * F.lit(width)))


def ten_bin(value: Column) -> Column:
    return F.greatest(F.least(F.floor(value * 10).cast("int"), F.lit(9)), F.lit(0))


def modal_level(probabilities: Column) -> Column:
    """Key of the highest probability, the first of equal ones."""
    entries = F.map_entries(probabilities)
    ranked = F.transform(entries, lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("late"), e["key"].alias("key")))
    return F.array_max(ranked)["key"]


def threshold_value(kind: Column, noul: Column, confidence: Column) -> Column:
    return F.when(kind == "noul", F.abs(noul - 0.5)).otherwise(confidence)


def is_unclear(gold: Column) -> Column:
    g = F.trim(F.coalesce(gold, F.lit("")))
    return (g == "") | (F.lower(g) == "unclear")


def is_correct(kind: Column, noul: Column, choice: Column, modal: Column, gold: Column) -> Column:
    g = F.trim(gold)
    return F.when(kind == "noul", (noul > 0.5) == (F.lower(g) == "true")).when(kind == "choice", choice == g).otherwise(modal == g)


def is_adjacent(modal: Column, gold: Column) -> Column:
    return F.abs(modal.try_cast("int") - F.trim(gold).try_cast("int")) <= 1


def kish(sum_w: Column, sum_w2: Column) -> Column:
    return F.when(sum_w2 > 0, sum_w * sum_w / sum_w2).otherwise(F.lit(0.0))


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval on an effective sample size; (0, 1) without one."""
    z2 = Z95 * Z95
    safe = F.when(n > 0, n)
    mid = (p + z2 / (2 * safe)) / (1 + z2 / safe)
    half = F.lit(Z95) * F.sqrt(p * (1 - p) / safe + z2 / (4 * safe * safe)) / (1 + z2 / safe)
    return F.coalesce(F.greatest(mid - half, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(mid + half, F.lit(1.0)), F.lit(1.0))


def text_value(noul: Column, choice: Column, score: Column) -> Column:
    return F.coalesce(noul.cast("string"), choice, score.cast("string"))


def context_batches(group: CallGroup, tokens: Column, context_limit: int, margin: float = 0.15) -> Column:
    """array<int>: for each question of the group the number of its batch, null if the state fits no call.

    The same greedy filling as ``split_for_context``, as a fold over the group's constant token counts.
    """
    limit = int(context_limit * (1 - margin))
    costs = F.array(*(F.lit(q.schema_tokens) for q in group.questions))
    start = F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, cost: Column) -> Column:
        fresh = (acc["k"] < 0) | (acc["used"] + cost > limit)
        k = F.when(fresh, acc["k"] + 1).otherwise(acc["k"])
        used = F.when(fresh, tokens + cost).otherwise(acc["used"] + cost)
        return F.struct(k.alias("k"), used.cast("long").alias("used"), F.array_append(acc["out"], k).alias("out"))

    fits = tokens + max(q.schema_tokens for q in group.questions) <= limit
    return F.when(fits, F.aggregate(costs, start, step, lambda acc: acc["out"]))


def legend_of(criteria: list) -> Column:
    pairs = []
    for k, v in enumerate(criteria):
        pairs += [F.lit(str(k)), F.lit(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))]
    return F.create_map(*pairs)
