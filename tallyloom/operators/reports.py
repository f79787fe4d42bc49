"""Reports of estimates and validations as text: small results, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import state_tokens
from tallyloom.operators.sampling import random_rows
from tallyloom.plans.questions import QuestionSet, call_groups, micro_usd_to_usd, require_fields, tokens_to_micro_usd

DOCS_A_SECOND = 250


@dataclass(frozen=True)
class GroupEstimate:
    projection_id: str
    fields: tuple[str, ...]
    n_questions: int
    state_tokens: float
    schema_tokens: int


@dataclass(frozen=True)
class Estimate:
    n_docs: int
    sample: int
    groups: tuple[GroupEstimate, ...]
    tokens: int
    micro_usd: int
    seconds: float


def estimate(docs: DataFrame, qs: QuestionSet, sample_size: int = 200, seed: int = 0) -> Estimate:
    """Tokens and price of a run from a sample of states; ``docs`` has ``doc_id`` and the fields."""
    groups = call_groups(qs)
    require_fields(groups, docs.columns)
    n = docs.count()
    sample = random_rows(docs, sample_size, seed)
    row = sample.agg(F.count(F.lit(1)).alias("n"), *(F.avg(state_tokens(g.fields)).alias(g.projection_id) for g in groups)).first()
    found = tuple(GroupEstimate(g.projection_id, g.fields, len(g.questions), row[g.projection_id] or 0.0, g.schema_tokens) for g in groups)
    tokens = round(sum(g.state_tokens + g.schema_tokens for g in found) * n) if n else 0
    return Estimate(n, row["n"], found, tokens, tokens_to_micro_usd(tokens), n / DOCS_A_SECOND)


def short_count(n: float) -> str:
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if n >= size:
            return f"{n / size:.1f}{unit}"
    return f"{n:.0f}"


def short_time(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.0f} s"
    return f"{seconds / 60:.0f} min" if seconds < 3600 else f"{seconds / 3600:.1f} h"


def table(rows: list[list[str]]) -> str:
    widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def estimate_text(e: Estimate) -> str:
    head = f"{e.n_docs:,} documents, {len(e.groups)} call(s) for each; state tokens averaged over {e.sample}"
    rows = [["fields", "questions", "state", "schema"], *([", ".join(g.fields), str(g.n_questions), f"{g.state_tokens:.0f}", str(g.schema_tokens)] for g in e.groups)]
    return f"{head}\n{table(rows)}\n{short_count(e.tokens)} tokens, ${micro_usd_to_usd(e.micro_usd):.4f}, about {short_time(e.seconds)}"


def validation_text(rows: list[dict], excluded_chunked: int = 0) -> str:
    """``rows``: the dicts of scored questions with verdicts."""
    pct = lambda x: "-" if x is None else f"{100 * x:.0f} %"
    num = lambda x: "-" if x is None else f"{x:.3f}"
    head = ["question", "type", "n", "accuracy", "95 %", "ece", "threshold", "coverage", "verdict"]
    body = [
        [r["question_id"], r["type"], str(r["n"]), num(r["accuracy"]), f"{num(r['lo'])}-{num(r['hi'])}", num(r["ece_confidence"] if r["ece_confidence"] is not None else r["ece_probability"]), "-" if r["threshold"] is None else f"> {r['threshold']:.2f}", pct(r["coverage"]), r["verdict"]]
        for r in sorted(rows, key=lambda r: r["question_id"])
    ]
    note = f"\n{excluded_chunked} answers from several chunks are left out" if excluded_chunked else ""
    return table([head, *body]) + note
