"""Long states as overlapping chunks, and the chunks' answers as one."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.questions import CONTEXT_LIMIT, MARGIN, CallGroup, ContextOverflow, estimate_tokens

SPARE, OVERLAP = 64, 0.1
CHUNKS = "doc_id string, row_index bigint, chunk_index int, chunk_count int, state string, error string"
#: Characters of chunks that go back to the JVM at once.
OUT_CHARS = 4_000_000


def chunk_state(state: dict, group: CallGroup, context_limit: int = CONTEXT_LIMIT, margin: float = MARGIN, overlap: float = OVERLAP) -> list[dict]:
    """States that fit a call. The largest field is cut, with an overlap; no character of it is left out.

    A slice that JSON escapes make too long is shortened, and the next one starts before the shortened end.
    """
    limit = int(context_limit * (1 - margin))
    most = max(q.schema_tokens for q in group.questions)
    if estimate_tokens(state) + most <= limit:
        return [state]
    name = max(sorted(state), key=lambda k: estimate_tokens(state[k]) if state[k] is not None else 0)
    text = state[name]
    if not isinstance(text, str):
        raise ContextOverflow(f"{name} is not text and cannot be cut")
    room = limit - most - SPARE

    def fits(part: str) -> bool:
        return estimate_tokens(state | {name: part}) <= room

    if not fits(text[:1]):
        raise ContextOverflow("the other fields leave no room")
    width = max(1, 4 * (room - estimate_tokens(state | {name: ""})))
    out, at = [], 0
    while at < len(text):
        size = min(width, len(text) - at)
        while size > 1 and not fits(text[at : at + size]):
            size = max(1, int(size * 0.9))
        out.append(state | {name: text[at : at + size]})
        if at + size >= len(text):
            break
        at += max(1, size - int(size * overlap))
    return out


def fixed_chunks(text: Column, width: int, stride: int) -> Column:
    """array<struct<chunk_index, start, chunk>>: windows of ``width`` at every ``stride``, the last one at the end."""
    n = F.length(text)
    last = F.greatest(F.ceil((n - width) / F.lit(float(stride))).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk_index"), (k * stride).alias("start"), F.substring(text, k * stride + 1, F.lit(width)).alias("chunk")))


def cut_batches(batches: Iterator, group: CallGroup, context_limit: int, margin: float, most: int = OUT_CHARS) -> Iterator:
    """Arrow batches of ``CHUNKS`` from those of (doc_id, row_index, state json).

    A batch goes out as soon as its states have ``most`` characters, so a task holds what it was sent, one row's chunks
    and that much besides, however many rows are over the limit.
    """
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
    names = [x.split(" ")[0] for x in CHUNKS.split(", ")]
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    def pieces(doc_id: str, row_index: int, state: str) -> Iterator[tuple]:
        try:
            parts = chunk_state(json.loads(state), group, context_limit, margin)
        except ContextOverflow as e:
            yield doc_id, row_index, 0, 0, state, f"state_exceeds_context: {e}"
            return
        for k, part in enumerate(parts):
            yield doc_id, row_index, k, len(parts), json.dumps(part, ensure_ascii=False), None

    for batch in batches:
        for at in range(batch.num_rows):
            for row in pieces(*(batch.column(k)[at].as_py() for k in range(3))):
                rows.append(row)
                held += len(row[4])
                if held >= most:
                    yield out()
                    rows, held = [], 0
        del batch  # else it stays until the next one is read
    if rows:
        yield out()


def chunked(states: DataFrame, group: CallGroup, context_limit: int = CONTEXT_LIMIT, margin: float = MARGIN) -> DataFrame:
    """(doc_id, row_index, chunk_index, chunk_count, state json, error) of ``states(doc_id, row_index, state json, tokens)``.

    Only rows over the limit go to Python.
    """
    limit = int(context_limit * (1 - margin)) - max(q.schema_tokens for q in group.questions)
    fits = states.filter(F.col("tokens") <= limit).select("doc_id", "row_index", F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count"), "state", F.lit(None).cast("string").alias("error"))
    long = states.filter(F.col("tokens") > limit).select("doc_id", "row_index", "state")
    return fits.unionByName(long.mapInArrow(lambda batches: cut_batches(batches, group, context_limit, margin), CHUNKS))


def aggregate_chunks(answers: DataFrame, noul_mode: str = "max", keys: tuple[str, ...] = ("doc_id", "question_id")) -> DataFrame:
    """One answer per key of ``answers(*keys, type, noul, score, probabilities, legend)``; ``chunk_count`` rows each.

    noul: the maximum or the mean. choice and score: the mean distribution over all keys (missing ones count 0), in key
    order; the choice is its mode, the score the mean of scores. Confidence is derived.
    """
    base = answers.groupBy(*keys).agg(
        F.first("type").alias("type"), F.count(F.lit(1)).cast("int").alias("chunk_count"), (F.max("noul") if noul_mode == "max" else F.avg("noul")).alias("noul"), F.avg("score").alias("score"), F.first("legend", True).alias("legend")
    )
    each = answers.filter("probabilities is not null").select(*keys, F.explode("probabilities").alias("k", "p")).groupBy(*keys, "k").agg(F.sum("p").alias("p"))
    dist = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("dist"))
    joined = base.join(dist, list(keys), "left")
    means = F.transform("dist", lambda e: F.struct(e["k"].alias("key"), (e["p"] / F.col("chunk_count")).alias("value")))
    joined = joined.withColumn("means", means).withColumn("top", F.array_max(F.transform("means", lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("late"), e["key"].alias("k")))))
    is_choice = F.col("type") == "choice"
    return joined.select(
        *keys, "type", "chunk_count", "noul", F.when(is_choice, F.col("top.k")).alias("choice"), F.when(F.col("type") == "score", F.col("score")).alias("score"), F.map_from_entries("means").alias("probabilities"), "legend",
        F.when(F.col("type") == "noul", F.abs(F.col("noul") - 0.5) * 2).otherwise(F.col("top.p")).alias("confidence"), F.lit("derived").alias("confidence_source"),
    )
