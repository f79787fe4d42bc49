"""Runs: a corpus and a question set become cells, within a budget, resumable, each question paid once.

A run is planned once and then goes in waves. The plan projects each call group,
cuts long states, looks every question up in the cache and writes the keys (not
the texts) in document order; of documents with one state the first one asks for
all. A wave is a range of documents: it is admitted by the budget, asked, charged
and committed before the next one starts, and documents are never split between
commits. What a task has paid for is in the cache as soon as the task ends, so a
run that dies loses no more than the calls under way; a resumed one finds the
rest. All files are read and written through Spark, wherever they are.
"""

from __future__ import annotations

import datetime
import signal
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import context_batches, micro_usd, state_json, state_of, state_tokens
from tallyloom.functions.schemas import schema
from tallyloom.operators.answering import NOT_ASKED, AnswerError, BatchAnswerer, ColumnAnswerer, Failure
from tallyloom.operators.chunking import aggregate_chunks, chunked
from tallyloom.plans.questions import CONTEXT_LIMIT, MARGIN, CallGroup, ConfigError, QuestionSet, call_groups, diff, micro_usd_to_usd, require_fields, tokens_to_micro_usd, usd_to_micro_usd
from tallyloom.sources import corpus, files


def remaining(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents without finished cells."""
    return docs.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def cache_key(state: Column, question_id: Column, body_hash: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", state, question_id, body_hash, model), 256)


def with_hits(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted(cache_key, ...)`` with ``hit``: whether the cache has the key."""
    known = cache.select("cache_key").distinct().withColumn("hit", F.lit(True))
    return wanted.join(known, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hits_and_misses(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``wanted(cache_key, ...)`` split by the cache, which is looked up once."""
    marked = with_hits(wanted, cache)
    return marked.filter("hit").drop("hit"), marked.filter("not hit").drop("hit")


#: Rows of a range whose running sums are taken in one task, and the fewest and most ranges.
RANGE_ROWS, RANGES = 500_000, (64, 4096)


def with_sums_before(rows: DataFrame, value: str, order: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each one, by ``order`` (a number or a struct that begins with one).

    Rows are cut into ranges by quantiles of the order; each range's sums are taken in a task of its own, on top of the
    ranges' totals. As many ranges as the rows need. Rows of equal order count in the order of ``ties``.
    """
    kind = rows.schema[order].dataType
    lead = F.col(f"{order}.{kind.fields[0].name}") if isinstance(kind, T.StructType) else F.col(order)
    n = min(RANGES[1], max(RANGES[0], rows.count() // RANGE_ROWS))
    bounds = sorted(set(rows.select(F.percentile_approx(lead, [k / n for k in range(1, n)], 10_000).alias("q")).first()["q"] or []))
    at = F.array(*(F.lit(b) for b in bounds)) if bounds else F.array().cast("array<bigint>")
    ranged = rows.withColumn("_part", F.size(F.filter(at, lambda b: b <= lead)))
    inside = Window.partitionBy("_part").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))  # a row for each range
    base = totals.select("_part", (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_base"))
    return ranged.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_before")).drop("_part", "_base", "_before")


def admitted(calls: DataFrame, budget_usd: float, spent_tokens: int = 0, order: str = "row_index") -> DataFrame:
    """Rows of ``calls(row_index, estimated, actual)`` before the first one that the budget refuses, with ``spent_before``.

    A call is refused if what was spent before it and its estimate exceed the budget.
    """
    budget = usd_to_micro_usd(budget_usd)
    priced = with_sums_before(calls, "actual", order, "spent_before").withColumn("spent_before", F.col("spent_before") + spent_tokens)
    breach = micro_usd(F.col("spent_before")) + micro_usd(F.col("estimated")) > budget
    first = priced.filter(breach).agg(F.min(order).alias("_stop"))
    return priced.crossJoin(F.broadcast(first)).filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def cells_of(docs: DataFrame, qs: QuestionSet, answerer: ColumnAnswerer, run_id: str = "run", ts: datetime.datetime | None = None) -> DataFrame:
    """Cells of every document by an expression answerer: one scan, one explode for each call group."""
    out = None
    for g in call_groups(qs):
        n = len(g.questions)
        tokens = answerer.call_tokens(n, state_tokens(g.fields))
        doc_id = F.col("doc_id").cast("string")
        rows = [
            F.struct(F.lit(q.id).alias("question_id"), F.lit(q.type).alias("type"), answerer.answer(doc_id, state_of(g.fields), q).alias("a"), F.lit(qs.gate(q)).alias("gate"), F.lit(q.body_hash).alias("question_body_hash"))
            for q in g.questions
        ]
        one = docs.select(doc_id.alias("doc_id"), tokens.alias("input_tokens"), F.explode(F.array(*rows)).alias("c"))
        part = one.select(
            "doc_id", "c.question_id", "c.type", "c.a.noul", "c.a.choice", "c.a.score", "c.a.probabilities", "c.a.legend", "c.a.confidence", "c.a.confidence_source", "c.gate", F.lit(1).alias("chunk_count"),
            F.lit(g.projection_id).alias("projection_id"), F.substring(F.sha2(F.concat("doc_id", F.lit("|" + g.projection_id)), 256), 1, 16).alias("call_id"), F.lit(run_id).alias("run_id"), F.lit(answerer.model).alias("model"),
            F.lit(qs.hash).alias("questionset_hash"), "c.question_body_hash", "input_tokens", F.lit(ts or datetime.datetime(1970, 1, 1)).cast("timestamp").alias("ts"),
        )
        out = part if out is None else out.unionByName(part)
    return out.select(*corpus.CELL_COLUMNS)


@dataclass
class RunResult:
    run_dir: str
    processed: int
    already_done: int
    skipped: int
    quarantined: int
    cache_hits: int
    cache_misses: int
    tokens_charged: int
    exhausted: bool
    calibration: float | None
    interrupted: bool = False

    @property
    def cells_path(self) -> str:
        return f"{self.run_dir}/cells"

    @property
    def run_id(self) -> str:
        return self.run_dir.rpartition("/")[2]


@dataclass(frozen=True)
class Progress:
    """What a run has done so far; given out after every wave."""

    total: int
    done: int
    processed: int
    hits: int
    misses: int
    spent_micro_usd: int
    budget_micro_usd: int
    seconds: float
    wave: int
    waves: int
    stopping: bool = False

    def line(self) -> str:
        pace = self.processed / self.seconds if self.seconds > 0 else 0.0
        looked = self.hits + self.misses
        left = f"{(self.total - self.done) / pace:.0f} s left" if pace and self.total > self.done else "time left unknown" if not pace else "nothing left"
        share = f"{100 * self.hits / looked:.0f} % cached" if looked else "nothing looked up"
        spent, budget = micro_usd_to_usd(self.spent_micro_usd), micro_usd_to_usd(self.budget_micro_usd)
        return f"wave {self.wave} of {self.waves}: {self.done:,} of {self.total:,} documents, ${spent:.4f} of ${budget:.2f}, {pace:.1f} documents/s, {share}, {left}" + ", stopping" * self.stopping


class Drain:
    """While entered, the first interrupt asks the run to stop after its wave, and a second one stops at once."""

    def __init__(self) -> None:
        self.asked, self.before = threading.Event(), None

    def __enter__(self) -> Drain:
        if threading.current_thread() is threading.main_thread():
            self.before = signal.signal(signal.SIGINT, self._on)
        return self

    def _on(self, *_) -> None:
        if self.asked.is_set():
            raise KeyboardInterrupt
        self.asked.set()

    def __exit__(self, *exc) -> None:
        if self.before is not None:
            signal.signal(signal.SIGINT, self.before)


def open_run(root: str, qs: QuestionSet, source: str, id_field: str | None, resume: str | None, run_id: str | None = None) -> str:
    """Folder of a new run, or of the one to resume, if it asks the same questions."""
    now = {q.id: q.body_hash for q in qs.questions}
    if resume:
        manifest = files.read_json(f"{root}/{resume}/manifest.json")
        if manifest is None:
            raise ConfigError([f"no run {resume}"])
        if manifest["questionset_hash"] != qs.hash:
            d = diff(manifest["questions"], now)
            raise ConfigError([f"the question set changed: added {d.added}, removed {d.removed}, changed {d.changed}"])
        return f"{root}/{resume}"
    run_id = run_id or uuid.uuid4().hex[:12]
    groups = {g.projection_id: list(g.fields) for g in call_groups(qs)}
    files.write_json(f"{root}/{run_id}/manifest.json", {"run_id": run_id, "questionset_hash": qs.hash, "questions": now, "input_path": source, "id_field": id_field, "projection_groups": groups, "created_at": datetime.datetime.now(datetime.UTC).isoformat()})
    return f"{root}/{run_id}"


def charged_tokens(spark, root: str, run_id: str | None = None) -> int:
    """What the calls of a run, or of all runs of a root, were charged."""
    own = _stored(spark, f"{root}/cache", CACHE)
    own = own if run_id is None else own.filter(F.col("run") == run_id)
    return own.dropDuplicates(["run", "wave", "call_id"]).agg(F.sum("input_tokens")).first()[0] or 0


def _stored(spark, path: str, kind: T.StructType) -> DataFrame:
    return spark.read.schema(kind).parquet(path) if files.has_rows(path) else spark.createDataFrame([], kind)


ANSWER_FIELDS = "noul double, choice string, score double, probabilities map<string,double>, legend map<string,string>, confidence double, confidence_source string"
#: What every answer that was paid for leaves; ``cache_key`` is null for a call without answers. ``run`` and ``wave`` are folders.
CACHE = schema(f"cache_key string, question_id string, {ANSWER_FIELDS}, model string, call_id string, doc_id string, input_tokens bigint, error string, run string, wave string")
QUARANTINE = schema("row_index bigint, doc_id string, reason string, raw string")
AT = ["doc_id", "row_index", "projection_id", "chunk_index"]
#: Answers to ask for in a wave, and calls of a task: what is under way when a run dies, and what a budget can be overshot by.
WAVE_CELLS, TASK_CALLS = 200_000, 500


class Plan:
    """What a run has to do, written to its folder: states once, and a row without text for each question of each state."""

    def __init__(self, spark, todo: DataFrame, groups: list[CallGroup], qs: QuestionSet, model: str, cache: DataFrame, folder: str, wave_cells: int, context_limit: int, margin: float) -> None:
        states = None
        for g in groups:
            s = todo.select(F.col("doc_id").cast("string").alias("doc_id"), "row_index", state_json(g.fields).alias("state"), state_tokens(g.fields).alias("tokens"))
            s = chunked(s, g, context_limit, margin).withColumn("projection_id", F.lit(g.projection_id))
            states = s if states is None else states.unionByName(s)
        states.withColumn("digest", F.sha2("state", 256)).write.parquet(f"{folder}/states")
        self.states = spark.read.schema(schema("doc_id string, row_index bigint, chunk_index int, chunk_count int, state string, error string, projection_id string, digest string")).parquet(f"{folder}/states")
        wanted = None
        for g in groups:
            tokens = F.ceil(F.length("state") / 4.0).cast("bigint")
            about = F.array(*(F.struct(F.lit(q.id).alias("question_id"), F.lit(q.type).alias("type"), F.lit(q.body_hash).alias("body_hash"), F.lit(qs.gate(q)).alias("gate"), F.lit(q.schema_tokens).alias("schema_tokens")) for q in g.questions))
            w = self.states.filter((F.col("projection_id") == g.projection_id) & F.col("error").isNull())
            each = F.explode(F.arrays_zip(about.alias("q"), F.coalesce(context_batches(g, tokens, context_limit, margin), F.array_repeat(F.lit(0), len(g.questions))).alias("batch")))
            w = w.select(*AT, "chunk_count", "digest", tokens.alias("tokens"), each.alias("x")).select(*AT, "chunk_count", "digest", "tokens", "x.batch", "x.q.*")
            wanted = w if wanted is None else wanted.unionByName(w)
        wanted = wanted.withColumn("cache_key", cache_key(F.col("digest"), F.col("question_id"), F.col("body_hash"), F.lit(model)))
        kept = cache.filter("cache_key is not null").select("cache_key", F.struct(*CACHE.fieldNames()[2:10], "input_tokens").alias("cached")).dropDuplicates(["cache_key"])
        wanted = wanted.join(kept, "cache_key", "left")
        # Of the states that need one answer, the first one asks for it.
        place = F.struct("row_index", "projection_id", "chunk_index")
        first = wanted.filter("cached is null").groupBy("cache_key").agg(F.min(place).alias("first"))
        wanted = wanted.join(first, "cache_key", "left").withColumn("asks", F.coalesce(F.col("first") == place, F.lit(False))).drop("first")
        wanted.repartitionByRange("row_index").sortWithinPartitions("row_index").write.parquet(f"{folder}/wanted")
        self.wanted = spark.read.parquet(f"{folder}/wanted")
        docs = self.wanted.groupBy("row_index").agg(F.sum(F.col("asks").cast("bigint")).alias("n"))
        sums = with_sums_before(docs, "n", "row_index", "before")
        # The first wave is a tenth of the others: it tells what calls are charged.
        lead = max(1, wave_cells // 10)
        wave = F.when(F.col("before") < lead, 0).otherwise(1 + F.floor((F.col("before") - lead) / wave_cells))
        self.bounds = [r["low"] for r in sums.groupBy(wave.alias("wave")).agg(F.min("row_index").alias("low")).orderBy("low").collect()]

    def rows(self, table: DataFrame, k: int) -> DataFrame:
        """The documents of wave ``k``: a range of row numbers, which files' statistics know."""
        own = table.filter(F.col("row_index") >= self.bounds[k])
        return own.filter(F.col("row_index") < self.bounds[k + 1]) if k + 1 < len(self.bounds) else own


def _ask(calls: DataFrame, states: DataFrame, groups: list[CallGroup], answerer: ColumnAnswerer | BatchAnswerer, n_calls: int) -> DataFrame:
    """(doc_id, projection_id, chunk_index, batch, call_id, model, input_tokens, errors, answers) of ``calls``."""
    both = calls.join(states.select("doc_id", "projection_id", "chunk_index", "state"), ["doc_id", "projection_id", "chunk_index"])
    out = None
    for g in groups:
        mine = both.filter(F.col("projection_id") == g.projection_id)
        if isinstance(answerer, BatchAnswerer):
            got = answerer.run(mine.repartition(max(1, -(-n_calls // TASK_CALLS))), g)
        else:
            state = F.from_json("state", ", ".join(f"`{n}` string" for n in g.fields))
            each = F.array(*(F.struct(F.lit(q.id).alias("question_id"), answerer.answer(F.col("doc_id"), F.col("parsed"), q).alias("a")) for q in g.questions))
            flat = F.transform(F.filter(each, lambda x: F.array_contains("asked", x["question_id"])), lambda x: F.struct(x["question_id"].alias("question_id"), *(x["a"][f.split(" ")[0]].alias(f.split(" ")[0]) for f in ANSWER_FIELDS.split(", "))))
            call_id = F.substring(F.sha2(F.concat_ws("|", "doc_id", "projection_id", F.col("chunk_index").cast("string"), F.col("batch").cast("string")), 256), 1, 16)
            got = mine.withColumn("parsed", state).select("doc_id", "projection_id", "chunk_index", "batch", call_id.alias("call_id"), F.lit(answerer.model).alias("model"), F.col("expected").alias("input_tokens"), F.array().cast("array<string>").alias("errors"), flat.alias("answers"))
        got = got.select("doc_id", "projection_id", "chunk_index", "batch", "call_id", "model", "input_tokens", "errors", "answers")
        out = got if out is None else out.unionByName(got)
    return out


def _cells(rows: DataFrame, answers: DataFrame, broken: DataFrame, run_id: str, qs: QuestionSet) -> DataFrame:
    """Cells of the wave's documents that have all their answers."""
    fresh = answers.filter("cache_key is not null").select("cache_key", F.struct(*CACHE.fieldNames()[2:10], "input_tokens").alias("fresh"), F.col("call_id").alias("paid"), F.col("doc_id").alias("payer")).dropDuplicates(["cache_key"])
    full = rows.join(fresh, "cache_key", "left").withColumn("got", F.coalesce("cached", "fresh"))
    whole = full.groupBy("doc_id").agg(F.bool_and(F.col("got").isNotNull()).alias("ok")).filter("ok").select("doc_id")
    ready = full.join(whole, "doc_id", "left_semi").join(broken, "doc_id", "left_anti")
    ready = ready.select("doc_id", "question_id", "type", "gate", "body_hash", "projection_id", "chunk_count", "asks", F.when(F.col("asks") & (F.col("payer") == F.col("doc_id")), F.col("paid")).alias("call"), "got.*")
    one = ready.filter("chunk_count = 1").select("doc_id", "question_id", "type", "chunk_count", "noul", "choice", "score", "probabilities", "legend", "confidence", "confidence_source")
    many = aggregate_chunks(ready.filter("chunk_count > 1")).select(*one.columns)
    about = ready.groupBy("doc_id", "question_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.first("model").alias("model"), F.first("gate").alias("gate"), F.first("body_hash").alias("question_body_hash"), F.first("projection_id").alias("projection_id"),
        F.coalesce(F.min("call"), F.lit("cached")).alias("call_id"),
    )
    return one.unionByName(many).join(about, ["doc_id", "question_id"]).withColumns({"run_id": F.lit(run_id), "questionset_hash": F.lit(qs.hash), "ts": F.current_timestamp(), "chunk_count": F.col("chunk_count").cast("int")})


def run(
    spark, source: str, qs: QuestionSet, answerer: ColumnAnswerer | BatchAnswerer, root: str, budget_usd: float = 1.0, limit: int | None = None, id_field: str | None = None, resume: str | None = None,
    context_limit: int = CONTEXT_LIMIT, margin: float = MARGIN, wave_cells: int = WAVE_CELLS, on_progress: Callable[[Progress], None] | None = None, run_id: str | None = None,
) -> RunResult:
    """Answer every document's questions once, as far as the budget goes, and commit their cells wave by wave.

    Tokens are charged as soon as a call is made, whether its answers decode or not; a document with a failed call yields no
    cells but what it paid for stays cached. The budget counts what was charged, over all sessions of a run; inside a
    wave it counts estimates, scaled by what earlier waves were charged, so a wave can overshoot by its own error alone.
    A commit is a rename of a folder of whole documents. An interrupt lets the wave end and leaves the rest for a resume;
    a fatal failure does so, too, and is raised.
    """
    started = time.monotonic()
    df = corpus.read_source(spark, source)
    groups = call_groups(qs)
    require_fields(groups, df.columns)
    run_dir = open_run(root, qs, source, id_field, resume, run_id)
    run_id = run_dir.rpartition("/")[2]
    docs, bad = corpus.normalize(df, id_field)
    if limit is not None:
        docs = corpus.first_documents(docs, limit)
    cells_path, cache_path, quarantine, work = f"{run_dir}/cells", f"{root}/cache", f"{run_dir}/quarantine", f"{run_dir}/work"
    files.remove(work)
    done = _stored(spark, cells_path, corpus.CELL_SCHEMA).select("doc_id").distinct()
    refused = _stored(spark, quarantine, QUARANTINE)
    n_docs = docs.count()
    already = done.join(docs.select("doc_id"), "doc_id", "left_semi").count()
    cache = _stored(spark, cache_path, CACHE)
    charged = charged_tokens(spark, root, run_id)
    budget, at_start = usd_to_micro_usd(budget_usd), charged
    plan = Plan(spark, remaining(remaining(docs, done), refused), groups, qs, answerer.model, cache, work, wave_cells, context_limit, margin)
    broken = plan.states.filter("error is not null").select("doc_id").distinct()
    counts = plan.wanted.agg(F.count(F.lit(1)), F.sum(F.col("asks").cast("bigint")), F.sum((F.col("cached").isNull() & ~F.col("asks")).cast("bigint"))).first()
    n_misses = counts[1] or 0
    progress = Progress(n_docs, already, 0, counts[0] - n_misses, n_misses, tokens_to_micro_usd(charged), budget, 0.0, 0, len(plan.bounds))
    estimated = skipped = processed = 0
    exhausted = interrupted = False
    fatal = None
    with Drain() as drain:
        for k in range(len(plan.bounds)):
            if drain.asked.is_set():
                interrupted = True
                break
            rows, name = plan.rows(plan.wanted, k), f"{k:05d}-{uuid.uuid4().hex[:8]}"
            calls = rows.filter("asks").groupBy(*AT, "batch").agg(F.first("tokens").alias("tokens"), F.sum("schema_tokens").alias("schema"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("question_id")).alias("asked"))
            calls = calls.withColumn("estimated", (F.col("tokens") + F.col("schema")).cast("bigint"))
            scale = max(1.0, (charged - at_start) / estimated) if estimated else 1.0
            expected = F.ceil(F.col("estimated") * scale) if isinstance(answerer, BatchAnswerer) else answerer.call_tokens(F.col("n"), F.col("tokens"))
            calls = calls.withColumns({"expected": expected.cast("bigint"), "order": F.struct("row_index", "projection_id", "chunk_index", "batch")})
            go = admitted(calls.withColumn("actual", F.col("expected")), budget_usd, charged, "order")
            go.write.parquet(f"{work}/calls-{name}")
            go = spark.read.schema(go.schema).parquet(f"{work}/calls-{name}")
            n_go, guess = go.agg(F.count(F.lit(1)), F.coalesce(F.sum("estimated"), F.lit(0))).first()
            exhausted = n_go < calls.count()
            if n_go:
                got = _ask(go, plan.rows(plan.states, k), groups, answerer, n_go)
                keys = rows.filter("asks").select("doc_id", "projection_id", "chunk_index", "question_id", "cache_key")
                # A task's answers are in the folder when the task ends, whatever becomes of the others.
                path = f"{cache_path}/run={run_id}/wave={name}"
                each = got.select("doc_id", "projection_id", "chunk_index", "call_id", "model", "input_tokens", F.array_join("errors", "; ").alias("error"), F.explode_outer("answers").alias("x"))
                each = each.select("doc_id", "projection_id", "chunk_index", "call_id", F.coalesce("model", F.lit(answerer.model)).alias("model"), "input_tokens", F.nullif("error", F.lit("")).alias("error"), "x.*")
                each = each.join(F.broadcast(keys) if n_go <= TASK_CALLS * 100 else keys, ["doc_id", "projection_id", "chunk_index", "question_id"], "left")
                each.select(*CACHE.fieldNames()[:-2]).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
                paid = spark.read.schema(CACHE).option("basePath", cache_path).parquet(path)
                calls_made = paid.dropDuplicates(["call_id"])
                tokens, failed, why = calls_made.agg(F.sum("input_tokens"), F.count("error"), F.min(F.when(F.col("error").startswith(Failure.CONFIG.value) & (F.col("error") != NOT_ASKED), F.col("error")))).first()
                charged, estimated, fatal = charged + (tokens or 0), estimated + guess, why
                skipped += calls_made.filter("error is not null").select("doc_id").distinct().count() if failed else 0
            answers = _stored(spark, f"{cache_path}/run={run_id}", CACHE)
            cells = _cells(rows, answers, broken, run_id, qs)
            hidden = f"{cells_path}/_{name}"
            corpus.write_cells(cells, hidden)
            new = corpus.read_cells(spark, hidden).select("doc_id").distinct().count() if files.has_rows(hidden) else 0
            if new:
                files.move(hidden, f"{cells_path}/wave={name}")
            else:
                files.remove(hidden)
            processed += new
            files.write_json(f"{run_dir}/checkpoint.json", {"run_id": run_id, "questionset_hash": qs.hash, "cursor": already + processed, "waves": k + 1, "total_input_tokens_charged": int(charged)})
            progress = replace(progress, done=already + processed, processed=processed, spent_micro_usd=tokens_to_micro_usd(charged), seconds=time.monotonic() - started, wave=k + 1, stopping=drain.asked.is_set() or exhausted or bool(fatal))
            if on_progress:
                on_progress(progress)
            if exhausted or fatal:
                break
    failed = plan.states.filter("error is not null").select("row_index", "doc_id", F.col("error").alias("reason"), F.col("state").alias("raw"))
    bad.select("row_index", "doc_id", "reason", "raw").unionByName(failed).join(refused.select("row_index", "reason"), ["row_index", "reason"], "left_anti").write.parquet(f"{work}/refused")
    refused_now = spark.read.schema(QUARANTINE).parquet(f"{work}/refused")
    n_bad = refused_now.count()
    if n_bad:
        refused_now.select(*QUARANTINE.fieldNames()).write.mode("append").parquet(quarantine)
    files.remove(work)
    if fatal:
        raise AnswerError(Failure.CONFIG, f"{fatal}; resume {run_id} when it is mended")
    return RunResult(run_dir, processed, already, skipped, n_bad, counts[0] - n_misses, n_misses, int(charged), exhausted, (charged - at_start) / estimated if estimated else None, interrupted)
