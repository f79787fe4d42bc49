"""Answerers: what turns a state and its questions into answers.

Column answerers are expressions and stay in the plan. A batch answerer is any
function that gets a state and questions and returns raw answers; it runs in
``mapInPandas`` with retries, and its rows must be written before they are read
twice (each evaluation may cost money).
"""

from __future__ import annotations

import json
import os
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from enum import Enum
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import legend_of
from tallyloom.plans.questions import CallGroup, Question

ANSWER = "struct<noul:double,choice:string,score:double,probabilities:map<string,double>,legend:map<string,string>,confidence:double,confidence_source:string>"


class ColumnAnswerer(Protocol):
    """``call_tokens`` is what a call of so many questions is charged: known before it is made."""

    model: str

    def answer(self, doc_id: Column, state: Column, q: Question) -> Column: ...

    def call_tokens(self, n_questions: int | Column, state_tokens: Column) -> Column: ...


def digest(doc_id: Column, what: str) -> Column:
    """First eight hex digits of SHA-256 of ``doc_id|what`` as a number."""
    return F.conv(F.substring(F.sha2(F.concat(doc_id.cast("string"), F.lit(f"|{what}")), 256), 1, 8), 16, 10).cast("bigint")


def answer_struct(q: Question, noul: Column | None = None, probabilities: Column | None = None) -> Column:
    null = F.lit(None)
    if q.type == "noul":
        parts = (noul, null, null, null, null, F.abs(noul - 0.5) * 2, F.lit("derived"))
    else:
        top = F.array_max(F.transform(F.map_entries(probabilities), lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("late"), e["key"].alias("k"))))
        if q.type == "choice":
            parts = (null, top["k"], null, probabilities, null, top["p"], F.lit("model"))
        else:
            score = sum((F.element_at(probabilities, k) * int(k) for k in q.options), F.lit(0.0))
            parts = (null, null, score, probabilities, legend_of(list(q.criteria)), top["p"], F.lit("model"))
    return F.struct(*parts).cast(ANSWER)


@dataclass(frozen=True)
class HashAnswerer:
    """Deterministic answers from a digest of id and question; says nothing about the text."""

    model: str = "digest-1"
    salt: str = ""

    def answer(self, doc_id: Column, state: Column, q: Question) -> Column:
        name = q.id + self.salt
        if q.type == "noul":
            return answer_struct(q, noul=(digest(doc_id, name) % 101) / F.lit(100.0))
        weights = [(digest(doc_id, f"{name}#{k}") % 97 + 1).cast("double") for k in range(len(q.options))]
        total = sum(weights[1:], weights[0])
        pairs: list[Column] = []
        for option, w in zip(q.options, weights, strict=True):
            pairs += [F.lit(option), w / total]
        return answer_struct(q, probabilities=F.create_map(*pairs))

    def call_tokens(self, n_questions: int | Column, state_tokens: Column) -> Column:
        return (F.lit(n_questions) * 20 + 50).cast("bigint")


@dataclass(frozen=True)
class LexicalAnswerer:
    """Share of words of the text that belong to an option (noul: to ``words['true']``)."""

    words: dict[str, dict[str, tuple[str, ...]]]
    field: str = "text"
    model: str = "lexical-1"

    def answer(self, doc_id: Column, state: Column, q: Question) -> Column:
        tokens = F.split(F.lower(F.coalesce(state[self.field], F.lit(""))), r"\s+")

        def hits(option: str) -> Column:
            own = F.array(*(F.lit(w) for w in self.words.get(q.id, {}).get(option, ("",))))
            return F.size(F.filter(tokens, lambda t: F.array_contains(own, t))) + 1.0

        if q.type == "noul":
            return answer_struct(q, noul=hits("true") / (hits("true") + hits("false")))
        weights = [hits(o) for o in q.options]
        total = sum(weights[1:], weights[0])
        pairs = [x for o, w in zip(q.options, weights, strict=True) for x in (F.lit(o), w / total)]
        return answer_struct(q, probabilities=F.create_map(*pairs))

    def call_tokens(self, n_questions: int | Column, state_tokens: Column) -> Column:
        return (state_tokens + F.lit(n_questions) * 20).cast("bigint")


class Failure(Enum):
    CONFIG = "fatal"
    RATE = "rate"
    SERVER = "server"
    DECODE = "suspicious"


#: Attempts by kind of failure.
ATTEMPTS = {Failure.CONFIG: 1, Failure.RATE: 8, Failure.SERVER: 3, Failure.DECODE: 2}


class AnswerError(Exception):
    def __init__(self, failure: Failure, message: str = "", retry_after: float | None = None) -> None:
        super().__init__(message or failure.value)
        self.failure, self.retry_after = failure, retry_after


def classify(status: int | None) -> Failure:
    """Kind of an HTTP status; none is a network failure."""
    if status in (429, 529):
        return Failure.RATE
    if status is not None and 400 <= status < 500:
        return Failure.CONFIG
    return Failure.SERVER


def pause(attempt: int, retry_after: float | None = None, rng: Callable[[], float] = random.random) -> float:
    """Seconds before another attempt: full jitter, at most 30; the server's word wins."""
    return retry_after if retry_after is not None else rng() * min(30.0, 0.5 * 2**attempt)


def with_retries(call: Callable[[], dict], sleep: Callable[[float], None] = time.sleep, limit: AdaptiveLimit | Gate | None = None) -> dict:
    attempt = 0
    while True:
        try:
            out = call()
        except AnswerError as e:
            attempt += 1
            if limit and e.failure is Failure.RATE:
                limit.on_rate_limited()
            if attempt >= ATTEMPTS[e.failure]:
                raise
            sleep(pause(attempt - 1, e.retry_after))
        else:
            if limit:
                limit.on_success()
            return out


class AdaptiveLimit:
    """Concurrency: one more after every ``window`` clean calls, half after a refusal."""

    def __init__(self, initial: int = 4, ceiling: int = 64, floor: int = 1, window: int = 20) -> None:
        self.limit, self.ceiling, self.floor, self.window, self.clean = initial, ceiling, floor, window, 0

    def on_success(self) -> None:
        self.clean += 1
        if self.clean >= self.window:
            self.clean, self.limit = 0, min(self.ceiling, self.limit + 1)

    def on_rate_limited(self) -> None:
        self.clean, self.limit = 0, max(self.floor, self.limit // 2)


class Gate:
    """As many calls at a time as an ``AdaptiveLimit`` says, while it changes."""

    def __init__(self, limit: AdaptiveLimit) -> None:
        self.limit, self.busy, self.changed = limit, 0, threading.Condition()

    def __enter__(self) -> None:
        with self.changed:
            self.changed.wait_for(lambda: self.busy < self.limit.limit)
            self.busy += 1

    def __exit__(self, *exc) -> None:
        with self.changed:
            self.busy -= 1
            self.changed.notify_all()

    def on_success(self) -> None:
        with self.changed:
            self.limit.on_success()
            self.changed.notify_all()

    def on_rate_limited(self) -> None:
        with self.changed:
            self.limit.on_rate_limited()


def http_ask(url: str, model: str, key: str | None = None, timeout: float = 60.0) -> Callable[[dict, list[dict]], dict]:
    """An ``ask`` that posts ``{"model", "state", "questions": {id: ...}}`` and reads ``{"model", "usage", "answers"}``.

    Statuses, time-outs and unreadable bodies become the failures that the retries know.
    """

    def ask(state: dict, questions: list[dict]) -> dict:
        body = {"model": model, "state": state, "questions": {q["id"]: {k: v for k, v in q.items() if k != "id" and v is not None} for q in questions}}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as reply:
                raw = reply.read()
        except urllib.error.HTTPError as e:
            wait = e.headers.get("Retry-After", "") if e.headers else ""
            raise AnswerError(classify(e.code), f"status {e.code}", float(wait) if wait.replace(".", "", 1).isdigit() else None) from e
        except OSError as e:
            raise AnswerError(classify(None), str(e)) from e
        try:
            return dict(json.loads(raw))
        except (ValueError, TypeError) as e:
            raise AnswerError(Failure.DECODE, str(e)) from e

    return ask


def http_answerer(url: str, model: str, key_env: str | None = None, **options) -> BatchAnswerer:
    """The key is read from the driver's environment."""
    return BatchAnswerer(http_ask(url, model, os.environ.get(key_env) if key_env else None), model, **options)


def decode(raw: dict, questions: tuple[Question, ...] | list[Question]) -> tuple[dict[str, dict], list[str]]:
    """({question_id: answer fields}, errors). Any error makes the whole call void."""
    answers, errors, out = raw.get("answers") or {}, [], {}
    for q in questions:
        a = answers.get(q.id)
        if a is None:
            errors.append(f"{q.id}: no answer")
        elif a.get("type") != q.type:
            errors.append(f"{q.id}: expected {q.type}, got {a.get('type')}")
        else:
            row = dict.fromkeys(("noul", "choice", "score", "probabilities", "legend", "confidence", "confidence_source"))
            try:
                if q.type == "noul":
                    row |= {"noul": float(a["noul"]), "confidence": abs(float(a["noul"]) - 0.5) * 2, "confidence_source": "derived"}
                else:
                    row |= {q.type: str(a["choice"]) if q.type == "choice" else float(a["score"]), "probabilities": {str(k): float(v) for k, v in a["probabilities"].items()}, "confidence": float(a["confidence"]), "confidence_source": "model"}
                if q.type == "score":
                    row["legend"] = {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (a.get("legend") or {}).items()}
            except (KeyError, TypeError, ValueError) as e:
                errors.append(f"{q.id}: {e!r}")
            out[q.id] = row
    return out, errors


NOT_ASKED = f"{Failure.CONFIG.value}: not asked"
RAW = "doc_id string, projection_id string, chunk_index int, batch int, call_id string, model string, input_tokens bigint, answers string, errors array<string>"


@dataclass(frozen=True)
class BatchAnswerer:
    """``ask(state, questions) -> {"model", "usage": {"input_tokens"}, "answers": {id: ...}}`` on the executors.

    A task has ``concurrency`` calls under way at first, up to ``ceiling`` while none is refused, half after a refusal;
    the whole run has that for each task that runs at a time. ``ask`` must bear several threads where ``ceiling`` > 1.
    """

    ask: Callable[[dict, list[dict]], dict]
    model: str = "batch-1"
    concurrency: int = 4
    ceiling: int = 16

    def run(self, calls: DataFrame, group: CallGroup) -> DataFrame:
        """A row for each of ``calls(doc_id, projection_id, chunk_index, batch, state json, asked array<string>)``, answers as an array.

        A call whose answers don't decode has errors, no answers, and the tokens it was charged. After a fatal failure the
        task asks no more; the calls it leaves have the error ``NOT_ASKED`` and no tokens.
        """
        about = {q.id: q for q in group.questions}
        ask, first, most = self.ask, self.concurrency, self.ceiling

        def one(row, gate: Gate, fatal: threading.Event) -> tuple:
            import hashlib

            doc_id, projection_id, chunk_index, batch, state, asked = row
            call_id = hashlib.sha256(f"{doc_id}|{projection_id}|{chunk_index}|{batch}".encode()).hexdigest()[:16]
            questions = [about[k] for k in asked]
            sent = [{"id": q.id, "type": q.type, "instructions": q.instructions, "criteria": q.criteria} for q in questions]

            def call() -> dict:
                with gate:
                    return ask(json.loads(state), sent)

            got, errors, model, used = {}, [], None, 0
            if fatal.is_set():
                errors = [NOT_ASKED]
            else:
                try:
                    raw = with_retries(call, limit=gate)
                    model, used = raw.get("model"), int((raw.get("usage") or {}).get("input_tokens") or 0)
                    got, errors = decode(raw, questions)
                except AnswerError as e:
                    errors = [f"{e.failure.value}: {e}"]
                    if e.failure is Failure.CONFIG:
                        fatal.set()
            return doc_id, projection_id, chunk_index, batch, call_id, model, used, json.dumps([] if errors else [{"question_id": k, **v} for k, v in got.items()]), errors

        def answer(frames: Iterator) -> Iterator:
            import pandas as pd

            gate, fatal = Gate(AdaptiveLimit(min(first, most), most)), threading.Event()
            with ThreadPoolExecutor(most) as pool:
                for frame in frames:
                    rows = pool.map(lambda r: one(r, gate, fatal), frame.itertuples(index=False, name=None))
                    yield pd.DataFrame(list(rows), columns=[x.split(" ")[0] for x in RAW.split(", ")])

        asked = calls.select("doc_id", "projection_id", "chunk_index", "batch", "state", "asked")
        kind = "array<struct<question_id:string," + ANSWER.removeprefix("struct<") + ">"
        return asked.mapInPandas(answer, RAW).withColumn("answers", F.from_json("answers", kind))
