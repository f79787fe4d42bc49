import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.operators import answering, chunking, compare, reports, review, runs, sampling, scoring
from tallyloom.operators.answering import AdaptiveLimit, AnswerError, BatchAnswerer, Failure, HashAnswerer, decode, pause, with_retries
from tallyloom.plans import questions as Q
from tallyloom.sources import corpus
from tallyloom.streaming import ingest

QS = Q.from_mapping(
    {"version": 1, "name": "t", "defaults": {"projection": ["body"]}, "questions": [
        {"id": "urgent", "type": "noul", "instructions": "The ticket is urgent."}, {"id": "team", "type": "choice", "instructions": "The team.", "criteria": {"billing": "b", "technical": "t"}},
        {"id": "anger", "type": "score", "instructions": "The anger.", "criteria": ["calm", "cross", "furious"]}]}
)


def gold_rows(spark, rows):
    """(gold, weight, noul, confidence, modal) rows of one noul, choice or score question."""
    return spark.createDataFrame(rows, "question_id string, type string, gold_answer string, weight double, noul double, choice string, confidence double, modal_level string")


def noul(gold, w, p):
    return ("q", "noul", gold, float(w), float(p), None, abs(p - 0.5) * 2, None)


def choice(gold, w, said, conf):
    return ("q", "choice", gold, float(w), None, said, float(conf), None)


def score(gold, w, modal):
    return ("q", "score", gold, float(w), None, None, 0.5, modal)


def test_kish_and_wilson(spark):
    r = spark.range(1).select(C.kish(F.lit(12.0), F.lit(84.0)).alias("k"), *(x.alias(f"{n}{k}") for n, (p, m) in {"a": (0.25, 20.0), "b": (0.9, 100.0), "c": (0.5, 0.0)}.items() for k, x in enumerate(C.wilson(F.lit(p), F.lit(m))))).first()
    assert r["k"] == pytest.approx(144 / 84)
    assert (r["a0"], r["a1"]) == pytest.approx((0.11186170140766569, 0.468700877618744))
    assert (r["b0"], r["b1"]) == pytest.approx((0.8256343384950865, 0.9447708629393249))
    assert (r["c0"], r["c1"]) == (0.0, 1.0)


def test_accuracy_weights_and_unclear(spark):
    rows = [noul("true", 1, 0.9), noul("TRUE ", 1, 0.8), noul("true", 8, 0.1), noul("unclear", 5, 0.9), noul("", 5, 0.9)]
    r = scoring.accuracy(gold_rows(spark, rows)).first()
    assert (r["accuracy"], r["unweighted"], r["n"], r["n_unclear"]) == (pytest.approx(0.2), pytest.approx(2 / 3), 3, 2)
    none = scoring.accuracy(gold_rows(spark, [noul("unclear", 1, 0.9)])).first()
    assert none["accuracy"] is None and none["n"] == 0 and (none["lo"], none["hi"]) == (0.0, 1.0)


def test_a_half_is_no(spark):
    assert scoring.accuracy(gold_rows(spark, [noul("false", 1, 0.5)])).first()["accuracy"] == 1.0


def test_adjacent_and_zero_padded_levels(spark):
    r = scoring.accuracy(gold_rows(spark, [score("2", 1, "2"), score("2", 1, "1"), score("2", 2, "0")])).first()
    assert r["adjacent"] == pytest.approx(0.5) and r["accuracy"] == pytest.approx(0.25)
    assert scoring.accuracy(gold_rows(spark, [score("02", 1, "2")])).first()["accuracy"] == 0.0


def test_calibration(spark):
    rows = [choice("a", 1, x, 0.9) for x in "aaabb"]
    assert scoring.calibration_error(gold_rows(spark, rows)).first()["ece"] == pytest.approx(0.3)
    p = [noul("true", 1, 0.9), noul("true", 1, 0.9), noul("false", 1, 0.9)]
    assert scoring.calibration_error(gold_rows(spark, p), True).first()["ece"] == pytest.approx(abs(2 / 3 - 0.9))
    assert scoring.reliability(gold_rows(spark, [choice("a", 1, "a", 1.0)])).first()["bin"] == 9


def test_thresholds(spark):
    both = [choice("a", 1, "a", 0.6)] * 40 + [choice("a", 1, "a", 0.9)] * 40
    r = scoring.thresholds(gold_rows(spark, both)).first()
    assert r["threshold"] == 0.6 and r["coverage"] == 1.0
    few = [choice("a", 1, "a", 0.99)] * 5 + [choice("a", 1, "b", 0.5)] * 50
    assert scoring.thresholds(gold_rows(spark, few)).first()["threshold"] is None


def test_threshold_equals_a_sweep(spark):
    import random

    rng = random.Random(3)
    rows = [choice("a", rng.choice([1, 2, 5]), "a" if rng.random() < c else "b", c) for c in [round(rng.uniform(0.5, 1), 2) for _ in range(300)]]
    got = scoring.thresholds(gold_rows(spark, rows), target=0.85).first()["threshold"]
    want = None
    for t in sorted({r[6] for r in rows}):
        own = [(r[3], r[5] == "a") for r in rows if r[6] >= t]
        w, w2 = sum(x for x, _ in own), sum(x * x for x, _ in own)
        if w * w / w2 >= 30 and sum(x for x, ok in own if ok) / w >= 0.85:
            want = t
            break
    assert got == want


def test_verdicts(spark):
    s = spark.createDataFrame([("a", 29, 1.0), ("b", 30, 0.9), ("c", 30, 0.8), ("d", 30, 0.8), ("e", 40, None)], "question_id string, n int, accuracy double")
    v = scoring.verdicts(s, spark.createDataFrame([("d", "exploratory")], "question_id string, gate string"))
    assert {r["question_id"]: r["verdict"] for r in v.collect()} == {"a": "INSUFFICIENT", "b": "PASS", "c": "FAIL", "d": "FAIL — exploratory only", "e": "INSUFFICIENT"}
    assert scoring.strict_failure(v).first()["failed"]


def cells(spark, rows):
    """(doc_id, question_id, type, noul, choice, score, probabilities) with what depends on them."""
    df = spark.createDataFrame(rows, "doc_id string, question_id string, type string, noul double, choice string, score double, probabilities map<string,double>")
    conf = F.when(F.col("type") == "noul", F.abs(F.col("noul") - 0.5) * 2).otherwise(F.array_max(F.map_values("probabilities")))
    return df.withColumns({"confidence": conf, "chunk_count": F.lit(1), "legend": F.lit(None).cast("map<string,string>"), "ts": F.lit(datetime.datetime(2024, 1, 1))})


def test_strata_labels(spark):
    rows = [(str(k), "q", "noul", p, None, None, None) for k, p in enumerate((0.05, 0.35, 0.99, 1.0, 0.6))]
    rows += [("c", "q", "choice", None, "billing", None, {"billing": 0.85, "x": 0.15}), ("s", "q", "score", None, None, 1.9, {"1": 0.35, "2": 0.65})]
    got = {r["doc_id"]: r["stratum"] for r in sampling.with_strata(cells(spark, rows)).collect()}
    assert got == {"0": "0.0-0.2", "1": "0.2-0.4", "2": "0.8-1.0", "3": "0.8-1.0", "4": "0.4-0.6", "c": "billing:0.8-1.0", "s": "2:0.6-0.8"}


def test_allocation():
    got = sampling.allocate({"a": 3, "b": 100, "c": 100}, 20)
    assert got["a"] == 3 and got["b"] + got["c"] == 17
    assert sampling.allocate({"a": 2}, 9) == {"a": 2} and sampling.allocate({}, 9) == {}


def test_sample_weights_add_up_and_repeat(spark):
    rows = [(str(k), "q", "noul", 0.95 if k % 11 else 0.1, None, None, None) for k in range(550)]
    s = sampling.stratified_sample(cells(spark, rows), 40)
    a = s.collect()
    assert len(a) == 40 and sum(r["stratum_weight"] for r in a) == pytest.approx(550)
    assert {r["doc_id"] for r in a} == {r["doc_id"] for r in sampling.stratified_sample(cells(spark, rows), 40).collect()}


def test_modal_level_takes_the_first_of_equals(spark):
    r = spark.range(1).select(C.modal_level(F.create_map(F.lit("b"), F.lit(0.4), F.lit("a"), F.lit(0.4), F.lit("c"), F.lit(0.2))).alias("m")).first()
    assert r["m"] == "b"


def test_chunk_aggregation(spark):
    schema = "doc_id string, question_id string, type string, noul double, score double, probabilities map<string,double>, legend map<string,string>"
    n = spark.createDataFrame([("d", "q", "noul", p, None, None, None) for p in (0.2, 0.9, 0.4)], schema)
    assert chunking.aggregate_chunks(n).first()["noul"] == 0.9
    assert chunking.aggregate_chunks(n, "mean").first()["noul"] == pytest.approx(0.5)
    c = chunking.aggregate_chunks(spark.createDataFrame([("d", "q", "choice", None, None, {"b": 0.8, "t": 0.2}, None), ("d", "q", "choice", None, None, {"b": 0.1, "t": 0.9}, None)], schema)).first()
    assert c["choice"] == "t" and c["confidence"] == pytest.approx(0.55) and c["probabilities"] == pytest.approx({"b": 0.45, "t": 0.55})
    s = chunking.aggregate_chunks(spark.createDataFrame([("d", "q", "score", None, 0.0, {"0": 1.0}, {"0": "x"}), ("d", "q", "score", None, 2.0, {"2": 1.0}, {"0": "x"})], schema)).first()
    assert s["score"] == 1.0 and s["probabilities"] == pytest.approx({"0": 0.5, "2": 0.5}) and s["chunk_count"] == 2 and s["confidence_source"] == "derived"


@pytest.mark.parametrize("unit", ["word{} ", '"\\\n{}', "{}", "aé€{}"])
def test_chunks_cover_every_character(unit):
    body = "".join(unit.format(k) for k in range(3000))
    group = Q.call_groups(QS)[0]
    limit = int(1000 * 0.85) - max(q.schema_tokens for q in group.questions)
    parts = chunking.chunk_state({"body": body, "other": "o" * 500}, group, 1000)
    assert len(parts) > 1 and all(Q.estimate_tokens(p) <= limit for p in parts)
    end = 0
    for p in parts:
        at = body.find(p["body"])
        assert 0 <= at <= end
        end = max(end, at + len(p["body"]))
    assert end == len(body)


def test_chunks_leave_in_small_batches():
    import pyarrow as pa

    group = Q.call_groups(QS)[0]
    states = [json.dumps({"body": f"{k} " + 'a "b" ' * 2000}) for k in range(40)]
    sent = pa.RecordBatch.from_arrays([pa.array([f"d{k}" for k in range(40)]), pa.array(range(40), pa.int64()), pa.array(states)], names=["doc_id", "row_index", "state"])
    got = list(chunking.cut_batches(iter([sent, sent.slice(0, 0), sent.slice(0, 3)]), group, 700, 0.15, most=50_000))
    assert max(sum(map(len, b.column(4).to_pylist())) for b in got) < 53_000 and len(got) > 10
    parts = [chunking.chunk_state(json.loads(s), group, 700, 0.15) for s in (*states, *states[:3])]
    want = [(f"d{k % 40}", k % 40, n, len(ps), json.dumps(p, ensure_ascii=False), None) for k, ps in enumerate(parts) for n, p in enumerate(ps)]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


def test_chunks_that_cannot_be():
    group = Q.call_groups(QS)[0]
    with pytest.raises(Q.ContextOverflow):
        chunking.chunk_state({"body": "a" * 9000, "other": "b" * 8999}, group, 1000)
    with pytest.raises(Q.ContextOverflow):
        chunking.chunk_state({"body": ["a"] * 9000}, group, 1000)


def test_context_batches_follow_the_greedy_split(spark):
    group = Q.call_groups(QS)[0]
    for tokens in (0, 20, 50, 200):
        limit = 160
        got = spark.range(1).select(C.context_batches(group, F.lit(tokens), limit, 0.0).alias("b")).first()["b"]
        try:
            want = [k for k, b in enumerate(Q.split_for_context(group, tokens, limit, 0.0)) for _ in b]
        except Q.ContextOverflow:
            want = None
        assert got == want


def test_tokens_agree_with_python(spark):
    rows = [("plain",), ('q"uo\\te\n\ttab',), ("é€\U0001f600 /",), ("",), (None,)]
    df = spark.createDataFrame(rows, "body string")
    got = [r[0] for r in df.select(C.state_tokens(("body",))).collect()]
    assert got == [Q.estimate_tokens({"body": r[0]}) for r in rows]


def test_one_space(spark):
    s = " a \tb\x1cc \n"
    assert spark.createDataFrame([(s,)], "s string").select(C.one_space(F.col("s"))).first()[0] == " ".join(s.split())


def test_agreement(spark):
    a = cells(spark, [(str(k), "n", "noul", p, None, None, None) for k, p in enumerate((0.9, 0.1, 0.6))] + [("0", "c", "choice", None, "billing", None, {"billing": 0.9, "t": 0.1}), ("0", "s", "score", None, None, 2.0, {"2": 1.0})])
    b = cells(spark, [(str(k), "n", "noul", p, None, None, None) for k, p in enumerate((0.8, 0.4, 0.3))] + [("0", "c", "choice", None, "t", None, {"billing": 0.3, "t": 0.7}), ("0", "s", "score", None, None, 1.5, {"1": 1.0})])
    got = {r["question_id"]: (r["agreement"], r["drift"]) for r in compare.agreement(a, b).collect()}
    assert got["n"] == pytest.approx((2 / 3, 0.7 / 3)) and got["c"] == pytest.approx((0.0, 0.6)) and got["s"] == pytest.approx((0.0, 0.5))


def test_ablation(spark):
    p, f = (spark.createDataFrame(r, "question_id string, accuracy double") for r in ([("a", 0.75), ("b", None), ("c", 0.5)], [("a", 1.0), ("b", 0.5), ("c", 0.5)]))
    assert {r["question_id"]: r["winner"] for r in compare.ablation(p, f).collect()} == {"a": "full-record", "b": "insufficient data", "c": "tie"}


def test_review_queue_and_overrides(spark, tmp_path):
    c = cells(spark, [("1", "q", "noul", 0.05, None, None, None), ("2", "q", "noul", 0.55, None, None, None), ("3", "q", "noul", 0.45, None, None, None)])
    limits = spark.createDataFrame([("q", 0.2)], "question_id string, threshold double")
    queue = review.review_queue(c, limits)
    assert {r["doc_id"] for r in queue.collect()} == {"2", "3"}
    assert review.review_queue(c, limits.withColumn("threshold", F.lit(None).cast("double"))).count() == 0
    docs = spark.createDataFrame([("2", "text")], "doc_id string, body string")
    filled = review.with_fields(queue, docs, ["body"]).withColumn("human_answer", F.when(F.col("doc_id") == "2", " true ").otherwise(" "))
    assert {r["doc_id"]: r["body"] for r in filled.collect()} == {"2": "text", "3": ""}
    for k in (1, 2):
        review.append_overrides(review.overrides_from(filled.withColumn("human_answer", F.when(F.col("human_answer") != " ", F.lit(f"v{k}"))), "me", "r", datetime.datetime(2024, 1, k)), str(tmp_path / "o"))
    own = spark.read.parquet(str(tmp_path / "o"))
    assert review.merged(c, own).count() == 4
    assert {r["doc_id"]: r["value"] for r in review.merged(c, own, True).collect()} == {"1": "0.05", "2": "v2", "3": "0.45"}


def test_normalize(spark):
    df = spark.createDataFrame([("a", 1), ("", 2), (None, 3), ("a", 4), ("b", 5)], "id string, n int")
    kept, bad = corpus.normalize(df.coalesce(1), "id")
    assert sorted((r["doc_id"], r["n"]) for r in kept.collect()) == [("a", 1), ("b", 5)]
    assert sorted(r["reason"] for r in bad.collect()) == ["duplicate id", "missing id", "missing id"]
    kept, bad = corpus.normalize(df.union(df.limit(1)).coalesce(1))
    assert kept.count() == 5 and bad.count() == 1
    kept, _ = corpus.normalize(spark.createDataFrame([], "doc_id string, n int"), "doc_id")
    assert kept.count() == 0


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b,c\n1,"two\nlines ""q""",\n2,,\n', encoding="utf-8")
    assert [tuple(r) for r in corpus.read_source(spark, str(p)).collect()] == [("1", 'two\nlines "q"', ""), ("2", "", "")]
    with pytest.raises(ValueError):
        corpus.read_source(spark, "x.xls")


def test_decode_is_all_or_nothing():
    raw = {"answers": {"urgent": {"type": "noul", "noul": 0.97}, "team": {"type": "choice", "choice": "billing", "probabilities": {"billing": 0.91}, "confidence": 0.88}, "anger": {"type": "score", "score": 2.7, "probabilities": {0: 0.3}, "confidence": 0.7, "legend": {0: "x", 1: {"k": 1}}}}}
    got, errors = decode(raw, QS.questions)
    assert not errors and got["urgent"]["confidence"] == pytest.approx(0.94) and got["anger"]["legend"]["1"] == '{"k": 1}' and got["anger"]["probabilities"] == {"0": 0.3}
    del raw["answers"]["team"]
    raw["answers"]["anger"]["type"] = "noul"
    assert len(decode(raw, QS.questions)[1]) == 2


def test_retries_and_limits():
    waits, left = [], [3]

    def call():
        if left[0]:
            left[0] -= 1
            raise AnswerError(Failure.RATE, retry_after=1.5 if left[0] == 1 else None)
        return {"ok": True}

    limit = AdaptiveLimit()
    assert with_retries(call, waits.append, limit) == {"ok": True} and len(waits) == 3 and 1.5 in waits and limit.limit == 1
    tries = []
    with pytest.raises(AnswerError):
        with_retries(lambda: (tries.append(1), (_ for _ in ()).throw(AnswerError(Failure.DECODE)))[1], waits.append)
    assert len(tries) == 2
    assert pause(10, rng=lambda: 1.0) == 30.0 and answering.classify(529) is Failure.RATE and answering.classify(401) is Failure.CONFIG and answering.classify(None) is Failure.SERVER
    for _ in range(20):
        limit.on_success()
    assert limit.limit == 2


def corpus_file(spark, tmp_path, n=20, body="ticket number {}"):
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([(f"T-{k:04d}", body.format(k)) for k in range(n)], "ticket_id string, body string").coalesce(1).write.parquet(path)
    return path


def test_run_resume_cache_and_budget(spark, tmp_path):
    path, root = corpus_file(spark, tmp_path), str(tmp_path / "runs")
    a = runs.run(spark, path, QS, HashAnswerer(), root, limit=8, id_field="ticket_id")
    assert (a.processed, a.already_done, a.cache_hits, a.cache_misses, a.tokens_charged) == (8, 0, 0, 24, 8 * 110)
    b = runs.run(spark, path, QS, HashAnswerer(), root, id_field="ticket_id", resume=a.run_dir.rpartition("/")[2])
    assert (b.processed, b.already_done, b.cache_misses) == (12, 8, 36)
    cells_ = corpus.read_cells(spark, b.cells_path)
    assert cells_.count() == 60 and cells_.select("doc_id", "question_id").distinct().count() == 60
    c = runs.run(spark, path, QS, HashAnswerer(), root, id_field="ticket_id")
    assert (c.processed, c.cache_hits, c.cache_misses, c.tokens_charged) == (20, 60, 0, 0)
    assert corpus.read_cells(spark, c.cells_path).filter("call_id <> 'cached'").count() == 0
    more = Q.from_mapping({"version": 1, "name": "t", "defaults": {"projection": ["body"]}, "questions": [{"id": q.id, "type": q.type, "instructions": q.instructions, "criteria": q.criteria} for q in QS.questions] + [{"id": "extra", "type": "noul", "instructions": "There is a file."}]})
    d = runs.run(spark, path, more, HashAnswerer(), root, id_field="ticket_id")
    assert (d.cache_hits, d.cache_misses) == (60, 20)
    with pytest.raises(Q.ConfigError, match="extra"):
        runs.run(spark, path, more, HashAnswerer(), root, id_field="ticket_id", resume=a.run_dir.rpartition("/")[2])
    e = runs.run(spark, path, QS, HashAnswerer(), str(tmp_path / "poor"), budget_usd=0.000001, id_field="ticket_id")
    assert e.exhausted and e.processed == 0 and e.tokens_charged == 0
    part = runs.run(spark, path, QS, HashAnswerer(), str(tmp_path / "some"), budget_usd=0.00003, id_field="ticket_id")
    assert part.exhausted and 0 < part.processed < 20


def test_long_and_unfittable_documents(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    rows = [("a", "x " * 3000), ("b", "short")]
    spark.createDataFrame(rows, "ticket_id string, body string").coalesce(1).write.parquet(path)
    r = runs.run(spark, path, QS, HashAnswerer(), str(tmp_path / "r"), id_field="ticket_id", context_limit=1000)
    got = {(x["doc_id"], x["chunk_count"] > 1, x["confidence_source"] == "derived") for x in corpus.read_cells(spark, r.cells_path, "team").collect()}
    assert got == {("a", True, True), ("b", False, False)}


def test_batch_answerer_failures(spark, tmp_path):
    path = corpus_file(spark, tmp_path, 6)

    def ask(state, questions):
        n = int(state["body"].rpartition(" ")[2])
        out = {q["id"]: {"type": "noul", "noul": 0.9} if q["type"] == "noul" else {"type": q["type"], q["type"]: "billing" if q["type"] == "choice" else 1.0, "probabilities": {"0": 1.0}, "confidence": 0.9} for q in questions}
        if n == 3:
            out.pop("team")
        return {"model": "m", "usage": {"input_tokens": 10}, "answers": out}

    r = runs.run(spark, path, QS, BatchAnswerer(ask), str(tmp_path / "r"), id_field="ticket_id")
    assert (r.processed, r.skipped, r.tokens_charged) == (5, 1, 60)


def test_estimate_and_reports(spark):
    docs = spark.createDataFrame([(str(k), "b" * 40) for k in range(30)], "doc_id string, body string")
    e = reports.estimate(docs, QS)
    schema = sum(q.schema_tokens for q in QS.questions)
    assert e.tokens == 30 * (Q.estimate_tokens({"body": "b" * 40}) + schema) and "30 documents" in reports.estimate_text(e)
    assert reports.estimate(docs.limit(0), QS).tokens == 0
    rows = [{"question_id": "q", "type": "noul", "n": 30, "accuracy": 0.97, "lo": 0.9, "hi": 0.99, "ece_confidence": None, "ece_probability": 0.1, "threshold": 0.12, "coverage": 1.0, "verdict": "PASS"}]
    assert "> 0.12" in reports.validation_text(rows, 2) and "2 answers" in reports.validation_text(rows, 2)


def test_stream_answers_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df = spark.createDataFrame([(f"{k}", "t") for k in range(10)], "id string, body string")
    df.write.parquet(src)
    for _ in range(2):
        ingest.answer_stream(spark, src, df.schema, "id", QS, HashAnswerer(), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 30
    df.withColumn("id", F.concat(F.lit("n"), "id")).write.mode("append").parquet(src)
    ingest.answer_stream(spark, src, df.schema, "id", QS, HashAnswerer(), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 60


def test_command_line(spark, tmp_path, capsys):
    from tallyloom import cli

    path = corpus_file(spark, tmp_path, 12)
    Q.dump(QS, str(tmp_path / "q.yaml"))
    base = ["--input", path, "--questions", str(tmp_path / "q.yaml"), "--id-field", "ticket_id"]
    assert cli.main(["estimate", *base]) == 0 and cli.main(["run", *base, "--out", str(tmp_path / "runs")]) == 0
    run_dir = [str(p) for p in (tmp_path / "runs").iterdir() if (p / "manifest.json").exists()][0]
    label = str(tmp_path / "urgent.csv")
    assert cli.main(["label", "--run", run_dir, "--question", "urgent", "--n", "6", "--out", label]) == 0
    assert cli.main(["label", "--run", run_dir, "--question", "urgent", "--out", label]) == 2
    import pandas as pd

    t = pd.read_csv(label)
    assert len(t) == 6 and list(t.columns) == [*corpus.LABEL_HEAD, "body", "gold_answer", "notes"]
    t.assign(gold_answer="true").to_csv(label, index=False)
    assert cli.main(["validate", "--run", run_dir, "--gold", label]) == 0
    assert "INSUFFICIENT" in capsys.readouterr().out and cli.main(["report", "--run", run_dir]) == 0
    assert json.load(open(f"{run_dir}/validation.json"))[0]["n"] == 6
    assert cli.main(["review-export", "--run", run_dir, "--out", str(tmp_path / "queue.csv")]) == 0
