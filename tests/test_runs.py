"""Runs that are stopped, killed, refused or served by a real service."""

import json
import os
import signal
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from test_operators import QS, corpus_file

from tallyloom.operators import answering, runs
from tallyloom.operators.answering import AdaptiveLimit, AnswerError, BatchAnswerer, Failure, Gate, HashAnswerer
from tallyloom.plans import questions as Q
from tallyloom.sources import corpus, files
from tallyloom.streaming import ingest


def answerer_of():
    """A nested function, which travels to the workers whole."""

    def answers(questions):
        out = {}
        for q in questions:
            out[q["id"]] = {"type": "noul", "noul": 0.9} if q["type"] == "noul" else {"type": q["type"], q["type"]: "billing" if q["type"] == "choice" else 1.0, "probabilities": {"0": 1.0}, "confidence": 0.9}
        return out

    return answers


def logged(log, fails=None, tokens=10):
    """An ``ask`` that notes every paid call in a file; ``fails(ticket number)`` may raise."""
    answers = answerer_of()

    def ask(state, questions):
        n = int(state["body"].rpartition(" ")[2])
        if fails:
            fails(n)
        with open(log, "a", encoding="utf-8") as f:
            f.write(f"{n}\n")
        return {"model": "m", "usage": {"input_tokens": tokens}, "answers": answers(questions)}

    return ask


def paid(log):
    return Counter(open(log, encoding="utf-8").read().split())


def test_a_run_that_dies_pays_nothing_twice(spark, tmp_path):
    path, root, log, flag = corpus_file(spark, tmp_path, 40), str(tmp_path / "runs"), str(tmp_path / "log"), str(tmp_path / "dead")

    def dies(n):
        if n == 25 and not os.path.exists(flag):
            raise RuntimeError("the machine is gone")

    with pytest.raises(Exception, match="the machine is gone"):
        runs.run(spark, path, QS, BatchAnswerer(logged(log, dies), concurrency=1, ceiling=1), root, id_field="ticket_id", wave_cells=30)
    (run_id,) = [n for n in files.names(root) if files.exists(f"{root}/{n}/manifest.json")]
    committed = corpus.read_cells(spark, f"{root}/{run_id}/cells").select("doc_id").distinct().count()
    assert 0 < committed < 40 and committed == files.read_json(f"{root}/{run_id}/checkpoint.json")["cursor"]
    open(flag, "w").close()
    before = paid(log)
    r = runs.run(spark, path, QS, BatchAnswerer(logged(log, dies), concurrency=1, ceiling=1), root, id_field="ticket_id", resume=run_id, wave_cells=30)
    assert (r.already_done, r.processed) == (committed, 40 - committed)
    cells = corpus.read_cells(spark, r.cells_path)
    assert cells.count() == 120 and cells.select("doc_id", "question_id").distinct().count() == 120
    again = paid(log) - before
    lost = sum(before.values()) - committed  # calls of the task that died: under way, not in the cache
    assert sum(paid(log).values()) == 40 + lost and all(n == 1 for n in again.values()) and lost < 10


def test_tasks_that_ended_are_in_the_cache_when_others_die(spark, tmp_path, monkeypatch):
    path, root, log, flag = corpus_file(spark, tmp_path, 40), str(tmp_path / "runs"), str(tmp_path / "log"), str(tmp_path / "dead")

    def dies(n):
        if n == 39 and not os.path.exists(flag):
            time.sleep(8)
            raise RuntimeError("the machine is gone")

    monkeypatch.setattr(runs, "TASK_CALLS", 5)
    with pytest.raises(Exception, match="the machine is gone"):
        runs.run(spark, path, QS, BatchAnswerer(logged(log, dies), concurrency=1, ceiling=1), root, id_field="ticket_id", wave_cells=10_000)
    (run_id,) = [n for n in files.names(root) if files.exists(f"{root}/{n}/manifest.json")]
    assert not files.has_rows(f"{root}/{run_id}/cells") or corpus.read_cells(spark, f"{root}/{run_id}/cells").count() < 120
    open(flag, "w").close()
    r = runs.run(spark, path, QS, BatchAnswerer(logged(log, dies), concurrency=1, ceiling=1), root, id_field="ticket_id", resume=run_id)
    twice = sum(n - 1 for n in paid(log).values())
    assert r.processed + r.already_done == 40 and twice < 6 and corpus.read_cells(spark, r.cells_path).count() == 120


def test_an_interrupt_lets_the_wave_end(spark, tmp_path):
    path, root, seen = corpus_file(spark, tmp_path, 30), str(tmp_path / "runs"), []
    before = signal.getsignal(signal.SIGINT)

    def on_progress(p):
        seen.append(p)
        os.kill(os.getpid(), signal.SIGINT)

    r = runs.run(spark, path, QS, HashAnswerer(), root, id_field="ticket_id", wave_cells=30, on_progress=on_progress)
    assert r.interrupted and 0 < r.processed < 30 and len(seen) == 1 and signal.getsignal(signal.SIGINT) is before
    assert corpus.read_cells(spark, r.cells_path).count() == 3 * r.processed
    rest = runs.run(spark, path, QS, HashAnswerer(), root, id_field="ticket_id", resume=r.run_id, wave_cells=30)
    assert not rest.interrupted and rest.already_done == r.processed and rest.processed == 30 - r.processed and rest.tokens_charged == 30 * 110


def test_progress_in_words():
    p = runs.Progress(1000, 300, 200, 50, 150, 1_234_500, 5_000_000, 20.0, 3, 9)
    assert p.line() == "wave 3 of 9: 300 of 1,000 documents, $1.2345 of $5.00, 10.0 documents/s, 25 % cached, 70 s left"
    assert runs.Progress(0, 0, 0, 0, 0, 0, 0, 0.0, 0, 0, True).line().endswith("nothing looked up, time left unknown, stopping")


def test_the_budget_counts_what_was_charged(spark, tmp_path):
    """Calls are charged ten times their estimate: only the first, small wave overshoots."""
    path, root, log = corpus_file(spark, tmp_path, 60), str(tmp_path / "runs"), str(tmp_path / "log")
    r = runs.run(spark, path, QS, BatchAnswerer(logged(log, tokens=500)), root, budget_usd=0.000400, id_field="ticket_id", wave_cells=60)
    spent = Q.tokens_to_micro_usd(r.tokens_charged)
    assert r.exhausted and r.processed == r.tokens_charged / 500 and 300 < spent <= 420 and r.calibration > 5
    more = runs.run(spark, path, QS, BatchAnswerer(logged(log, tokens=500)), root, budget_usd=0.000400, id_field="ticket_id", resume=r.run_id)
    assert more.exhausted and more.processed == 0 and more.tokens_charged == r.tokens_charged


def test_a_fatal_failure_keeps_what_was_paid(spark, tmp_path):
    path, root, log, flag = corpus_file(spark, tmp_path, 12), str(tmp_path / "runs"), str(tmp_path / "log"), str(tmp_path / "mended")

    def refuses(n):
        if n == 7 and not os.path.exists(flag):
            raise AnswerError(Failure.CONFIG, "status 401")

    with pytest.raises(AnswerError, match="status 401"):
        runs.run(spark, path, QS, BatchAnswerer(logged(log, refuses), concurrency=1, ceiling=1), root, id_field="ticket_id")
    (run_id,) = [n for n in files.names(root) if files.exists(f"{root}/{n}/manifest.json")]
    open(flag, "w").close()
    r = runs.run(spark, path, QS, BatchAnswerer(logged(log, refuses)), root, id_field="ticket_id", resume=run_id)
    assert r.already_done + r.processed == 12 and r.already_done == 7 and set(paid(log).values()) == {1}


def test_equal_states_are_asked_once(spark, tmp_path):
    path, log = str(tmp_path / "c.parquet"), str(tmp_path / "log")
    spark.createDataFrame([(f"T-{k}", f"ticket number {k % 3}") for k in range(12)], "ticket_id string, body string").coalesce(1).write.parquet(path)
    r = runs.run(spark, path, QS, BatchAnswerer(logged(log)), str(tmp_path / "runs"), id_field="ticket_id", wave_cells=3)
    assert set(paid(log).values()) == {1} and (r.processed, r.cache_misses, r.cache_hits, r.tokens_charged) == (12, 9, 27, 30)
    cells = corpus.read_cells(spark, r.cells_path)
    assert cells.count() == 36 and cells.filter("call_id <> 'cached'").select("doc_id").distinct().count() == 3


def test_a_schema_that_fits_no_call_is_split(spark, tmp_path):
    path, log = corpus_file(spark, tmp_path, 4), str(tmp_path / "log")
    most = max(q.schema_tokens for q in QS.questions)
    r = runs.run(spark, path, QS, BatchAnswerer(logged(log)), str(tmp_path / "runs"), id_field="ticket_id", context_limit=int((most + 12) / 0.85) + 1)
    assert r.processed == 4 and all(1 < n <= 3 for n in paid(log).values()) and corpus.read_cells(spark, r.cells_path).count() == 12


def test_no_documents(spark, tmp_path):
    path = corpus_file(spark, tmp_path, 3)
    spark.read.parquet(path).limit(0).write.parquet(str(tmp_path / "none.parquet"))
    r = runs.run(spark, str(tmp_path / "none.parquet"), QS, HashAnswerer(), str(tmp_path / "runs"), id_field="ticket_id")
    assert (r.processed, r.cache_misses, r.exhausted, r.interrupted) == (0, 0, False, False)


def test_gate_follows_the_limit():
    limit, most, now, lock = AdaptiveLimit(2, 5, window=3), [0], [0], threading.Lock()
    gate = Gate(limit)

    def call():
        with gate:
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.01)
            with lock:
                now[0] -= 1
        gate.on_success()

    threads = [threading.Thread(target=call) for _ in range(60)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert 2 < most[0] <= 5 and limit.limit == 5
    gate.on_rate_limited()
    assert limit.limit == 2


class Service(BaseHTTPRequestHandler):
    seen: list = []
    refuse: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        type(self).seen.append((self.headers["Authorization"], body))
        if type(self).refuse:
            status = type(self).refuse.pop()
            self.send_response(status)
            self.send_header("Retry-After", "0.01")
            self.end_headers()
            return
        out = json.dumps({"model": body["model"], "usage": {"input_tokens": 7}, "answers": answerer_of()([{"id": k, **q} for k, q in body["questions"].items()])}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    Service.seen, Service.refuse = [], []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/ask"
    server.shutdown()


def test_a_service_over_http(spark, tmp_path, service, monkeypatch):
    monkeypatch.setenv("DEMO_KEY", "k1")
    Service.refuse = [429, 503, 429]
    r = runs.run(spark, corpus_file(spark, tmp_path, 8), QS, answering.http_answerer(service, "m1", "DEMO_KEY"), str(tmp_path / "runs"), id_field="ticket_id")
    assert (r.processed, r.skipped, r.tokens_charged) == (8, 0, 56) and len(Service.seen) == 11
    key, body = Service.seen[0]
    assert key == "Bearer k1" and body["model"] == "m1" and set(body["state"]) == {"body"} and body["questions"]["team"]["criteria"] == {"billing": "b", "technical": "t"} and "criteria" not in body["questions"]["urgent"]
    with pytest.raises(AnswerError) as e:
        answering.http_ask("http://127.0.0.1:9/none", "m", timeout=0.5)({}, [])
    assert e.value.failure is Failure.SERVER


def test_command_line_with_a_service(spark, tmp_path, service, capsys):
    from tallyloom import cli

    Q.dump(QS, str(tmp_path / "q.yaml"))
    base = ["--input", corpus_file(spark, tmp_path, 6), "--questions", str(tmp_path / "q.yaml"), "--id-field", "ticket_id", "--answerer", "http", "--url", service, "--model", "m2"]
    assert cli.main(["run", *base, "--out", str(tmp_path / "runs"), "--budget", "0.0000005"]) == 1 and "--resume" in capsys.readouterr().out
    assert cli.main(["tune", *base, "--variants", str(tmp_path / "q.yaml"), "--sample", "4", "--out", str(tmp_path / "tune.csv")]) == 0
    assert corpus.read_source(spark, str(tmp_path / "tune.csv.sample.parquet")).count() == 4
    rows = corpus.read_csv(spark, str(tmp_path / "tune.csv")).collect()
    assert len(rows) == 3 and all(float(r["agreement"]) == 1.0 for r in rows)
    Service.refuse = [401] * 9
    assert cli.main(["run", *base, "--out", str(tmp_path / "other")]) == 2 and "401" in capsys.readouterr().err


def test_demo(spark, tmp_path, capsys):
    from tallyloom import cli

    assert cli.main(["demo", "--out", str(tmp_path / "demo")]) == 0
    out = capsys.readouterr().out
    assert "60 documents" in out and "is_urgent" in out and "topic" in out


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(5000).selectExpr("concat('d', id) AS name").repartition(7).write.parquet(path)
    numbers = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            numbers.append({r["doc_id"]: r["row_index"] for r in corpus.normalize(corpus.read_source(spark, path), "name")[0].collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbers[0] == numbers[1] and sorted(numbers[0].values()) == list(range(5000))
    assert corpus.normalize(corpus.read_source(spark, path), "name")[0].columns == ["doc_id", "row_index", "id_source", "name"]


def test_sums_before_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(runs, "RANGE_ROWS", 10)
    rows = [(k // 2, (k * 7) % 5) for k in range(400)]
    got = runs.with_sums_before(spark.createDataFrame(rows, "at long, n long"), "n", "at", "before").collect()
    done, total = {}, 0
    for at in range(200):
        done[at] = total
        total += sum(n for a, n in rows if a == at)
    assert len(got) == 400 and all(r["before"] >= done[r["at"]] for r in got) and sum(r["before"] == done[r["at"]] for r in got) >= 200


def test_an_id_in_two_batches_is_answered_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df = spark.createDataFrame([(f"{k}", "t") for k in range(5)], "id string, body string")
    for k in range(3):
        df.withColumn("body", F.lit(f"t{k}")).coalesce(1).write.mode("append").parquet(src)
    ingest.answer_stream(spark, src, df.schema, "id", QS, HashAnswerer(), out, ck, files_per_batch=1).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 15 and got.select("doc_id", "question_id").distinct().count() == 15


def test_a_stream_of_runs_shares_cache_and_budget(spark, tmp_path):
    src, root, ck, log = (str(tmp_path / x) for x in ("in", "root", "ck", "log"))
    kind = "ticket_id string, body string"
    for rows in ([("a", "ticket number 1"), ("b", "ticket number 2")], [("b", "ticket number 3"), ("c", "ticket number 1"), ("d", "ticket number 4")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema

    def go(budget):
        ingest.run_stream(spark, src, schema, "ticket_id", QS, BatchAnswerer(logged(log, tokens=100)), root, ck, budget, files_per_batch=1).awaitTermination()

    with pytest.raises(Exception, match="before the budget was spent"):
        go(0.000005)
    go(1.0)
    spark.createDataFrame([("a", "ticket number 9"), ("e", "ticket number 2")], kind).coalesce(1).write.mode("append").parquet(src)
    go(1.0)
    cells = [r for n in files.names(root) if n.startswith("batch-") for r in corpus.read_cells(spark, f"{root}/{n}/cells").select("doc_id", "question_id").collect()]
    assert len(cells) == len(set(cells)) == 15 and {r["doc_id"] for r in cells} == {"a", "b", "c", "d", "e"}
    assert set(paid(log)) <= {"1", "2", "3", "4"} and set(paid(log).values()) == {1} and len(paid(log)) == 3
    assert runs.charged_tokens(spark, root) == 300
