"""Command line: estimate, run, label, validate, report, review, tune, ablation, demo.

Exit codes: 0 done, 1 a strict question failed or documents are missing, 2 bad input, 130 interrupted.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import compare, reports, review, runs, sampling, scoring
from tallyloom.operators.answering import AnswerError, HashAnswerer, LexicalAnswerer, http_answerer
from tallyloom.plans import questions as Q
from tallyloom.sources import corpus, files


def session() -> SparkSession:
    return SparkSession.builder.appName("tallyloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _documents(spark, args):
    return corpus.normalize(corpus.read_source(spark, args.input), args.id_field)[0]


def _cells(spark, run_dir: str, **options):
    return corpus.read_cells(spark, f"{run_dir}/cells", **options)


def cmd_estimate(spark, args) -> int:
    print(reports.estimate_text(reports.estimate(_documents(spark, args), Q.load(args.questions), args.sample)))
    return 0


def _answerer(args, salt: str = ""):
    """digest: repeatable nonsense from ids, for trying things out (``salt`` makes variants differ); http: a service, which sees what is asked."""
    if args.answerer == "http":
        if not args.url:
            raise ValueError("--url is missing")
        return http_answerer(args.url, args.model or "default", args.key_env, concurrency=args.concurrency, ceiling=max(args.concurrency, args.ceiling))
    return HashAnswerer(salt=salt, **({"model": args.model} if args.model else {}))


def cmd_run(spark, args) -> int:
    r = runs.run(
        spark, args.input, Q.load(args.questions), _answerer(args), args.out, args.budget, args.limit, args.id_field, args.resume, wave_cells=args.wave_cells,
        on_progress=None if args.quiet else lambda p: print(p.line(), file=sys.stderr, flush=True),
    )
    print(f"{r.run_dir}: {r.processed} documents, {r.already_done} done before, {r.skipped} skipped, {r.quarantined} in quarantine, {r.cache_hits} hits, {r.cache_misses} misses, ${Q.micro_usd_to_usd(Q.tokens_to_micro_usd(r.tokens_charged)):.4f}")
    if r.interrupted or r.exhausted:
        print(f"{'stopped' if r.interrupted else 'the budget is spent'}; go on with: tallyloom run --input {args.input} --questions {args.questions} --out {args.out} --resume {r.run_id}" + (f" --id-field {args.id_field}" if args.id_field else ""))
    return 130 if r.interrupted else 1 if r.exhausted or r.skipped else 0


def cmd_label(spark, args) -> int:
    manifest = corpus.read_json(f"{args.run}/manifest.json")
    sample = sampling.stratified_sample(_cells(spark, args.run, question_id=args.question, chunked=args.include_chunked), args.n, args.strata, args.seed)
    pid = sample.select("projection_id").first()
    fields = manifest["projection_groups"][pid[0]] if pid else []
    docs = corpus.normalize(corpus.read_source(spark, manifest["input_path"]), manifest["id_field"])[0]
    corpus.write_csv(sampling.label_rows(sample, docs, fields), args.out, args.overwrite)
    return 0


def _scored(spark, run_dir: str, paths: list[str], target: float):
    gold = None
    for p in paths:
        g = corpus.read_labels(spark, p)
        if "question_id" not in g.columns:
            g = g.withColumn("question_id", F.lit(os.path.splitext(os.path.basename(p))[0]))
        g = g.select("doc_id", "question_id", "gold_answer", (F.col("stratum_weight") if "stratum_weight" in g.columns else F.lit(1.0)).alias("stratum_weight"))
        gold = g if gold is None else gold.unionByName(g)
    joined = sampling.gold_join(gold, _cells(spark, run_dir))
    return joined, scoring.score_questions(joined, target)


def cmd_validate(spark, args) -> int:
    joined, scored = _scored(spark, args.run, args.gold, args.target)
    gates = _cells(spark, args.run).groupBy("question_id").agg(F.first("gate").alias("gate"))
    rows = [r.asDict() for r in scoring.verdicts(scored, gates, args.floor).collect()]
    corpus.write_json(f"{args.run}/validation.json", rows)
    corpus.write_csv(scoring.reliability(joined).drop("bin"), f"{args.run}/reliability.csv", overwrite=True)
    print(reports.validation_text(rows))
    return int(any(r["verdict"] == "FAIL" for r in rows))


def cmd_report(spark, args) -> int:
    rows = corpus.read_json(f"{args.run}/validation.json") or []
    print(reports.validation_text(rows))
    return int(any(r["verdict"] == "FAIL" for r in rows))


def cmd_review_export(spark, args) -> int:
    rows = corpus.read_json(f"{args.run}/validation.json") or []
    limits = spark.createDataFrame([(r["question_id"], r["threshold"]) for r in rows], "question_id string, threshold double")
    queue = review.review_queue(_cells(spark, args.run), limits).withColumn("human_answer", F.lit(""))
    corpus.write_csv(queue, args.out, overwrite=True)
    return 0


def cmd_review_import(spark, args) -> int:
    review.append_overrides(review.overrides_from(corpus.read_csv(spark, args.file), args.reviewer, os.path.basename(args.run)), f"{args.run}/overrides")
    return 0


def _answered(spark, path: str, qs, args, root: str, salt: str = ""):
    """Cells of the documents of a Parquet table, by a run of their own unless the answerer is free."""
    if args.answerer != "http":
        return runs.cells_of(corpus.normalize(corpus.read_source(spark, path), "doc_id")[0], qs, _answerer(args, salt))
    return corpus.read_cells(spark, runs.run(spark, path, qs, _answerer(args), root, args.budget, id_field="doc_id").cells_path)


def cmd_tune(spark, args) -> int:
    """One sample, written beside the report and used for the reference and every variant."""
    reference, sample = Q.load(args.questions), f"{args.out}.sample.parquet"
    files.remove(sample)
    sampling.random_rows(_documents(spark, args), args.sample, args.seed).drop("row_index", "id_source").write.parquet(sample)
    base, out = _answered(spark, sample, reference, args, f"{args.out}.runs"), None
    for path in args.variants:
        v = Q.load(path)
        agreed = compare.agreement(base, _answered(spark, sample, v, args, f"{args.out}.runs", v.name))
        rows = compare.variant_report(agreed, v.name, reference, v)
        out = rows if out is None else out.unionByName(rows)
    corpus.write_csv(out, args.out, overwrite=True)
    return 0


def cmd_ablation(spark, args) -> int:
    qs, root = Q.load(args.questions), f"{args.gold}.runs"
    docs = _documents(spark, args)
    fields = [c for c in docs.columns if c not in ("doc_id", "row_index", "id_source")]
    wide, gold = Q.widened(qs, fields), corpus.read_labels(spark, args.gold)
    if args.answerer == "http":
        cells = [corpus.read_cells(spark, runs.run(spark, args.input, s, _answerer(args), root, args.budget, id_field=args.id_field).cells_path) for s in (qs, wide)]
    else:
        cells = [runs.cells_of(docs, s, _answerer(args, x)) for s, x in ((qs, ""), (wide, "full"))]
    compare.ablation(*(scoring.accuracy(sampling.gold_join(gold, c)) for c in cells)).show(truncate=False)
    return 0


def cmd_demo(spark, args) -> int:
    """Invented tickets, answered by their words: estimate, run, gold answers, validation."""
    import tempfile

    from tallyloom import demo

    qs, root = Q.load(demo.QUESTIONS), args.out or tempfile.mkdtemp(prefix="tallyloom-demo-")
    source = f"{root}/tickets.parquet"
    files.remove(source)
    rows = spark.createDataFrame(demo.tickets(args.tickets), "ticket_id string, subject string, body string, topic string, urgent string")
    rows.drop("topic", "urgent").write.parquet(source)
    print(reports.estimate_text(reports.estimate(corpus.normalize(corpus.read_source(spark, source), "ticket_id")[0], qs)))
    if args.dry_run:
        return 0
    r = runs.run(spark, source, qs, LexicalAnswerer(demo.WORDS, "body"), f"{root}/runs", id_field="ticket_id")
    gold = [rows.select(F.col("ticket_id").alias("doc_id"), F.lit(q).alias("question_id"), F.col(c).alias("gold_answer"), F.lit(1.0).alias("stratum_weight")) for q, c in (("is_urgent", "urgent"), ("topic", "topic"))]
    cells = corpus.read_cells(spark, r.cells_path)
    scored = scoring.score_questions(sampling.gold_join(gold[0].unionByName(gold[1]), cells), 0.9)
    print(reports.validation_text([x.asDict() for x in scoring.verdicts(scored, cells.groupBy("question_id").agg(F.first("gate").alias("gate"))).collect()]))
    print(f"everything is in {root}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name, f, *options):
        s = sub.add_parser(name)
        s.set_defaults(f=f)
        for flags, kw in options:
            s.add_argument(*flags, **kw)

    need = lambda x: ((f"--{x}",), {"required": True})
    num = lambda x, kind, default: ((f"--{x}",), {"type": kind, "default": default})
    ids = (("--id-field",), {"default": None})
    asked = ((("--answerer",), {"choices": ("digest", "http"), "default": "digest"}), num("url", str, None), num("model", str, None), num("key-env", str, None), num("concurrency", int, 4), num("ceiling", int, 16))
    verb("estimate", cmd_estimate, need("input"), need("questions"), num("sample", int, 200), ids)
    verb("run", cmd_run, need("input"), need("questions"), need("out"), num("budget", float, 1.0), num("limit", int, None), ids, (("--resume",), {"default": None}), num("wave-cells", int, runs.WAVE_CELLS), (("--quiet",), {"action": "store_true"}), *asked)
    verb("label", cmd_label, need("run"), need("question"), need("out"), num("n", int, 200), num("strata", int, 5), num("seed", int, 0), (("--include-chunked",), {"action": "store_true"}), (("--overwrite",), {"action": "store_true"}))
    verb("validate", cmd_validate, need("run"), (("--gold",), {"required": True, "nargs": "+"}), num("target", float, 0.99), num("floor", float, 0.9))
    verb("report", cmd_report, need("run"))
    verb("review-export", cmd_review_export, need("run"), need("out"))
    verb("review-import", cmd_review_import, need("run"), need("file"), need("reviewer"))
    verb("tune", cmd_tune, need("input"), need("questions"), (("--variants",), {"required": True, "nargs": "+"}), need("out"), num("sample", int, 300), num("seed", int, 0), num("budget", float, 1.0), ids, *asked)
    verb("ablation", cmd_ablation, need("input"), need("questions"), need("gold"), num("budget", float, 1.0), ids, *asked)
    verb("demo", cmd_demo, num("out", str, None), num("tickets", int, 60), (("--dry-run",), {"action": "store_true"}))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.f(session(), args)
    except KeyboardInterrupt:
        return 130
    except (Q.ConfigError, AnswerError, FileExistsError, FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
