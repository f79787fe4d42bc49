"""The quadratic discriminant, packing, and the stages of the pipeline."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from common import bag, docs_at, odd_docs, odd_rows
from pyspark.sql import functions as F
from test_copies_and_leaks import grams
from test_rules_and_secrets import brute_base

from tallyloom.llm import discriminant, packing, quality, secrets


def held(i) -> bool:
    return i is None or zlib.crc32(str(i).encode()) % 3 == 1


def brute_scores(rows, labels, pooled=0.3, ridge=0.05):
    """Log densities by inverses and determinants."""
    x = {k: np.array(discriminant.statistics(t)) for k, (i, t, *_) in enumerate(rows)}
    by = {c: np.array([x[k] for k, (i, *_) in enumerate(rows) if labels.get(i) == c and not held(i)]) for c in (0, 1)}
    n = sum(map(len, by.values()))
    spread = {c: (v - v.mean(0)).T @ (v - v.mean(0)) for c, v in by.items()}
    common, log_p = sum(spread.values()) / n, {}
    for c, v in by.items():
        cov = (1 - pooled) * spread[c] / len(v) + pooled * common
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = np.array([x[k] for k in range(len(rows))]) - v.mean(0)
        log_p[c] = np.log(len(v) / n) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    return 1 / (1 + np.exp(np.clip(log_p[0] - log_p[1], -700, 700)))


def test_scores_equal_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in docs_at(spark, sf).collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in discriminant.op8_quality_classifier(spark, sf).collect()}
    assert len(got) == len(rows)
    for (i, _), s in zip(rows, brute_scores(rows, labels)):
        assert abs(got[i]["score"] - s) < 1e-6 and got[i]["held_out"] == held(i) and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = discriminant.op8_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").select("score", "quality").collect()
    assert len(got) > 50 and np.mean([(r["score"] >= 0.5) == bool(r["quality"]) for r in got]) > 0.85


def test_held_out_labels_lang_and_source_change_nothing(spark, sf):
    docs, labels = docs_at(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("quality", F.when(discriminant.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    blind = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("z"), "n_chars": F.lit(0)})
    assert bag(discriminant.classify(docs, labels)) == bag(discriminant.classify(blind, other))


def test_scores_of_odd_rows_and_few_labels(spark):
    docs = odd_docs(spark)
    kind = "doc_id long, quality int"
    train = [k for k in range(1, 18) if not held(k)]
    both = [(i, k % 2) for k, i in enumerate(train)] + [(train[0], 1), (None, 1), (train[1], None), (train[2], 7), (999, 0)]
    for labels, want in ((both, None), ([], 0.5), ([(train[0], 1)], 1.0), ([(train[0], 0)], 0.0)):
        got = discriminant.classify(docs, spark.createDataFrame(labels, kind)).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in odd_rows())
        assert all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) and (want is None or r["score"] == want) for r in got)
    assert discriminant.classify(odd_docs(spark, []), spark.createDataFrame(both, kind)).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.byte_bpe()[0])


def assert_packed(pieces, rows, tokenizer, window=1024):
    """Every document's ids come back whole from its pieces, and windows have no gaps."""
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    by_size = defaultdict(Counter)
    for (i, ids), n in want.items():
        by_size[i, len(ids)][ids] += n
    at = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    docs, now = [], []
    for r in at:
        assert (r["sequence_id"], r["offset"]) == divmod(place, window) and 0 < r["length"] <= window - r["offset"]
        place += r["length"]
        now.append(r)
        if r["start"] + r["length"] == r["doc_tokens"]:
            docs.append(now)
            now = []
    assert not now and place == sum(len(ids) * n for (_, ids), n in want.items())
    for parts in docs:
        crcs = [(p["start"], p["length"], p["ids_crc32"]) for p in parts]
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        left = by_size[parts[0]["doc_id"], parts[0]["doc_tokens"]]
        found = next(ids for ids in left if left[ids] and all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == c for a, n, c in crcs))
        left[found] -= 1
    assert not any(n for left in by_size.values() for n in left.values())


def test_odd_rows_are_packed_whole(spark, tokenizer):
    rows = [*odd_rows(), (80, "don't  stop\n\n  now\t!  ", "", "", 0), (81, "a<|endoftext|>b " * 3, "", "", 0), (82, "x\u00a0y \u00a0 z\u3000w \u2028", "", "", 0), (83, "it's 12345 won't I'LL ʼs ɐɐ", "", "", 0), (84, "\U0001f600\u200d\U0001f525 " * 9, "", "", 0)]
    assert_packed(packing.pack(odd_docs(spark, rows).repartition(3), packing.byte_bpe()).collect(), rows, tokenizer)
    assert_packed(packing.pack(odd_docs(spark, rows), packing.byte_bpe(), window=7).collect(), rows, tokenizer, 7)


def test_corpus_is_packed_whole(spark, sf, tokenizer):
    assert_packed(packing.op10_packing(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in docs_at(spark, sf).collect()], tokenizer)


def test_long_chunks_are_not_kept_in_memory(tokenizer):
    enc = packing.Encoder(*packing.byte_bpe())
    text = " ".join(f"{k:x}" * 300 for k in range(2000)) + " word" * 9 + " " + "漢字" * 5000
    assert list(np.frombuffer(enc.encode(text), "<u2")) == tokenizer.encode(text, add_special_tokens=False).ids
    assert max(map(len, enc.memo)) <= packing.MEMO_CHARS and len(enc.memo) < 9


def test_a_dotted_column_is_packed(spark, tokenizer):
    rows = [(1, "one two"), (2, None)]
    got = packing.pack(spark.createDataFrame(rows, "`doc.id` long, `a.text` string"), packing.byte_bpe(), "doc.id", "a.text")
    assert_packed(got.withColumnRenamed("doc.id", "doc_id").collect(), rows, tokenizer)


def test_nothing_to_pack(spark):
    assert packing.pack(odd_docs(spark, []), packing.byte_bpe()).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_stages_and_their_effects(spark, tokenizer):
    from test_overlaps import brute_kept

    sf = "/root/testdata/sf0.01"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "packing"]
    docs = docs_at(spark, sf)
    columns, steps = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf))
    rows = [[(r["doc_id"], r["text"]) for r in s.collect()] for s in steps[:5]]
    assert all(s.columns == columns for s in steps[:5])
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert {i for i, _ in rows[1]} == kept and not kept & {r[0] for r in brute_base(rows[0]) if r[-1]}
    assert Counter(i for i, _ in rows[2]) == brute_kept(rows[1])[0] and len(rows[2]) < len(rows[1])
    items = [grams(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items = [x for x in items if x]
    assert Counter(rows[3]) == Counter(r for r in rows[2] if not any(len(grams(r[1]) & x) >= 0.8 * len(x) for x in items))
    assert {i for i, _ in rows[4]} == {i for i, _ in rows[3]}
    assert not any(r["base"] for r in secrets.scan(steps[4]).select("base").collect())
    before = dict(rows[3])
    assert any(t != before[i] for i, t in rows[4]) and all("[secret]" in t for i, t in rows[4] if t != before[i])
    assert_packed(steps[5].collect(), rows[4], tokenizer)
    assert_packed(corpus_pipeline.run(spark, sf).collect(), rows[4], tokenizer)


def test_stages_take_odd_and_empty_tables(spark, sf):
    """Every stage on its own takes odd rows with clashing columns, and gives them back unless it packs them."""
    for rows in (odd_rows(), []):
        docs = odd_docs(spark, rows)
        ids = Counter(i for i, *_ in rows)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, sf)
            if name == "packing":
                assert {r["doc_id"] for r in got.collect()} == set(ids)
            else:
                assert got.columns == docs.columns and not Counter(r["doc_id"] for r in got.collect()) - ids
                assert all(r["votes"] == "own votes" and r["_d_k"] == "own _d_k" for r in got.collect())
            if name in ("benchmark_decontamination", "secret_scans"):  # nothing in these rows is a benchmark item
                assert Counter(r["doc_id"] for r in got.collect()) == ids
