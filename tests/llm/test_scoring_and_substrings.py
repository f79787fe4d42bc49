"""Language-model scores and substring removal."""

import hashlib
import random
from collections import Counter
from math import log

import numpy as np
import pytest
from common import bag, docs_at, duck, odd_docs, odd_rows, same_as_sql, sentence, words

from pyspark.sql import functions as F

from tallyloom.llm import backoff, substrings


def scored(rows, alpha=0.4, min_docs=2):
    """(doc_id, n_words, n_backoff, log_score, mean) by counting in dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, words((t or "").translate(lower))) for i, t, *_ in rows]
    ones = Counter(w for _, ws in texts for w in ws)
    twos = Counter(p for _, ws in texts for p in zip(ws, ws[1:]))
    held = Counter(p for _, ws in texts for p in set(zip(ws, ws[1:])))
    n = sum(ones.values())
    out = []
    for i, ws in texts:
        s, back = 0.0, 0
        for v, w in zip([None, *ws], ws):
            if v is None:
                s += log(ones[w] / n)
            elif held[v, w] >= min_docs:
                s += log(twos[v, w] / ones[v])
            else:
                s, back = s + log(alpha * ones[w] / n), back + 1
        out.append((i, len(ws), back, round(s, 4), round(s / len(ws), 6) if ws else None))
    return Counter(out)


def rounded(df):
    return Counter((r[0], r[1], r[2], round(r[3], 4), None if r[4] is None else round(r[4], 6)) for r in df.collect())


def close(a: Counter, b: Counter) -> bool:
    key = lambda r: tuple((x is None, x or 0) for x in r)
    x, y = sorted(a.elements(), key=key), sorted(b.elements(), key=key)
    return len(x) == len(y) and all(p[:3] == q[:3] and abs(p[3] - q[3]) < 1e-3 and (p[4] == q[4] or abs(p[4] - q[4]) < 1e-4) for p, q in zip(x, y))


def test_scores_of_odd_rows_equal_brute_force(spark):
    assert close(rounded(backoff.scores(odd_docs(spark))), scored(odd_rows()))


@pytest.mark.parametrize(("hot", "heavy", "often"), [(0, 9, 1), (3, 0, 4), (40, 20, 1), (40, 1000, 2), (1000, 1000, 1)])
def test_scores_do_not_depend_on_the_way_of_words_and_bigrams(spark, monkeypatch, hot, heavy, often):
    monkeypatch.setattr(backoff, "HOT", hot)
    monkeypatch.setattr(backoff, "HEAVY", heavy)
    monkeypatch.setattr(backoff, "OFTEN", often)
    monkeypatch.setattr(backoff, "GROUP", 500)
    monkeypatch.setattr(backoff, "CHUNK", 100)
    assert close(rounded(backoff.scores(odd_docs(spark).repartition(3))), scored(odd_rows()))


def test_scores_of_the_corpus_equal_sql(spark, sf):
    same_as_sql(backoff.op1_lm_scoring(spark, sf), duck(sf), backoff.OP1_SQL)


def test_no_rows_no_scores(spark):
    assert backoff.scores(odd_docs(spark, [])).count() == 0
    only = odd_docs(spark, [(1, None, "", "", 0), (2, "", "", "", 0)])
    assert bag(backoff.scores(only)) == Counter({(1, 0, 0, 0.0, None): 1, (2, 0, 0, 0.0, None): 1})


def kept(rows, window=35):
    """(doc_id, n_words, n_removed, digest) by a dictionary of all windows."""
    texts = [(i, words(t)) for i, t, *_ in rows]
    seen = Counter(tuple(ws[k : k + window]) for _, ws in texts for k in range(len(ws) - window + 1))
    out = []
    for i, ws in texts:
        gone = set()
        for k in range(len(ws) - window + 1):
            if seen[tuple(ws[k : k + window])] > 1:
                gone.update(range(k, k + window))
        left = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return Counter(out)


RESULT = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_removal_of_odd_rows_equals_brute_force(spark):
    assert bag(substrings.without_repeats(odd_docs(spark)), *RESULT) == kept(odd_rows())


def test_kept_text_is_returned(spark):
    got = {r["doc_id"]: r["kept"] for r in substrings.without_repeats(odd_docs(spark)).collect()}
    assert got[8] == "one two three" and got[4] == got[3] == ""


def test_removal_over_the_corpus_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in docs_at(spark, sf).collect()]
    got = substrings.op2_substring_dedup(spark, sf)
    assert bag(got, *RESULT) == kept(rows)
    same_as_sql(got, duck(sf), substrings.OP2_SQL)


@pytest.mark.parametrize(("window", "chunk"), [(35, 400), (9, 200), (5, 1_000_000), (1, 300)])
def test_removal_with_small_chunks_windows_and_hot_anchors(spark, monkeypatch, window, chunk):
    rng = random.Random(window)
    stock = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    line = "this very line stands in nearly every text of the table"
    rows = [(k, " ".join(x for _ in range(rng.randrange(4)) for x in (rng.choice(stock), line, sentence(rng.randrange(50), 20))), "", "", 0) for k in range(120)]
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "GROUP", 500)
    assert bag(substrings.without_repeats(odd_docs(spark, rows).repartition(3), window=window), *RESULT) == kept(rows, window)


def test_ranges_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    assert bag(substrings.without_repeats(odd_docs(spark)), *RESULT) == kept(odd_rows())


def test_no_rows_nothing_removed(spark):
    assert substrings.without_repeats(odd_docs(spark, [])).count() == 0


def test_window_minimum():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 8, 28):
        assert substrings.least_of(x, width).tolist() == [min(x[i : i + width]) for i in range(50 - width + 1)]


def weak(word: bytes) -> int:
    """Few different hashes, so different windows share one."""
    return len(word) % 2


def test_equality_in_a_chunk_is_of_words(spark):
    rng = random.Random(8)
    lists = [[rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.randrange(30))] for _ in range(40)]
    for window in (1, 3, 5):
        chunk = substrings.Chunk(lists, window, weak)
        order, new = chunk.classes()
        text = [w for ws in lists for w in ws]
        by = {}
        for k, first in zip(order.tolist(), new.tolist()):
            by.setdefault(tuple(text[chunk.at[k] : chunk.at[k] + window]), []).append(first)
        assert sum(map(len, by.values())) == sum(max(0, len(ws) - window + 1) for ws in lists)
        assert all(x[0] and not any(x[1:]) for x in by.values())


def test_deep_leaves_equal_brute_force():
    rng = np.random.default_rng(4)
    for window in (1, 2, 3, 5, 8, 12, 35):
        ids = np.concatenate([rng.integers(0, 3, 200), np.tile(rng.integers(0, 9, 40), 3), rng.integers(0, 99, 60)])
        leaves = np.sort(rng.choice(len(ids) - window + 1, 150, replace=False))
        seen = Counter(tuple(ids[k : k + window]) for k in leaves)
        assert substrings.deep_leaves(ids, leaves, window).tolist() == [seen[tuple(ids[k : k + window])] > 1 for k in leaves]


def test_what_is_only_suspected_stays(spark):
    """Every word of every text suspected: the trees remove what brute force removes."""
    rows = [(k, " ".join(sentence(j, 20) for j in (k % 6, k % 4 + 9)), "", "", 0) for k in range(25)] + [(90, "one two " * 9, "", "", 0), (91, "one", "", "", 0)]
    docs = odd_docs(spark, rows)
    keyed = docs.select("doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("k1"), substrings.text_key(F.col("text")).alias("k2"), F.encode("text", "utf-8").alias("text"))
    side = keyed.select("k1", "k2", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(10**6).cast("long").alias("hi"))).alias("ranges"))
    dealt = spark.sparkContext.broadcast(np.zeros(0, np.int32).tobytes())
    got = substrings.confirmed(keyed.drop("doc_id"), side, 5, 9, dealt)
    gone = {}
    for r in got.join(keyed.select("doc_id", "k1", "k2"), ["k1", "k2"]).collect():
        gone.setdefault(r["doc_id"], set()).update(range(r["lo"], r["hi"]))
    assert Counter({(i, len(gone.get(i, ()))): 1 for i, *_ in rows}) == Counter({(i, n): 1 for i, _, n, _ in kept(rows, 9)})


def test_texts_of_two_words_and_of_very_long_words(spark):
    morse = ["x" if k.bit_count() % 2 else "y" for k in range(4096)]
    long = "z" * 2_000_000
    rows = [(1, " ".join(morse)), (2, " ".join("y" if w == "x" else "x" for w in morse)), (3, " ".join(morse[:70])), (4, f"{long} " + sentence(3, 50)), (5, sentence(3, 50) + f" {long}"), (6, " ".join([long] * 3))]
    rows = [(i, t, "", "", 0) for i, t in rows]
    assert bag(substrings.without_repeats(odd_docs(spark, rows)), *RESULT) == kept(rows)


def test_ranges_that_touch_are_one():
    assert substrings.merged([0, 5, 60], [40, 50, 99], 35) == [(0, 50), (60, 99)]
    assert substrings.merged([0, 6], [40, 41], 35) == [(0, 41)] and substrings.merged([0, 7], [40, 42], 35) == [(0, 40), (7, 42)]
