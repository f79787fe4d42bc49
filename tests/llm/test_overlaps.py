"""Near-duplicates of the pipeline: Jaccard components against brute force."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from common import CLASH, Sets, bag, docs_at, odd_docs, odd_rows, words
from test_classifier_packing_and_pipeline import assert_packed, tokenizer  # noqa: F401
from test_copies_and_leaks import LOWER, grams

from tallyloom.llm import overlaps, quality, secrets


def brute_set(text, size=5):
    ws = words((text or "").translate(LOWER))
    return frozenset(tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))) if ws else frozenset()


def brute_kept(rows, threshold=0.8):
    """Least ids of the components of all pairs of texts at ``threshold`` or more, and how many pairs of sets there are."""
    sets = {s: k for k, s in enumerate({brute_set(t) for _, t, *_ in rows})}
    some, own, pairs = list(sets), Sets(), 0
    for k, a in enumerate(some):
        for j, b in enumerate(some[:k]):
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) * (1 + threshold) >= threshold * (len(a) + len(b)) - 1e-9:
                own.join(k, j)
                pairs += 1
    least = {}
    for i, t, *_ in rows:
        top = own.top(sets[brute_set(t)])
        least[top] = min((x for x in (least.get(top), i) if x is not None), default=None)
    return Counter(least.values()), pairs


def edited(text, n, rng):
    ws = text.split()
    for at in rng.sample(range(len(ws)), n):
        ws[at] = f"new{rng.randrange(10**6)}"
    return " ".join(ws)


def test_near_copies_of_more_than_four_bits_go(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(300)) for _ in range(30)]
    rows = [(k, t, "", "", 0) for k, t in enumerate(base)] + [(100 + k, edited(t, k % 9, rng), "", "", 0) for k, t in enumerate(base)]
    want, pairs = brute_kept(rows)
    assert pairs > 10
    docs = odd_docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    assert bag(corpus_pipeline.near_dedup(spark, docs, ""), "doc_id") == Counter((i,) for i in want.elements())


@pytest.mark.parametrize("piece", [256, 3])
def test_large_groups_in_pieces_equal_brute_force(spark, piece):
    rng = random.Random(piece)
    texts = []
    for _ in range(4):
        now = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
        for _ in range(15):
            texts.append(now := edited(now, rng.randrange(3), rng))  # chains: their ends are less alike
    rows = [(k, t, "", "", 0) for k, t in enumerate(texts)]
    assert bag(overlaps.keep_one(odd_docs(spark, rows), piece=piece), "doc_id") == Counter((i,) for i in brute_kept(rows)[0].elements())


def test_links_across_pieces_span_the_similar_sets():
    sets = [np.arange(k, k + 40, dtype=np.uint64) for k in range(0, 60, 2)]
    got = overlaps.spanning_links(list(range(30)), list(range(30)), [k % 2 for k in range(30)], sets, 0.8, True)
    assert len(got) == 29 and all(abs(a - b) == 1 for a, b in got)
    assert overlaps.spanning_links([0, 1], [5, 5], [0, 1], sets[:2], 0.8, True) == []
    assert overlaps.spanning_links([0, 1, 2], [9, 8, 8], [0, 0, 1], [sets[0], sets[20], sets[0]], 0.8, True) == [(0, 2)]


def test_odd_and_empty_tables(spark):
    got = overlaps.keep_one(odd_docs(spark))
    assert got.columns[5:] == list(CLASH) and bag(got, "doc_id") == Counter((i,) for i in brute_kept(odd_rows())[0].elements())
    assert overlaps.keep_one(odd_docs(spark, [])).count() == 0


def test_stages_with_jaccard_components(spark, tokenizer):  # noqa: F811
    sf = "/root/testdata/sf0.01"
    steps = [docs_at(spark, sf)]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf))
    rows = [[(r["doc_id"], r["text"]) for r in s.collect()] for s in steps[:5]]
    assert {i for i, _ in rows[1]} == {r["doc_id"] for r in quality.judge(steps[0]).filter("kept").collect()}
    assert Counter(i for i, _ in rows[2]) == brute_kept(rows[1])[0]
    items = [x for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (x := grams(r["text"]))]
    assert Counter(rows[3]) == Counter(r for r in rows[2] if not any(len(grams(r[1]) & x) >= 0.8 * len(x) for x in items))
    assert {i for i, _ in rows[4]} == {i for i, _ in rows[3]} and not any(r["base"] for r in secrets.scan(steps[4]).select("base").collect())
    assert_packed(steps[5].collect(), rows[4], tokenizer)
