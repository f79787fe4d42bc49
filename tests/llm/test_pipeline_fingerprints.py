"""The fingerprints and BK-trees of the pipeline's near-dedup against brute force."""

import random
from collections import Counter

import corpus_pipeline
from common import Sets, bag, odd_docs, odd_rows
from test_overlaps import brute_kept, edited

from tallyloom.llm import overlaps
from tallyloom.llm.simhash import _hashes


def brute_fp(text):
    own = set(_hashes(text, 5, 42))
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in own) > len(own))


def near_rows():
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(300)) for _ in range(12)]
    texts = base + [edited(t, k % 4, rng) for k, t in enumerate(base)] + [edited(t, k % 5, rng) for k, t in enumerate(base)]
    return [*odd_rows(), *((100 + k, t, "", "", 0) for k, t in enumerate(texts))]


def brute_components(fps):
    fps, own = sorted(fps), Sets()
    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 4:
                own.join(a, b)
    return Counter(Counter(own.top(a) for a in fps).values())


def test_buckets_are_the_components_of_the_fingerprints(spark):
    rows = near_rows()
    sets = overlaps.set_rows(odd_docs(spark, rows), "doc_id", "text", 5).select("node", "fp").distinct()
    got = {r["node"]: r["fp"] % 2**64 for r in sets.collect()}
    assert set(got.values()) == {brute_fp(t) for _, t, *_ in rows}
    buckets = {r["node"]: r["fp"] for r in overlaps.fingerprint_buckets(sets).collect()}
    assert set(buckets) == set(got)
    label = {}
    for node, fp in got.items():
        assert label.setdefault(fp, buckets[node]) == buckets[node]
    sizes = brute_components(label)
    assert Counter(Counter(label.values()).values()) == sizes and max(sizes) > 1


def test_the_stage_searches_bk_trees_of_all_fingerprints(spark, monkeypatch):
    rows, seen, links_of = near_rows(), [], overlaps.fingerprint_links

    def spied(values, radius):
        seen.append((sorted(r["fp"] % 2**64 for r in values.collect()), radius))
        return links_of(values, radius)

    monkeypatch.setattr(overlaps, "fingerprint_links", spied)
    docs = odd_docs(spark, rows)
    assert bag(corpus_pipeline.near_dedup(spark, docs, ""), "doc_id") == Counter((i,) for i in brute_kept(rows)[0].elements())
    assert seen == [(sorted({brute_fp(t) for _, t, *_ in rows}), 4)]
