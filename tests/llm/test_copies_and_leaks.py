"""SimHash near-duplicates and benchmark decontamination."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from common import CLASH, Sets, bag, docs_at, duck, odd_docs, odd_rows, same_as_sql, sentence, words
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, shared, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, size=4):
    ws = words((text or "").translate(LOWER))
    shingles = [" ".join(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_sets(rows, radius=4):
    """(doc_id, fingerprint) of the rows, and the fingerprints joined by comparing all pairs."""
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    sets, some = Sets(), sorted({f for _, f in fps})
    for k, a in enumerate(some):
        sets.top(a)
        for b in some[:k]:
            if (a ^ b).bit_count() <= radius:
                sets.join(a, b)
    return fps, sets


def brute_components(rows, radius=4):
    """(doc_id, fingerprint, component_id)."""
    fps, sets = brute_sets(rows, radius)
    least = {}
    for i, f in fps:
        top = sets.top(f)
        least[top] = min((x for x in (least.get(top), i) if x is not None), default=None)
    return Counter((i, f"{f:016x}", least[sets.top(f)]) for i, f in fps)


def test_components_of_odd_rows_equal_brute_force(spark):
    assert bag(simhash.near_duplicates(odd_docs(spark))) == brute_components(odd_rows())


def test_components_of_the_corpus_equal_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in docs_at(spark, sf).collect()]
    assert bag(simhash.op9_simhash_near_dedup(spark, sf)) == brute_components(rows)


def test_fingerprint_of_a_long_text_in_steps():
    text = " ".join(sentence(k, 40) for k in range(700))
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize(("cap", "blocks", "radius"), [(4096, None, 4), (5, None, 4), (3, 6, 4), (7, 8, 4), (4, 3, 2), (4096, 9, 4)])
def test_links_join_the_same_components_as_all_pairs(spark, cap, blocks, radius):
    rng = random.Random(cap)
    centres = [rng.getrandbits(64) for _ in range(25)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for c in centres for _ in range(14)} | {0, (1 << 64) - 1}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, cap, blocks).collect()
    mine, brute = Sets(), Sets()
    for r in links:
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= radius
        mine.join(r["a"], r["b"])
    for k, a in enumerate(signed):
        for b in signed[:k]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                brute.join(a, b)
    assert {v: mine.top(v) for v in signed} == {v: brute.top(v) for v in signed}


def test_a_dense_shard_is_not_compared_piece_by_piece(spark, monkeypatch):
    """400 values around one centre and a few that reach it over others only: what meets every piece is those few."""
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))) for _ in range(400)}
    far = {centre ^ (0x7F << 3), centre ^ (0x7F << 3) ^ (0xF << 20), centre ^ (0xFFF << 40)}
    values = sorted(near | far)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    asked = []
    within = simhash.links_within
    monkeypatch.setattr(simhash, "links_within", lambda pieces, radius: (asked.append(pieces.count()), within(pieces, radius))[1])
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, 20).collect()
    mine, brute = Sets(), Sets()
    for r in links:
        mine.join(r["a"], r["b"])
    for k, a in enumerate(signed):
        for b in signed[:k]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                brute.join(a, b)
    assert {v: mine.top(v) for v in signed} == {v: brute.top(v) for v in signed}
    assert sum(asked) < 6 * asked[0]


def test_bk_tree_finds_what_is_within():
    rng = random.Random(5)
    values = list({rng.getrandbits(10) for _ in range(300)})
    tree = simhash.BKTree()
    assert all(tree.add(v) for v in values) and not tree.add(values[0])
    for q in range(0, 1024, 37):
        for radius in (0, 1, 3):
            assert sorted(tree.within(q, radius)) == sorted(v for v in values if (v ^ q).bit_count() <= radius)
    assert simhash.BKTree().within(1, 64) == []


def test_components_over_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 300)]
    got = shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 150)} | {300: 300}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hub", [1_000_000, 12])
def test_one_component_of_a_third_of_all_nodes(spark, monkeypatch, hub):
    monkeypatch.setattr(shared, "HUB", hub)
    rng = random.Random(2)
    edges = [(k, rng.randrange(k)) for k in range(1, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + 2 * k, 2001 + 2 * k) for k in range(200)]
    got = {r["node"]: r["label"] for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(300)} | {k: 1000 for k in range(1000, 1200)} | {2000 + k: 2000 + k - k % 2 for k in range(400)}


def test_one_row_of_each_component_stays(spark, sf):
    docs = docs_at(spark, sf)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])}
    odd = simhash.keep_one(odd_docs(spark))
    groups = {c for _, _, c in brute_components(odd_rows())}
    fps, sets = brute_sets(odd_rows())
    assert odd.columns[5:] == list(CLASH) and all(r["_n_k"] == "own _n_k" for r in odd.collect()) and odd.count() == len({sets.top(f) for _, f in fps}) and {r["doc_id"] for r in odd.collect()} == groups
    assert simhash.keep_one(odd_docs(spark, [])).count() == 0 and simhash.near_duplicates(odd_docs(spark, [])).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------------


def brute_plain(text):
    return words(re.sub(r"[^\w\x20\x09-\x0D]|_", "", (text or "").lower()))


def grams(text, size=5):
    ws = brute_plain(text)
    return {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)}


def brute_contained(rows, items, threshold=0.8):
    out = set()
    for i, t, *_ in rows:
        own = grams(t)
        for j, text in items:
            wanted = grams(text)
            if wanted and len(own & wanted) >= threshold * len(wanted):
                out.add((i, j, len(wanted), len(own & wanted), t))
    return Counter(x[:4] for x in out)


ITEMS = [(1, "What is the capital of the land where seven wise owls watch from an old oak?"), (2, "one two three"), (3, None), (4, ""), (5, "Name five things, any five."), (6, sentence(2, 30)), (6, sentence(2, 30)), (7, sentence(9, 12)), (None, "who watches the quiet river bank at night now")]
HOSTS = [
    (50, sentence(20) + " WHAT is the capital, of the land where (seven) wise owls watch from an old oak " + sentence(21)), (51, "name five things any five!"), (52, " ".join(sentence(2, 30).split()[:28]) + " changed words"), (53, " ".join(sentence(2, 30).split()[:15])),
    (54, "so who watches the quiet river bank at night now then"), (54, "again who watches the quiet river bank at night now then"), (None, "name five things any five"),
]
PAIR = ("doc_id", "item_id", "n_shingles", "n_shared")


def host_rows():
    return [*odd_rows(), *((i, t, "en", "s", 0) for i, t in HOSTS), (None, HOSTS[-1][1], "en", "s", 0)]


def item_table(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("own") for c in ("id", "no", "n", "words", "sketch")})


@pytest.mark.parametrize("few", [True, False])
def test_pairs_of_odd_rows_equal_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert bag(decontaminate.contained(odd_docs(spark, host_rows()), item_table(spark)), *PAIR) == brute_contained(host_rows(), ITEMS)


def test_pairs_of_the_corpus_equal_sql(spark, sf):
    same_as_sql(decontaminate.op6_benchmark_decontamination(spark, sf), duck(sf), decontaminate.OP6_SQL)


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8, 1.0])
def test_no_pair_is_missed_at_any_threshold(spark, threshold):
    rng = random.Random(9)
    stock = [sentence(k, rng.randrange(5, 40)) for k in range(25)]
    docs = [(k, " ".join([" ".join(rng.choice(stock).split()[: rng.randrange(3, 40)]) for _ in range(rng.randrange(1, 6))]), "", "", 0) for k in range(60)]
    got = decontaminate.contained(odd_docs(spark, docs), item_table(spark, list(enumerate(stock))), threshold=threshold)
    assert bag(got, *PAIR) == brute_contained(docs, list(enumerate(stock)), threshold)


def test_contaminated_rows_go_and_clean_rows_stay(spark):
    got = decontaminate.drop_contaminated(odd_docs(spark, host_rows()), item_table(spark))
    bad = Counter((i, t) for i, t, *_ in host_rows() if any(grams(x) and len(grams(t) & grams(x)) >= 0.8 * len(grams(x)) for _, x in ITEMS))
    assert bag(got, "doc_id", "text") == Counter((i, t) for i, t, *_ in host_rows()) - bad
    assert got.columns == odd_docs(spark, []).columns


def test_an_empty_side_gives_no_pairs(spark):
    assert decontaminate.contained(odd_docs(spark, []), item_table(spark)).count() == 0
    assert decontaminate.contained(odd_docs(spark), item_table(spark, [])).count() == 0
    assert decontaminate.drop_contaminated(odd_docs(spark), item_table(spark, [])).count() == len(odd_rows())


def test_no_python_in_the_plan(spark, sf):
    plan = decontaminate.op6_benchmark_decontamination(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)
