"""Near-duplicates by SimHash and by Jaccard similarity of word shingles: BK-trees, MinHash bands, exact verification, components.

1. Every text becomes the set of its distinct shingles (XXH64); equal sets are one node.
2. Each set gets a 64-bit fingerprint. BK-trees by shard link the fingerprints
   at ``RADIUS`` bits, star rounds join those links, and the sets of such a
   component are a bucket.
3. Similar sets differ in up to 14 bits and more, too many for block keys and
   trees, so there are buckets for what lies beyond the radius: ``BANDS`` keys of
   ``ROWS`` minima each. Two sets of similarity s miss each other in all bands
   with probability (1 - s^ROWS)^BANDS, 5e-8 at 0.8.
4. The sets of a bucket are compared exactly, within its pieces: a set is
   compared with a component's members until one is similar enough.
5. Buckets of several pieces that are still in several components after that
   have every pair of their pieces compared.
6. Large-star/small-star rounds join the links to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import connected_components, materialize, text_key
from tallyloom.llm.simhash import SALTS, _hashes, fingerprint_links, kept_rows, majority

RADIUS, BANDS, ROWS = 4, 32, 4
#: Sets of a bucket that are compared in one piece; it changes where pairs meet, not which.
PIECE = 256
_DRAWN = np.random.default_rng(20).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32)
_TIMES, _FLIP = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def shingle_set(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``size`` make one shingle, no words none."""
    return np.unique(np.array(_hashes(text, size, seed), np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of the set's minima."""
    low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    high = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):
        low = np.minimum(low, ((high[at : at + 1024, None] ^ _FLIP) * _TIMES).min(axis=0))
    raw, step = low.tobytes(), 4 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _node(own: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(own.tobytes(), 7)
    return h - (1 << 64) if h >= 1 << 63 else h


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``threshold`` or more; two empty sets are equal."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    if not len(a):
        return True
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def spanning_links(nodes: list[int], labels: list[int], sides: list[int], sets: list[np.ndarray], threshold: float, both: bool) -> list[tuple[int, int]]:
    """Links that join the similar sets of a piece; with ``both``, only pairs across its two sides are compared.

    Equal ``labels`` are joined already.
    """
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    links, groups = [], {}
    order = sorted(range(len(nodes)), key=lambda k: sides[k])
    for k in order:
        if not both or sides[k]:
            for other in list(groups):
                if other not in groups or other == top(labels[k]):  # joined meanwhile, or before
                    continue
                for j in groups[other]:
                    if (not both or not sides[j]) and similar(sets[j], sets[k], threshold):
                        links.append((nodes[j], nodes[k]))
                        mine = top(labels[k])
                        up[mine] = other
                        if mine in groups:
                            groups[other] += groups.pop(mine)
                        break
        groups.setdefault(top(labels[k]), []).append(k)
    return links


def set_rows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, key, node, fp, bands) for every row."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, size) for t in b.column(2).to_pylist()]
            nodes, bands = pa.array([_node(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            fps = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), nodes, fps, bands], names=["id", "key", "node", "fp", "bands"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, node long, fp long, bands array<long>")


def fingerprint_buckets(firsts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, fp): the least fingerprint of each set's component at ``radius`` bits, from ``firsts(node, fp)``."""
    links = materialize(fingerprint_links(firsts.select("fp").distinct(), radius), "fingerprint-links")
    labels = connected_components(links).select(F.col("node").alias("fp"), "label", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = firsts.select("node", "fp", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(labels, ["fp", "salt"], "left").select("node", F.coalesce("label", "fp").alias("fp"))


def wanted_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, shingles binary) of ``wanted(node, id2, key2)``."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text).alias("key"), text.alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, size).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def links_of(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) within the pieces of ``members(shard, p, q, side, node, label)``."""
    dealt = members.join(sets, "node").select("shard", "p", "q", "side", "node", "label", "shingles").repartition("shard", "p", "q").sortWithinPartitions("shard", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def linked() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                sides, nodes, labels, raw = zip(*held)
                out = spanning_links(list(nodes), list(labels), list(sides), [np.frombuffer(s, np.uint64) for s in raw], threshold, now[1] != now[2])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        for b in batches:
            for shard, p, q, *row in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if (shard, p, q) != now:
                    yield from linked()
                    now, held = (shard, p, q), []
                held.append(row)
        yield from linked()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, id_col: str, text_col: str, size: int = 5, threshold: float = 0.8, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, node), and (node, first, label) of their distinct shingle sets, as ``simhash.components``."""
    rows = materialize(set_rows(docs, id_col, text_col, size), "shingle-sets")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    firsts = materialize(rows.groupBy("node").agg(least.alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct-sets")
    near = materialize(fingerprint_buckets(firsts), "fingerprint-buckets").select("node", F.lit(BANDS).alias("band"), F.col("fp").alias("value"))
    keyed = firsts.select("node", F.posexplode("bands").alias("band", "value")).union(near).select("node", "band", F.xxhash64("band", "value").alias("shard"))
    found = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = found.filter("n > 1").groupBy("n", "x", "y").agg(F.min("shard").alias("shard"))  # buckets of the same sets are one
    buckets = buckets.select("shard", F.ceil(F.col("n") / piece).cast("int").alias("pieces"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    members = salted.join(buckets, ["shard", "salt"]).select("shard", "node", "pieces", F.pmod(F.xxhash64("node", "band"), F.col("pieces")).cast("int").alias("p"))
    members = materialize(members, "bucket-members")
    wanted = firsts.join(members.select("node").distinct(), "node").select("node", F.col("first.id").alias("id2"), F.col("first.key").alias("key2"))
    sets = materialize(wanted_sets(docs, wanted, id_col, text_col, size), "candidate-sets")
    alone = members.select("shard", "p", F.col("p").alias("q"), F.lit(0).alias("side"), "node", F.col("node").alias("label"))
    links = materialize(links_of(alone, sets, threshold), "set-links")
    labels = materialize(connected_components(links), "set-labels")
    cut = members.filter("pieces > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = cut.groupBy("shard").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cut = materialize(cut.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(open_, ["shard", "salt"]), "open-buckets")
    if cut.limit(1).count():
        every = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).filter("other <> p")
        across = every.select("shard", F.least("p", "other").alias("p"), F.greatest("p", "other").alias("q"), F.when(F.col("p") > F.col("other"), 1).otherwise(0).alias("side"), "node", "label")
        links = links.union(materialize(links_of(across, sets, threshold), "set-links"))
        labels = connected_components(links)
    return rows, materialize(firsts.select("node", "first").join(labels, "node", "left"), "labelled-sets")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with its columns: the least id's (null ids last), then the least text hash's.

    Null text counts as empty, and texts without words are copies of each other.
    """
    rows, nodes = components(docs, id_col, text_col, **options)
    kept = nodes.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("least"))
    return kept_rows(docs, rows, kept, id_col, text_col)
