"""SimHash near-duplicates: fingerprints, BK-trees over Hamming distance, components.

1. Every text gets a 64-bit fingerprint (word shingles, XXH64, bit majority).
2. Distinct fingerprints are keyed by block combinations: 64 bits are cut in
   ``m`` blocks; at most ``radius`` of them hold a differing bit, so two linked
   fingerprints agree in all bits of at least one choice of ``m - radius``
   blocks. One key per choice puts them in a common shard, whatever they are.
3. A shard is one BK-tree: children hang on the integer distance to their
   parent, and a search follows only edges within the radius of that distance.
   Shards above ``shard_cap`` are split into pieces that share some pivots; only
   what those leave apart from a shard's largest component meets every piece.
4. A tree emits the spanning links of what it finds, not all pairs.
5. Large-star/small-star rounds join the links to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import boxed, connected_components, materialize, text_key

SALTS, PIVOTS = 16, 16


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """Fingerprint of one text; no words give zero, fewer than ``size`` one shingle."""
    return int(_fingerprints([text], size, seed)[0])


def _hashes(text: str | None, size: int, seed: int) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of 64-bit hashes; none give zero."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):  # a very long text in steps
        part = h[at : at + 8192].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0]


def _fingerprints(texts: list[str | None], size: int, seed: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        if got := _hashes(text, size, seed):
            out[k] = majority(np.array(got, np.uint64))
    return out


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str, size: int = 4, seed: int = 42) -> DataFrame:
    """(id, key, fp long) for every row; the id keeps its type, the key tells rows of one id apart by their text."""
    text = F.col(f"`{text_col}`").cast("string")
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = _fingerprints(b.column(2).to_pylist(), size, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["id", "key", "fp"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, key long, fp long")


class BKTree:
    """Integers by Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> bool:
        """False if the value was there."""
        if self.root is None:
            self.root = (value, {})
            return True
        at = self.root
        while d := (value ^ at[0]).bit_count():
            below = at[1].get(d)
            if below is None:
                at[1][d] = (value, {})
                return True
            at = below
        return False

    def within(self, value: int, radius: int) -> list[int]:
        """All stored values at ``radius`` differing bits or fewer."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = (value ^ own).bit_count()
            if d <= radius:
                found.append(own)
            if children:
                if len(children) <= 2 * radius + 1:
                    todo.extend(c for e, c in children.items() if d - radius <= e <= d + radius)
                else:
                    todo.extend(c for e in range(d - radius, d + radius + 1) if (c := children.get(e)))
        return found


def spanning_links(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that join all values of a shard at ``radius`` or less into its components.

    With ``right``, ``left`` is the tree and ``right`` asks it, within neither side.
    """
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    links, tree = [], BKTree()
    if right is not None:
        for v in left:
            tree.add(v)
    for v in left if right is None else right:
        for w in tree.within(v, radius):
            if (a := top(v)) != (b := top(w)):
                up[a] = b
                links.append((v, w))
        if right is None:
            tree.add(v)
    return links


def blocks_for(n: int, radius: int, load: int = 16) -> int:
    """Blocks to cut 64 bits into, so that a shard of random values has ``load`` on average at most."""
    m = radius + 2
    while m < radius + 6 and n > load << (64 * (m - radius) // m):
        m += 1
    return m


def block_keys(fp: Column, m: int, radius: int) -> Column:
    """Array with a key for each choice of ``m - radius`` blocks (the choice's number is hashed in)."""
    edges = [64 * k // m for k in range(m + 1)]
    masks = []
    for kept in combinations(range(m), m - radius):
        mask = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in kept)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(x).cast("long"))) for k, x in enumerate(masks)))


def links_within(pieces: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that span the components of each piece of ``pieces(shard, fp, p, q, side)``; where ``p`` is not ``q``, those
    between its two sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def linked(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [t.column(c).to_numpy() for c in ("shard", "p", "q", "fp", "side")]
            shard, p, q, fp, side = cols
            new = np.ones(len(fp) + 1, bool)
            new[1:-1] = (shard[1:] != shard[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            cuts = np.flatnonzero(new)
            more = np.flatnonzero(np.diff(cuts) > 1)
            out: list[tuple[int, int]] = []
            for k in more.tolist():
                a, b = int(cuts[k]), int(cuts[k + 1])
                own = fp[a:b].view(np.uint64)
                if p[a] == q[a]:
                    out += spanning_links(own.tolist(), None, radius)
                else:
                    ask = side[a:b] == 1
                    out += spanning_links(own[~ask].tolist(), own[ask].tolist(), radius)
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            last = [held.column(c)[held.num_rows - 1].as_py() for c in ("shard", "p", "q")]
            same = np.ones(held.num_rows, bool)
            for c, v in zip(("shard", "p", "q"), last, strict=True):
                same &= held.column(c).to_numpy() == v
            cut = int(np.argmax(same))  # sorted: the last group is the tail
            if cut:
                yield from linked(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None:
            yield from linked(held)

    dealt = pieces.repartition("shard", "p", "q").sortWithinPartitions("shard", "p", "q")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def fingerprint_links(values: DataFrame, radius: int = 4, shard_cap: int = 4096, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct longs of ``values(fp)`` that span their components at ``radius``.

    Shards above ``shard_cap`` are cut into pieces. Each piece also gets the shard's ``PIVOTS``, so that a cluster that
    lies around them is one component over all pieces at once. Of a shard that is still several components, only the
    values outside its largest one are compared with the others, piece by piece.
    """
    m = blocks or blocks_for(values.count(), radius)
    keyed = values.select("fp", F.explode(block_keys(F.col("fp"), m, radius)).alias("shard"))
    hot = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_cap)
    hot = materialize(hot.select("shard", F.ceil(F.col("n") / shard_cap).cast("int").alias("pieces")), "hot-shards")
    n_hot = hot.count()
    alone = lambda p: (p.alias("p"), p.alias("q"), F.lit(0).alias("side"))
    if not n_hot:
        return links_within(keyed.select("shard", "fp", *alone(F.lit(0))), radius)
    marked = keyed.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "shard", "left")
    piece = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("pieces")), F.lit(0)).cast("int")
    picked = [F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias(f"v{k}") for k in range(PIVOTS)]
    pivots = marked.filter("pieces is not null").groupBy("shard").agg(F.first("pieces").alias("pieces"), *picked)
    pivots = pivots.select("shard", "pieces", F.explode(F.array_distinct(F.array(*(f"v{k}" for k in range(PIVOTS))))).alias("fp"))
    pivots = pivots.select("shard", "fp", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("k"))
    first = marked.select("shard", "fp", *alone(piece)).union(pivots.select("shard", "fp", *alone(F.col("k")))).distinct()
    links = materialize(links_within(first, radius), "shard-links")
    labels = materialize(connected_components(links), "shard-labels").withColumnRenamed("node", "fp")
    members = marked.filter("pieces is not null").select("shard", "fp", "pieces", piece.alias("mine")).join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    members = materialize(members, "hot-members")
    sizes = members.groupBy("shard", "label").agg(F.count(F.lit(1)).alias("n"))
    still = sizes.groupBy("shard").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main")).filter("all > most")
    still = materialize(still.select("shard", "main", F.ceil((F.col("all") - F.col("most")) / shard_cap).cast("int").alias("loose")), "open-shards")
    n_open = still.count()
    if not n_open:
        return links
    loose = members.join(F.broadcast(still) if n_open <= 100_000 else still, "shard").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("loose")).cast("int"))
    # The loose ones of one part meet all values of one piece: part times piece of them, never all with all.
    asks = loose.filter("label <> main").select("shard", "fp", F.col("own").alias("p"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("k"), F.lit(1).alias("side"))
    held = loose.select("shard", "fp", F.explode(F.sequence(F.lit(0), F.col("loose") - 1)).alias("p"), F.col("mine").alias("k"), F.lit(0).alias("side"))
    across = asks.union(held.select("shard", "fp", "p", "k", "side")).select("shard", "fp", "p", (-1 - F.col("k")).alias("q"), "side")
    return links.union(links_within(across, radius)).distinct()


def components(docs: DataFrame, id_col: str, text_col: str, size: int = 4, radius: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, fp), and (fp, n, first, label) of their distinct fingerprints.

    ``first`` is the least (null id, id, text key) of the fingerprint's rows; ``label`` the least fingerprint reachable.
    """
    rows = materialize(fingerprint_rows(docs, id_col, text_col, size, seed), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    firsts = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), least.alias("first")), "distinct-fingerprints")
    links = materialize(fingerprint_links(firsts.select("fp"), radius), "fingerprint-links")
    labels = connected_components(links).select(F.col("node").alias("fp"), "label")
    return rows, materialize(firsts.join(labels, "fp", "left"), "labelled-fingerprints")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links. Null text counts as
    empty (fingerprint zero, linked like any other); a null id keeps its row and
    never names a component unless all its members have null ids; repeated rows
    stay repeated. Only ``id_col`` and ``text_col`` are read.
    """
    rows, fps = components(docs, id_col, text_col, **options)
    several = fps.filter("label is not null or n > 1").withColumn("label", F.coalesce("label", "fp"))
    named = several.groupBy("label").agg(F.min("first").alias("least"))
    # Only fingerprints of several rows need a look-up; each is dealt to SALTS tasks, so a fingerprint of a third of all rows is not one task.
    found = several.join(named, "label").select("fp", F.col("least.id").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    out = salted.join(found.withColumn("found", F.lit(True)).hint("merge"), ["fp", "salt"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with its columns: the least id's (null ids last), then the least text hash's."""
    rows, fps = components(docs, id_col, text_col, **options)
    kept = fps.groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("least"))
    return kept_rows(docs, rows, kept, id_col, text_col)


def kept_rows(docs: DataFrame, rows: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``kept(least)`` names, once each; ``rows`` has their ids and keys."""
    kept = materialize(kept.select(F.col("least.id").alias("_n_id"), F.col("least.key").alias("_n_key")).distinct(), "kept-rows")
    own = lambda c: F.col("_row").getField(c)
    keyed = boxed(docs).select("_row", own(id_col).alias("_own_id"), text_key(own(text_col).cast("string")).alias("_own_key"))
    out = keyed.join(kept, F.col("_own_id").eqNullSafe(F.col("_n_id")) & (F.col("_own_key") == F.col("_n_key")), "left_semi")
    if rows.groupBy("id", "key").count().filter("count > 1").limit(1).count():  # rows that repeat both id and text
        out = out.dropDuplicates(["_own_id", "_own_key"])
    return out.select("_row.*")


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
