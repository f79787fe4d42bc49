"""Exact removal of repeated passages by prefix-partitioned suffix trees.

The suffixes of all texts (one for each word) are split into groups by a prefix
of variable length: from the suffix's first word to the end of its anchor, the
run of ``PREFIX`` words of least hash among those its first ``window`` words
hold. Suffixes that agree in ``window`` words have the same anchor and so the
same group; the anchor depends on those words only, and neighbouring suffixes
share it. A group holds some millions of suffixes whatever the table's size, as
the number of groups follows it, and each group is a task. A first pass counts
the suffixes of every anchor; those of an anchor too large for a group (a line
that a third of all rows hold, each time between other words) get a longer
prefix: they are dealt by all their ``window`` words.

Most suffixes share ``window`` words with no other, and no deep node has them as
leaves. They are left out first: every suffix travels as a 40-bit hash with its
run's 64-bit anchor, and only those with an equal in their group are suspects
(equal passages have equal hashes, so none is lost). The suspects then travel
with their words, dealt in the same way, and each group builds the suffix array
of its leaves with the common prefix lengths of neighbours: the suffix tree in
array form. Runs of neighbours with ``window`` common words are the leaves below
its internal nodes of that depth, and consecutive leaves are maximal repeats.
Nothing is removed on a hash's word: those lengths are counted on words.

Places that agree inside one chunk of a task (about ``CHUNK`` words) are decided
there, word by word too, and one of them is sent on, so a passage that a third
of all rows hold is a few entries for each task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import materialize, text_key

PREFIX, CHUNK, GROUP, MOST_HEAVY = 8, 1_000_000, 3_000_000, 1_000_000
#: Bytes of ranges that may be broadcast to the texts instead of shuffling the texts.
BROADCAST_BYTES = 4_000_000
#: Bytes of a suffix's hash that travel.
SENT = 5
BASE = 0x9E3779B97F4A7C15


class Memo(dict):
    """Hashes of words. Emptied when full; words over 64 bytes are not kept, so it holds some tens of MB at most."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 300_000:
                self.clear()
            self[word] = h
        return h


class Numbers(dict):
    """Words by their number in order of appearance: equal numbers are equal words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each of the rising ``sizes``, the hash of every run of so many words, put together from its two halves.

    Halves are mixed at every doubling, so runs that differ by a pattern (as sums of powers may not tell apart) do too.
    """
    out, span = [], 1
    for size in sizes:
        while 2 * span <= size:
            h, span = mixed(h[:-span] * np.uint64(BASE) + h[span:]), 2 * span
        out.append(h if size == span else mixed(h[: len(h) - (size - span)] * np.uint64(BASE) + h[size - span :]))
    return out


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def suffixes(hashes: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, anchor, hash of ``window`` words) of every suffix that is long enough."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = min(PREFIX, window)
    short, whole = window_hashes(hashes, prefix, window)
    anchor = least_of(short, window - prefix + 1)
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    return at, anchor[at], whole[at]


class Chunk:
    """Some texts' words: their numbers, and the suffixes that are long enough."""

    def __init__(self, words: list[list[bytes]], window: int, hash_of=xxhash.xxh64_intdigest) -> None:
        numbers, counts = Numbers(), np.fromiter(map(len, words), np.int64, len(words))
        self.window = window
        self.ids = np.fromiter((numbers[w] for ws in words for w in ws), np.int32, int(counts.sum()))
        del words
        self.vocabulary = list(numbers)
        self.doc, self.first = np.repeat(np.arange(len(counts), dtype=np.int32), counts), np.cumsum(counts) - counts
        known = np.fromiter(map(hash_of, self.vocabulary), np.uint64, len(self.vocabulary))
        self.at, self.anchor, self.whole = suffixes(known[self.ids], self.doc, window)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows at two places have the same words."""
        out = np.ones(len(a), bool)
        for k in range(self.window):
            out &= self.ids[a + k] == self.ids[b + k]
        return out

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, new): suffixes in an order in which equal windows are neighbours; where a class begins. By words."""
        order = np.argsort(self.whole, kind="stable")
        s = self.whole[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        again = np.flatnonzero(~new)
        same = self.equal(self.at[order[again - 1]], self.at[order[again]])
        if not same.all():  # different windows of one hash
            no = np.cumsum(new) - 1
            mixed_up = np.flatnonzero(np.isin(no, no[again[~same]]))
            label = np.zeros(len(s), np.int64)
            label[mixed_up] = np.unique(self.ids[self.at[order[mixed_up]][:, None] + np.arange(self.window)], axis=0, return_inverse=True)[1].ravel()
            by = np.lexsort((label, no))
            order, no, label = order[by], no[by], label[by]
            new[1:] = (no[1:] != no[:-1]) | (label[1:] != label[:-1])
        return order, new


BLOB = struct.Struct("<IIIIB")


def packed(chunk: Chunk, keys: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray, whole: np.ndarray | None, place: np.ndarray) -> bytes:
    """Runs of suffixes of one group: their rows' keys, places and anchors, and their hashes - or, without ``whole``, the words at ``place``."""
    here, local = np.unique(doc, return_inverse=True)
    runs = (keys[here].tobytes(), anchor.astype("<u8").tobytes(), local.astype("<u4").tobytes(), start.astype("<u4").tobytes(), length.astype("<u4").tobytes())
    if whole is not None:
        return BLOB.pack(len(here), len(doc), len(whole), 0, 0) + b"".join(runs) + whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()
    span = length + chunk.window - 1
    words = np.repeat(place - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
    used, ids = np.unique(chunk.ids[words], return_inverse=True)
    spelled, wide = b" ".join(chunk.vocabulary[k] for k in used.tolist()), 1 if len(used) <= 1 << 8 else 2 if len(used) <= 1 << 16 else 4
    return BLOB.pack(len(here), len(doc), len(ids), len(spelled), wide) + b"".join(runs) + ids.astype(f"<u{wide}").tobytes() + spelled


def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """(keys, anchor, doc, start, length, hashes or word numbers, words)."""
    docs, runs, n, spelled, width = BLOB.unpack_from(blob)
    at = BLOB.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    keys, anchor = take("<i8", 2 * docs).reshape(-1, 2), take("<u8", runs)
    doc, start, length = take("<u4", runs), take("<u4", runs), take("<u4", runs)
    if spelled:
        body, words = take(f"<u{width}", n).astype(np.int64), blob[at : at + spelled].split(b" ")
    else:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :SENT] = take("u1", SENT * n).reshape(-1, SENT)
        body, words = wide.view("<u8").ravel(), []
    return keys, anchor, doc.astype(np.int64), start.astype(np.int64), length.astype(np.int64), body, words


def runs_of(at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """First index of each run of consecutive places with equal ``same``."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, texts) of about ``CHUNK`` words at a time, from batches whose last column is the text."""
    texts, keys, held = [], [], 0
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            s = b.slice(lo, 500)
            for *key, t in zip(*(c.to_pylist() for c in s.columns), strict=True):
                texts.append(t)
                keys.append(key)
                held += len(t)
                if held >= 6 * CHUNK:
                    yield keys, texts
                    texts, keys, held = [], [], 0
    if texts:
        yield keys, texts


def bucket(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64(0x7FFFFFFF)).astype(np.int32)


def heavy_anchors(rows: DataFrame, window: int) -> np.ndarray:
    """Sorted buckets of the anchors with more suffixes than a quarter of a group.

    If they are more than ``MOST_HEAVY``, those of more than that part of all their suffixes: so they are never more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            b, n = np.unique(bucket(Chunk([t.split() for t in texts], window).anchor), return_counts=True)
            for lo in range(0, len(b), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(b[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], names=["bucket", "n"])

    loads = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > GROUP // 4)
    loads = materialize(loads, "heavy-anchors")
    n, total = loads.agg(F.count(F.lit(1)), F.sum("n")).first()
    if n > MOST_HEAVY:
        loads = loads.filter(F.col("n") > total / MOST_HEAVY)
    return np.sort(np.array([r[0] for r in loads.select("bucket").collect()], np.int32))


def chunk_rows(chunk: Chunk, keys: np.ndarray, offset: np.ndarray, groups: int, heavy: np.ndarray, with_words: bool) -> Iterator[tuple[int, int, bytes]]:
    """(group, kind, blob) of one chunk: kind 0 are suffixes to compare, kind 1 ranges that are decided here.

    ``offset`` is the place of each text's first word in its row.
    """
    at, window = chunk.at, chunk.window
    if not len(at):
        return
    order, new = chunk.classes()
    again = np.zeros(len(order), bool)  # in sorted order: not alone
    again[1:] |= ~new[1:]
    again[:-1] |= ~new[1:]
    send, known = np.empty(len(order), bool), np.empty(len(order), bool)
    send[order], known[order] = new, again
    del order, new, again
    if known.any():
        k = at[known]
        cut = runs_of(k, chunk.doc[k])
        length = np.diff(np.append(cut, len(k)))
        d = chunk.doc[k[cut]]
        lo = k[cut] - chunk.first[d] + offset[d]
        rows = np.column_stack((keys[d], lo, lo + length + window - 1)).astype("<i8")
        yield int(mixed(keys[:1, 1].view(np.uint64))[0] % np.uint64(groups)), 1, rows.tobytes()
    at, anchor, whole = at[send], chunk.anchor[send], chunk.whole[send]
    deal = anchor
    if len(heavy):
        b = bucket(anchor)
        deal = np.where(heavy[np.minimum(np.searchsorted(heavy, b), len(heavy) - 1)] == b, mixed(whole), anchor)
    cut = runs_of(at, anchor, deal, chunk.doc[at])
    length = np.diff(np.append(cut, len(at)))
    d = chunk.doc[at[cut]]
    place, run_anchor = at[cut], anchor[cut]
    start = place - chunk.first[d] + offset[d]
    group = (deal[cut] % np.uint64(groups)).astype(np.int64)
    by = np.argsort(group, kind="stable")
    ends = np.cumsum(length)
    # places of the suffixes, run after run in the groups' order
    moved = length[by]
    to = np.repeat(ends[by] - moved - (np.cumsum(moved) - moved), moved) + np.arange(int(moved.sum()))
    whole, group = whole[to], group[by]
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    upto, n_before = np.append(edges[1:], len(group)), np.append(0, np.cumsum(moved))
    for a, b in zip(edges.tolist(), upto.tolist(), strict=True):
        r = by[a:b]
        yield int(group[a]), 0, packed(chunk, keys, d[r], start[r], length[r], run_anchor[r], None if with_words else whole[n_before[a] : n_before[b]], place[r])


def batches_of(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """``chunk_rows`` as record batches (g, kind, blob) of a few blobs each."""
    out = list(rows)
    for lo in range(0, len(out), 16):
        g, kind, blob = zip(*out[lo : lo + 16])
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["g", "kind", "blob"])


def deep_leaves(ids: np.ndarray, leaves: np.ndarray, window: int) -> np.ndarray:
    """Which of the suffixes that begin at ``leaves`` are below an internal node of depth ``window`` or more.

    Ranks of runs of 1, 2, 4 .. words (equal ranks are equal words) give the leaves' order and the common prefix length
    of neighbours, counted up to ``window``.
    """
    levels, now, span = [(1, ids)], ids, 1
    while 2 * span <= window:
        now = np.unique((now[:-span] << 32) | now[span:], return_inverse=True)[1].astype(np.int64)
        span *= 2
        levels.append((span, now))
    order = np.lexsort((now[leaves + window - span], now[leaves]))
    a, b = leaves[order[:-1]], leaves[order[1:]]
    depth = np.zeros(len(a), np.int64)
    for span, rank in reversed(levels):
        i, j, last = a + depth, b + depth, len(rank) - 1
        depth += span * ((depth + span <= window) & (np.maximum(i, j) <= last) & (rank[np.minimum(i, last)] == rank[np.minimum(j, last)]))
    below = np.zeros(len(leaves), bool)
    below[order[1:][depth >= window]] = True
    below[order[:-1][depth >= window]] = True
    return below


def places(part: tuple, own: np.ndarray, window: int) -> np.ndarray:
    """Rows (k1, k2, lo, hi) of the suffixes ``own`` of an unpacked blob."""
    keys, _, doc, start, length = part[:5]
    run = np.repeat(np.arange(len(length)), length)[own]
    place = (np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length))[own] + start[run]
    d = doc[run]
    cut = runs_of(place, d)
    n = np.diff(np.append(cut, len(place)))
    return np.column_stack((keys[d[cut]], place[cut], place[cut] + n + window - 1))


RANGES = "k1 long, k2 long, lo long, hi long, sure boolean"


def ranges_table(sure: list[np.ndarray], suspected: list[np.ndarray]) -> pa.Table:
    parts = [np.concatenate(x) if x else np.zeros((0, 4), np.int64) for x in (sure, suspected)]
    got = np.concatenate(parts)
    columns = {c: pa.array(np.ascontiguousarray(got[:, k])) for k, c in enumerate(("k1", "k2", "lo", "hi"))}
    return pa.table(columns | {"sure": pa.array(np.arange(len(got)) < len(parts[0]))})


def suspects(rows: DataFrame, groups: int, window: int, dealt) -> DataFrame:
    """Ranges of suffixes whose hash another one of the group has; ``sure`` those that their own chunk has decided by words."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.frombuffer(dealt.value, np.int32)
        for keys, texts in chunks(batches):
            chunk = Chunk([t.split() for t in texts], window)
            yield from batches_of(chunk_rows(chunk, np.array(keys, np.int64).reshape(-1, 2), np.zeros(len(texts), np.int64), groups, heavy, False))

    def compare(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        sure = [np.frombuffer(b, "<i8").reshape(-1, 4) for k, b in zip(kinds, blobs, strict=True) if k == 1]
        parts, out = [unpacked(b) for k, b in zip(kinds, blobs, strict=True) if k == 0], []
        del blobs
        if parts:
            both = np.concatenate([p[5] * np.uint64(BASE) + np.repeat(p[1], p[4]) for p in parts])
            order = np.argsort(both)
            s = both[order]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            del both, order, s, same
            lo = 0
            for p in parts:
                own = twice[lo : lo + len(p[5])]
                lo += len(p[5])
                if own.any():
                    out.append(places(p, own, window))
        return ranges_table(sure, out)

    return rows.mapInArrow(send, "g int, kind int, blob binary").repartitionById(groups, F.col("g")).groupBy("g").applyInArrow(compare, RANGES)


def confirmed(rows: DataFrame, side: DataFrame, groups: int, window: int, dealt) -> DataFrame:
    """Ranges of the suspected suffixes that are leaves below a node of depth ``window``, by the suffix trees of their words."""
    both = rows.join(side, ["k1", "k2"]).select("k1", "k2", "text", F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.frombuffer(dealt.value, np.int32)
        keys, offset, words, held = [], [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            return batches_of(chunk_rows(Chunk(words, window), np.array(keys, np.int64).reshape(-1, 2), np.array(offset, np.int64), groups, heavy, True))

        for b in batches:
            for at in range(0, b.num_rows, 500):
                for k1, k2, text, los, his in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True):
                    ws = text.split()
                    for lo, hi in merged(los, his, window):
                        keys.append((k1, k2))
                        offset.append(lo)
                        words.append(ws[lo:hi])
                        held += hi - lo
                    if held >= CHUNK:
                        yield from done()
                        keys, offset, words, held = [], [], [], 0
        if words:
            yield from done()

    def tree(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        sure = [np.frombuffer(b, "<i8").reshape(-1, 4) for k, b in zip(kinds, blobs, strict=True) if k == 1]
        parts = [unpacked(b) for k, b in zip(kinds, blobs, strict=True) if k == 0]
        del blobs
        if parts:
            numbers = Numbers()
            ids = np.concatenate([np.fromiter((numbers[w] for w in p[6]), np.int64, len(p[6]))[p[5]] for p in parts])
            length = np.concatenate([p[4] for p in parts])
            span = length + window - 1
            first = np.cumsum(span) - span  # of each run's words
            leaves = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            below, lo = deep_leaves(ids, leaves, window), 0
            for p in parts:
                n = int(p[4].sum())
                own = below[lo : lo + n]
                lo += n
                if own.any():
                    sure.append(places(p, own, window))
        return ranges_table(sure, [])

    return both.mapInArrow(send, "g int, kind int, blob binary").repartitionById(groups, F.col("g")).groupBy("g").applyInArrow(tree, RANGES)


def merged(los: list[int], his: list[int], window: int) -> list[tuple[int, int]]:
    """Ranges of words whose windows are exactly the windows of the given ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(los, his, strict=True)):
        if out and lo <= out[-1][1] - window + 1:  # the next window follows the last one, or is one of them
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def by_row(ranges: DataFrame, label: str) -> DataFrame:
    """(k1, k2, ranges) of distinct ranges, written; broadcast to a join where they are few, else joined by exchange."""
    own = materialize(ranges.select("k1", "k2", "lo", "hi").distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), label)
    size = own.agg(F.sum(F.size("ranges") * 16 + 32).alias("n")).first()["n"] or 0
    return F.broadcast(own) if size <= BROADCAST_BYTES else own.hint("merge")


def repeated_ranges(docs: DataFrame, id_col: str, text_col: str, window: int = 35) -> DataFrame:
    """(k1, k2, ranges): word ranges of rows that are covered by windows which start elsewhere, too.

    A row's key is the hash of its id and of its text; rows equal in both share their ranges.
    """
    text = F.col(f"`{text_col}`").cast("string")
    chars = docs.select(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{id_col}`").isNull()).alias("k1"), text_key(text).alias("k2"), F.encode(F.coalesce(text, F.lit("")), "utf-8").alias("text"))
    dealt = docs.sparkSession.sparkContext.broadcast(heavy_anchors(rows, window).tobytes())
    found = materialize(suspects(rows, max(32, chars // 6 // GROUP + 1), window, dealt), "suspected-ranges")
    n = found.filter("not sure").agg(F.sum(F.col("hi") - F.col("lo") - (window - 1)).alias("n")).first()["n"] or 0
    sure = found.filter("sure")
    if n:
        # A suspect brings some three words with it, so a group has fewer of them.
        side = by_row(found.filter("not sure"), "suspects-by-row")
        sure = sure.union(confirmed(rows, side, max(32, 4 * n // GROUP + 1), window, dealt))
    return by_row(sure, "repeated-ranges")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, kept) for every row of ``docs``.

    ``kept`` is the remaining words joined by one space. Null texts have no words; texts below ``window`` words keep
    all; of repeated rows every one loses its windows. Null ids keep their rows; other columns are not read.
    """
    side = repeated_ranges(docs, id_col, text_col, window)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{id_col}`").isNull()).alias("k1"), text_key(text).alias("k2"))
    both = rows.join(side, ["k1", "k2"], "left").select("id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"), F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n_words, n_removed, sha, kept = [], [], [], []
                for t, lo, hi in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words = t.split()
                    n, gone = len(words), 0
                    if lo:
                        left, end = [], 0
                        for x, y in sorted(zip(lo, hi, strict=True)):
                            if x > end:
                                left += words[end:x]
                            gone += max(0, y - max(x, end))
                            end = max(end, y)
                        words = left + words[end:]
                    text = b" ".join(words)
                    n_words.append(n)
                    n_removed.append(gone)
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return both.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("id", id_col)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What every document keeps when passages of 35 words that occur elsewhere go."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


OP2_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: {'k': i, 's': array_to_string(w[i:i + 34], ' ')})) AS x FROM texts WHERE len(w) >= 35
), twice AS (SELECT x.s AS s FROM windows GROUP BY x.s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, x.k + o.o AS k FROM windows JOIN twice ON x.s = twice.s CROSS JOIN range(35) AS o(o)),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS k FROM texts),
kept AS (SELECT doc_id, count(*) AS n, string_agg(words.w, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT texts.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
