"""Stupid-backoff scores of texts under a bigram model of the whole table.

score(first word) = c(w) / N
score(v, w)       = c(v w) / c(v)     if the bigram is in the model
                  = ALPHA c(w) / N    otherwise
(Brants et al. 2007). All counts are over all rows; a bigram is in the model if
``MIN_DOCS`` rows or more hold it, so no text is scored by its own oddities.

The relations are: word counts (word, c); bigrams exploded from the texts, as
(bigram, row, times); bigram counts by hash partition; their join on the bigram;
sums by row. They travel in blocks: the bigrams of about ``CHUNK`` words are
combined (a bigram's words once, then its rows and times), dealt to hash groups,
and each group counts its bigrams over all blocks, joins the counts back to its
own entries and sums by row. A word is sent as its rank if it is among the
``HOT`` most frequent (a table of bounded size that every task holds) and as its
64-bit hash otherwise. Where a score needs the count of such a colder word, the
group leaves a request, and a second join by hash group meets it with the word
counts.

The rows of a bigram that a third of all texts hold would fill one group. So the
``HEAVY`` most frequent bigrams of hot words, found in the pass that counts words,
go another way: each task sums their counts, their rows stay with their chunk, and
the counts (a table of bounded size) come to the chunks. A bigram that is not among
those occurs less than ``OFTEN`` times in every chunk, or no more often than ``HEAVY``
others, or has a word no more frequent than ``HOT`` others; each bounds its rows by a
small part of the table. Apart from ``MIN_DOCS``, which leaves a bigram of one row
out of the model however often it occurs there, no word or bigram is dropped for
being rare, frequent or many, and the scores do not depend on which way a bigram goes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import materialize
from tallyloom.llm.substrings import Memo, mixed

ALPHA, MIN_DOCS, HOT, HEAVY, OFTEN, CHUNK, GROUP = 0.4, 2, 65_000, 65_000, 4, 1_000_000, 1_500_000
COLD = 65_535
HEAD, ASKED = struct.Struct("<qIIIBBB"), "<IIBBB"


def width(x: np.ndarray) -> int:
    """Bytes of the narrowest unsigned type that holds all of ``x``."""
    most = int(x.max()) if len(x) else 0
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def chunks(batches: Iterator[pa.RecordBatch], memo: Memo) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(number, ids, word hashes, words per row) of about ``CHUNK`` words at a time."""
    k, ids, texts, held = 0, [], [], 0

    def out() -> tuple:
        words = [t.lower().split() for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        return k, ids, np.fromiter((memo[w] for ws in words for w in ws), np.uint64, int(n.sum())), n

    for b in batches:
        for lo in range(0, b.num_rows, 500):
            s = b.slice(lo, 500)
            for i, t in zip(s.column(0), s.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= 6 * CHUNK:
                    yield out()
                    k, ids, texts, held = k + 1, [], [], 0
    if ids:
        yield out()


def predecessors(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of the word before each; 0 before a text's first word."""
    before = np.empty(len(h), np.uint64)
    before[1:] = h[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    return before


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def word_counts(rows: DataFrame) -> DataFrame:
    """(v, w, c): 64-bit hash w of each word (A-Z in lower case) with its occurrences, v null; and bigrams (v, w) with
    their occurrences in the chunks that hold them ``OFTEN`` times or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for _, _, h, n in chunks(batches, memo):
            w, c = np.unique(h, return_counts=True)
            yield from made(None, w, c)
            if len(h):
                before = predecessors(h, n)
                _, at, c = np.unique(pair_hash(before, h), return_index=True, return_counts=True)
                at, c = at[c >= OFTEN], c[c >= OFTEN]
                yield from made(before[at], h[at], c)

    def made(v: np.ndarray | None, w: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(w), 100_000):
            own = slice(lo, lo + 100_000)
            first = pa.nulls(len(w[own]), pa.int64()) if v is None else pa.array(v[own].view(np.int64))
            yield pa.RecordBatch.from_arrays([first, pa.array(w[own].view(np.int64)), pa.array(c[own])], names=["v", "w", "c"])

    return rows.mapInArrow(run, "v long, w long, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """Rows of ``counts(.., c)`` from some count on: as many as there can be without being more than ``n``.

    The bound comes from a histogram of some thousand bins, so neither tasks nor driver hold more rows than are wanted.
    """
    bins = counts.groupBy(F.floor(F.log2("c") * 64).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).orderBy(F.desc("bin")).collect()
    total, bound = 0, None
    for b in bins:
        total += b["n"]
        if total > n:
            break
        bound = b["low"]
    return counts.filter(F.lit(False) if bound is None else F.col("c") >= bound)


class HotWords:
    """The most frequent words by hash, with counts."""

    def __init__(self, w: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(w)
        self.w, self.c = w[order], c[order]

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or COLD."""
        if not len(self.w):
            return np.full(len(h), COLD, np.uint16)
        at = np.minimum(np.searchsorted(self.w, h), len(self.w) - 1)
        return np.where(self.w[at] == h, at, COLD).astype(np.uint16)

    def hashes(self, ranks: np.ndarray, cold: np.ndarray) -> np.ndarray:
        out = np.empty(len(ranks), np.uint64)
        own = ranks == COLD
        out[own] = cold
        out[~own] = self.w[ranks[~own]]
        return out


class HeavyPairs:
    """Bigrams of hot words that go another way."""

    def __init__(self, first: np.ndarray, second: np.ndarray, hot: HotWords) -> None:
        pair = pair_hash(first, second)
        own = np.flatnonzero((hot.ranks(second) != COLD) & ((first == 0) | (hot.ranks(first) != COLD)))
        self.pair, at = np.unique(pair[own], return_index=True)
        self.first, self.second = first[own][at], second[own][at]

    def numbers(self, pair: np.ndarray) -> np.ndarray:
        """Place of each pair hash, or -1."""
        if not len(self.pair):
            return np.full(len(pair), -1)
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, at, -1)


def heavy_rows(row: np.ndarray, no: np.ndarray, times: np.ndarray, n_rows: int) -> bytes:
    """A chunk's entries of heavy bigrams: row by row their numbers (16 bits) and times (8 bits; more are split)."""
    by = np.argsort(row, kind="stable")
    row, no, times = row[by], no[by], times[by]
    parts = (times + 254) // 255
    t = np.full(int(parts.sum()), 255, np.uint8)
    t[np.cumsum(parts) - 1] = times - 255 * (parts - 1)
    each = np.bincount(np.repeat(row, parts), minlength=n_rows)
    return struct.pack("<II", n_rows, len(t)) + each.astype("<u4").tobytes() + np.repeat(no, parts).astype("<u2").tobytes() + t.tobytes()


def heavy_sums(blob: bytes, value: np.ndarray, back: np.ndarray) -> np.ndarray:
    """By row: sums of the entries' log scores, and how many are backed off."""
    n, m = struct.unpack_from("<II", blob)
    row = np.repeat(np.arange(n), np.frombuffer(blob, "<u4", n, 8))
    no, t = np.frombuffer(blob, "<u2", m, 8 + 4 * n), np.frombuffer(blob, np.uint8, m, 8 + 4 * n + 2 * m)
    return np.stack([np.bincount(row, x[no] * t, n) for x in (value, back)])


def encoded(uid: int, hot: HotWords, first: np.ndarray, second: np.ndarray, n_rows: np.ndarray, row: np.ndarray, times: np.ndarray) -> bytes:
    a, b = hot.ranks(first), hot.ranks(second)
    ca, cb = first[a == COLD], second[b == COLD]
    counts = [(x, width(x)) for x in (n_rows, row, times)]
    return b"".join((HEAD.pack(uid, len(first), len(row), len(ca), *(k for _, k in counts)), a.tobytes(), b.tobytes(), *(x.astype(f"<u{k}").tobytes() for x, k in counts), ca.tobytes(), cb.tobytes()))


def decoded(blob: bytes, hot: HotWords) -> tuple:
    uid, n, m, n_cold, *k = HEAD.unpack_from(blob)
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    a, b, n_rows, row, times = take("<u2", n), take("<u2", n), take(f"<u{k[0]}", n), take(f"<u{k[1]}", m), take(f"<u{k[2]}", m)
    ca, cb = take("<u8", n_cold), take("<u8", int((b == COLD).sum()))
    return uid, hot.hashes(a, ca), hot.hashes(b, cb), n_rows.astype(np.int64), row.astype(np.int64), times.astype(np.int64)


def entries(h: np.ndarray, n: np.ndarray, hot: HotWords, heavy: HeavyPairs, tally: np.ndarray, groups: int, uid: int) -> Iterator[tuple[int | None, bytes]]:
    """(group, blob) of a chunk's bigrams; the first word of a text follows the hash 0. Group None: those of heavy ones,
    whose occurrences and rows are added to ``tally``.
    """
    if not len(h):
        return
    row = np.repeat(np.arange(len(n)), n)
    before = predecessors(h, n)
    pair = pair_hash(before, h)
    order = np.lexsort((row, pair))
    p, r = pair[order], row[order]
    new = np.append(True, (p[1:] != p[:-1]) | (r[1:] != r[:-1]))
    cut = np.flatnonzero(new)
    times = np.diff(np.append(cut, len(p)))
    p, r, k = p[cut], r[cut], order[cut]
    head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    n_rows = np.diff(np.append(head, len(p)))
    no = heavy.numbers(p[head])
    if (no >= 0).any():
        own = no >= 0
        tally[0, no[own]] += np.add.reduceat(times, head)[own]
        tally[1, no[own]] += n_rows[own]
        each = np.repeat(own, n_rows)
        yield None, heavy_rows(r[each], np.repeat(no[own], n_rows[own]), times[each], len(n))
        p, r, k, times, n_rows = p[~each], r[~each], k[~each], times[~each], n_rows[~own]
        head = np.cumsum(n_rows) - n_rows
    if not len(p):
        return
    group = (p[head] % np.uint64(groups)).astype(np.int64)
    by = np.argsort(group, kind="stable")
    ends = np.cumsum(n_rows)
    moved = n_rows[by]
    to = np.repeat(ends[by] - moved - (np.cumsum(moved) - moved), moved) + np.arange(len(p))
    at = k[head[by]]
    first, second, r, times, group = before[at], h[at], r[to], times[to], group[by]
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    upto, sums = np.append(edges[1:], len(group)), np.append(0, np.cumsum(moved))
    for a, b in zip(edges.tolist(), upto.tolist(), strict=True):
        x, y = sums[a], sums[b]
        yield int(group[a]), encoded(uid, hot, first[a:b], second[a:b], moved[a:b], r[x:y], times[x:y])


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id_col, n_words, n_backoff, log_score, mean_log_score) for every row of ``docs``.

    ``log_score`` is the natural log of the product of the words' scores. Texts without words (null, empty) score 0
    with a null mean. Repeated rows count as often as they occur; null ids keep their rows; other columns are not
    read; an empty table gives none.
    """
    text = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "utf-8")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    counted_words = materialize(word_counts(rows), "word-counts")
    words = counted_words.filter("v is null").select("w", "c")
    total = words.agg(F.sum("c").alias("n")).first()["n"] or 0
    top = most_frequent(words, HOT).collect()  # HOT rows at most: which words travel as ranks, nothing else
    hot = HotWords(np.array([r["w"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64))
    groups = max(16, total // GROUP + 1)
    pairs = most_frequent(counted_words.filter("v is not null"), HEAVY).select("v", "w").collect()  # HEAVY rows, likewise
    heavy = HeavyPairs(*(np.array([r[c] for r in pairs], np.int64).view(np.uint64) for c in ("v", "w")), hot)
    n_heavy = len(heavy.pair)
    shared_hot = docs.sparkSession.sparkContext.broadcast((hot.w.tobytes(), hot.c.tobytes(), heavy.first.tobytes(), heavy.second.tobytes()))

    def table() -> HotWords:
        w, c = shared_hot.value[:2]
        return HotWords(np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, part = Memo(), table(), TaskContext.get().partitionId()
        heavies = HeavyPairs(*(np.frombuffer(x, np.uint64) for x in shared_hot.value[2:]), held)
        tally, kind_of = np.zeros((2, n_heavy), np.int64), None
        for k, ids, h, n in chunks(batches, memo):
            kind_of = batch_type(ids)
            mark = xxhash.xxh64_intdigest(h.tobytes() + n.tobytes() + struct.pack("<qq", part, k)) >> 1
            for lo in range(0, len(ids), 1000):  # kind 1: the chunk's rows
                part_ids = pa.array([i.as_py() for i in ids[lo : lo + 1000]], batch_type(ids))
                m = len(part_ids)
                yield made([mark] * m, [1] * m, list(range(lo, lo + m)), [None] * m, part_ids, n[lo : lo + m])
            out = list(entries(h, n, held, heavies, tally, groups, mark))
            for lo in range(0, len(out), 8):
                some = out[lo : lo + 8]
                m = len(some)
                yield made([mark if g is None else g for g, _ in some], [4 if g is None else 0 for g, _ in some], [0] * m, [b for _, b in some], pa.nulls(m, kind_of), np.zeros(m, np.int64))
        if tally.any():
            yield made([part % groups], [3], [0], [tallied(tally)], pa.nulls(1, kind_of), np.zeros(1, np.int64))

    def tallied(tally: np.ndarray) -> bytes:
        own = np.flatnonzero(tally[1])
        return own.astype("<i8").tobytes() + tally[:, own].astype("<i8").tobytes()

    def batch_type(ids: list) -> pa.DataType:
        return ids[0].type

    def made(g: list, kind: list, row: list, blob: list, ids: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(row, pa.int64()), pa.array(blob, pa.binary()), ids, pa.array(n, pa.int64())], names=["g", "kind", "row", "blob", "id", "n"])

    sent = rows.mapInArrow(send, f"g long, kind int, row long, blob binary, id {id_type}, n long")
    log_n, log_a = float(np.log(max(1, total))), float(np.log(alpha))

    def count(t: pa.Table) -> pa.Table:
        """A group's part of the rows' sums (kind 0), its requests by word hash (kind 2), its tasks' tallies of heavy
        bigrams (kind 3), and rows (kind 1) and their heavy bigrams (kind 4) passed on.
        """
        kinds = t.column("kind").to_numpy()
        rows_in = t.filter(pa.array((kinds == 1) | (kinds == 4)))
        out = [pa.table({"kind": rows_in["kind"], "g": rows_in["g"], "row": rows_in["row"], "id": rows_in["id"], "n": rows_in["n"], "blob": rows_in["blob"]})]
        if (kinds == 3).any():
            tally = np.zeros((2, n_heavy), np.int64)
            for b in t.filter(pa.array(kinds == 3)).column("blob").to_pylist():
                own, c2, df = np.frombuffer(b, "<i8").reshape(3, -1)
                tally[:, own] += np.stack([c2, df])
            out.append(sum_rows([0], [tallied(tally)], t, 3))
        if not (kinds == 0).any():
            return pa.concat_tables(out).select(["kind", "g", "row", "id", "n", "blob"])
        held = table()
        blobs = [decoded(b, held) for b in t.filter(pa.array(kinds == 0)).column("blob").to_pylist()]
        if blobs:
            first, second = (np.concatenate([b[k] for b in blobs]) for k in (1, 2))
            pair = pair_hash(first, second)
            n_rows = np.concatenate([b[3] for b in blobs])
            times = np.concatenate([b[5] for b in blobs])
            each = np.add.reduceat(times, np.cumsum(n_rows) - n_rows)
            order = np.argsort(pair, kind="stable")
            new = np.append(True, pair[order][1:] != pair[order][:-1])
            no = np.empty(len(pair), np.int64)
            no[order] = np.cumsum(new) - 1
            c2, df = np.bincount(no, each).astype(np.int64)[no], np.bincount(no, n_rows).astype(np.int64)[no]
            del order, new, no, pair
            start = first == 0
            hit = (df >= min_docs) & ~start
            known = np.where(hit, np.log(c2), np.where(start, -log_n, log_a - log_n))
            need = np.where(hit, first, second)  # whose count: below the line, or above it
            rank = held.ranks(need)
            warm = rank != COLD
            sign = np.where(hit, -1, 1)
            known[warm] += sign[warm] * np.log(held.c[rank[warm]])
            lo = at = 0
            some: dict[int, list] = {}
            asked: list[tuple] = []
            for uid, f, _, nr, row, tm in blobs:
                of = np.repeat(np.arange(lo, lo + len(f)), nr)
                size = int(row.max()) + 1 if len(row) else 0
                sums, backs = np.bincount(row, known[of] * tm, size), np.bincount(row, tm * ~(hit | start)[of], size)
                mine = some.setdefault(uid, [np.zeros(0), np.zeros(0)])
                for k, x in enumerate((sums, backs)):
                    if len(mine[k]) < len(x):
                        mine[k] = np.append(mine[k], np.zeros(len(x) - len(mine[k])))
                    mine[k][: len(x)] += x
                c = ~warm[of]
                if c.any():
                    asked.append((np.full(int(c.sum()), uid), need[of[c]], row[c], (sign[of] * tm)[c]))
                lo += len(f)
                at += len(row)
            uids = list(some)
            out.append(sum_rows(uids, [np.concatenate(some[u]).astype("<f8").tobytes() for u in uids], t))
            if asked:
                uid, w, row, k = (np.concatenate([a[i] for a in asked]) for i in range(4))
                g = (w % np.uint64(groups)).astype(np.int64)
                by = np.lexsort((w, g))  # equal words are neighbours, which compresses
                uid, w, row, k, g = uid[by], w[by], row[by], k[by], g[by]
                edges = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                upto = np.append(edges[1:], len(g))
                packs = []
                for a, b in zip(edges.tolist(), upto.tolist(), strict=True):
                    us, local = np.unique(uid[a:b], return_inverse=True)
                    own = [(x, width(x)) for x in (local, row[a:b], np.abs(k[a:b]) * 2 + (k[a:b] < 0))]  # the times' sign is the last bit
                    packs.append(struct.pack(ASKED, len(us), b - a, *(n for _, n in own)) + us.astype("<i8").tobytes() + w[a:b].tobytes() + b"".join(x.astype(f"<u{n}").tobytes() for x, n in own))
                m = len(packs)
                out.append(pa.table({"kind": pa.array([2] * m, pa.int32()), "g": pa.array(g[edges]), "row": pa.array([0] * m, pa.int64()), "id": pa.nulls(m, t.schema.field("id").type), "n": pa.array([0] * m, pa.int64()), "blob": pa.array(packs, pa.binary())}))
        return pa.concat_tables(out).select(["kind", "g", "row", "id", "n", "blob"])

    def sum_rows(uids: list[int], blobs: list[bytes], t: pa.Table, kind: int = 0) -> pa.Table:
        m = len(uids)
        return pa.table(
            {"kind": pa.array([kind] * m, pa.int32()), "g": pa.array(uids, pa.int64()), "row": pa.array([0] * m, pa.int64()), "id": pa.nulls(m, t.schema.field("id").type), "n": pa.array([0] * m, pa.int64()), "blob": pa.array(blobs, pa.binary())}
        )

    schema = f"kind int, g long, row long, id {id_type}, n long, blob binary"
    counted = materialize(sent.repartition(groups, "g").groupBy("g").applyInArrow(count, schema), "bigram-sums")  # a group is a task

    def answer(key, requests: pa.Table, counts: pa.Table) -> pa.Table:
        """Sums that the requests of a hash group add to the rows."""
        w = counts.column("w").to_numpy().view(np.uint64)
        order = np.argsort(w)
        w, c = w[order], np.log(counts.column("c").to_numpy()[order])
        some: dict[int, np.ndarray] = {}
        for blob in requests.column("blob").to_pylist():
            n_uids, m, *wide = struct.unpack_from(ASKED, blob)
            at = struct.calcsize(ASKED)
            parts = []
            for kind, size in (("<i8", n_uids), ("<u8", m), *((f"<u{n}", m) for n in wide)):
                parts.append(np.frombuffer(blob, kind, size, at))
                at += parts[-1].nbytes
            us, need, local, row, k = parts
            k = (k >> 1).astype(np.int64) * np.where(k & 1, -1, 1)
            value = c[np.searchsorted(w, need)] * k
            by = np.argsort(local, kind="stable")
            edge = np.searchsorted(local[by], np.arange(n_uids + 1))
            for j, u in enumerate(us.tolist()):
                x = by[edge[j] : edge[j + 1]]
                got = np.bincount(row[x].astype(np.int64), value[x])
                old = some.get(u, np.zeros(0))
                if len(old) < len(got):
                    old = np.append(old, np.zeros(len(got) - len(old)))
                old[: len(got)] += got
                some[u] = old
        return pa.table({"g": pa.array(list(some), pa.int64()), "blob": pa.array([np.concatenate((x, np.zeros(len(x)))).astype("<f8").tobytes() for x in some.values()], pa.binary())})

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(blob, "<i8").reshape(3, -1)], names=["no", "c", "df"])

    tallies = counted.filter("kind = 3").select("blob").mapInArrow(expand, "no long, c long, df long")
    value, back = np.zeros(n_heavy), np.zeros(n_heavy)
    for no, c, df in tallies.groupBy("no").agg(F.sum("c"), F.sum("df")).collect():  # n_heavy rows
        own = [hot.c[hot.ranks(x[no : no + 1])[0]] if x[no] else 0 for x in (heavy.first, heavy.second)]
        if not heavy.first[no]:
            value[no] = np.log(own[1]) - log_n
        elif df >= min_docs:
            value[no] = np.log(c) - np.log(own[0])
        else:
            value[no], back[no] = log_a + np.log(own[1]) - log_n, 1
    heavy_values = docs.sparkSession.sparkContext.broadcast((value.tobytes(), back.tobytes()))

    asked = counted.filter("kind = 2").select("g", "blob")
    keyed = words.select(F.col("w"), F.col("c"), group_of(F.col("w"), groups).alias("g"))
    answers = asked.repartition(groups, "g").groupBy("g").cogroup(keyed.repartition(groups, "g").groupBy("g")).applyInArrow(answer, "g long, blob binary")
    sums = counted.filter("kind in (0, 4)").select("kind", "g", "blob").union(answers.select(F.lit(0), "g", "blob"))

    def finish(key, parts: pa.Table, listed: pa.Table) -> pa.Table:
        """A chunk's rows with their sums."""
        row, n = listed.column("row").to_numpy(), listed.column("n").to_numpy()
        total_of = np.zeros((2, int(row.max()) + 1 if len(row) else 0))
        table_of = [np.frombuffer(x) for x in heavy_values.value]
        for kind, blob in zip(parts.column("kind").to_pylist(), parts.column("blob").to_pylist(), strict=True):
            x = heavy_sums(blob, *table_of) if kind == 4 else np.frombuffer(blob, "<f8").reshape(2, -1)
            total_of[:, : x.shape[1]] += x
        s, b = total_of[0][row], np.rint(total_of[1][row]).astype(np.int64)
        mean = pa.array(s / np.maximum(n, 1), mask=n == 0)
        return pa.table({"id": listed.column("id"), "n_words": pa.array(n), "n_backoff": pa.array(b), "log_score": pa.array(s), "mean_log_score": mean})

    listed = counted.filter("kind = 1").select("g", "row", "id", "n")
    out = sums.repartition(groups, "g").groupBy("g").cogroup(listed.repartition(groups, "g").groupBy("g")).applyInArrow(finish, f"id {id_type}, n_words long, n_backoff long, log_score double, mean_log_score double")
    return out.withColumnRenamed("id", id_col)


def group_of(w, groups: int):
    """Unsigned remainder of a 64-bit hash held in a long."""
    low = w.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(w, 32)
    return F.pmod(F.pmod(high, F.lit(groups)) * F.lit((1 << 32) % groups) + low, F.lit(groups)).cast("long")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's score; sums are rounded so that the order of addition doesn't show."""
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


OP1_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), tokens AS (SELECT doc_id, unnest(w) AS w, unnest(list_prepend('', w[:-2])) AS v, unnest(range(1, len(w) + 1)) AS k FROM texts),
ones AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
n AS (SELECT count(*) AS n FROM tokens),
twos AS (SELECT v, w, count(*) AS c FROM tokens WHERE k > 1 GROUP BY v, w HAVING count(DISTINCT doc_id) >= 2),
parts AS (
  SELECT t.doc_id, CASE WHEN b.c IS NOT NULL THEN ln(b.c) - ln(o1.c) WHEN t.k = 1 THEN ln(o2.c) - ln(n.n) ELSE ln(CAST(0.4 AS DOUBLE)) + ln(o2.c) - ln(n.n) END AS s, CASE WHEN b.c IS NULL AND t.k > 1 THEN 1 ELSE 0 END AS back
  FROM tokens t CROSS JOIN n JOIN ones o2 ON o2.w = t.w LEFT JOIN ones o1 ON o1.w = t.v LEFT JOIN twos b ON b.v = t.v AND b.w = t.w AND t.k > 1
), sums AS (SELECT doc_id, count(*) AS n_words, CAST(sum(back) AS BIGINT) AS n_backoff, sum(s) AS s FROM parts GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(s, 0.0), 4) AS log_score, round(s / n_words, 6) AS mean_log_score
FROM documents d LEFT JOIN sums USING (doc_id)
"""
