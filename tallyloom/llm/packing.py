"""Concatenate and cut: token streams packed into fixed windows without search.

Pass 1 tokenizes every text once and writes its ids, with the running total
inside its partition. The partition totals (one row each) give each partition's
global base by a prefix sum; base + running total is a document's place in the
one endless stream. Pass 2 cuts the stream at multiples of the window and writes
a boundary record for each piece. Only the last window can be short.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import materialize

#: Entries of a worker's memo of encoded chunks, and characters of the longest of them: 200 MB at most with what an entry
#: costs besides. Results do not depend on it.
MEMO, MEMO_CHARS = 600_000, 48
#: Longest chunk with white space inside that the fast library gets: its split rule steps back through a run of white space,
#: and a run of a million overflows its stack, which ends the task.
FAST_CHARS = 100_000
#: Characters after which the tokenizer library gets a text's next part: it takes up to 650 bytes a character while it encodes.
PART_CHARS = 50_000
#: Where the split rule always splits, whatever comes before or after: in front of white space, and between a letter and a mark.
SPLIT = re.compile(r"\S(?=[ \t\n\r])|[\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5](?=[\u3001\u3002\uff01\uff0c\uff1f])")


def parted(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """The parts of ``text`` of about ``most`` characters that encode one by one; longer where the rule need not split."""
    at = 0
    while len(text) - at > most and (found := SPLIT.search(text, at + most)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian uint16 bytes.

    The split rule of this vocabulary never joins what a space separates, so a
    text of chunks with single spaces between them encodes chunk by chunk, and
    frequent chunks come from a memo. Chunks outside Latin script, very long ones
    with white space inside, texts with other white space next to a space, and
    texts with a special token's string go to the tokenizer library itself. The
    same merges run in either library.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        if self.full.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return b"".join(array("H", self.full.encode(t, add_special_tokens=False).ids).tobytes() for t in parted(text))

    def alone(self, text: str, key: str) -> bytes:
        latin = key.isascii() or max(key) < "ɐ"
        if not latin or (len(key) > FAST_CHARS and len(key.split(maxsplit=1)) > 1):
            return self.whole(text)
        return array("H", self.fast(text)).tobytes()

    def chunk(self, text: str, key: str) -> bytes | None:
        """None: not a chunk that stands alone."""
        if not key or key[0].isspace() or key[-1].isspace():
            return None
        got = self.alone(text, key)
        if len(key) <= MEMO_CHARS and len(self.memo) < MEMO:
            self.memo[key] = got
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        memo = self.memo
        try:
            parts = [memo[k] if k in memo else self.chunk(" " + k, k) for k in rest]
            if not first or first[0].isspace() or first[-1].isspace():
                return self.whole(text)
            return self.alone(first, first) + b"".join(parts)
        except TypeError:  # a None among the parts
            return self.whole(text)


_encoders: dict[tuple, Encoder] = {}


def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    """One encoder for a worker process, whatever the number of tasks it runs."""
    key = (json_path, ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def tokenize(docs: DataFrame, id_col: str, text_col: str, tokenizer: tuple[str, str, str], end_id: int = 0) -> DataFrame:
    """(id, part, at, n, ids): ids as uint16 bytes with the end id, and their place inside the partition."""
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    end = array("H", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, total = encoder(*tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                ids = [enc.encode(t) + end for t in s.column(1).to_pylist()]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
                at = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(at), pa.array(n), pa.array(ids, pa.binary())], names=["id", "part", "at", "n", "ids"]
                )

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, part long, at long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one end id. Repeated rows are packed as often as
    they occur; a null id keeps its row. An empty table gives no pieces.
    """
    rows = materialize(tokenize(docs, id_col, text_col, tokenizer, end_id), "token-ids")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each partition of the input: its number is bounded by the number of tasks.
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = rows.join(F.broadcast(base), "part").select("id", (F.col("base") + F.col("at")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows_of: list[int] = []
            start, length, crc, size, seq, off = [], [], [], [], [], []
            for k, (at, raw) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                wide, n, a = np.frombuffer(raw, "<u2").astype("<u4"), len(raw) // 2, 0
                while a < n:
                    o = (at + a) % window
                    c = min(n, a + window - o)
                    rows_of.append(k)
                    for col, v in ((start, a), (length, c - a), (crc, zlib.crc32(wide[a:c])), (size, n), (seq, (at + a) // window), (off, o)):
                        col.append(v)
                    a = c
            cols = [pa.array(x, pa.int64()) for x in (start, length, crc, size, seq, off)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows_of, pa.int64())), *cols], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = rows.schema["id"].dataType.simpleString()
    pieces = placed.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_col)


def byte_bpe() -> tuple[str, str, str]:
    """The public byte-level vocabulary: library file, ranks and split pattern."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces in windows of 1024."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe())
