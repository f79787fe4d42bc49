"""WARC archives with a two-level capture index.

Write: each task writes its records, one gzip member each, to an archive in the
shared folder. Of records with equal payloads the one of the largest id is a
response, the others are revisits that name it.

Index: captures are sorted by reversed-host URL key (range partitions), cut into
blocks of ``BLOCK`` lines and compressed; a block directory keeps each block's
first key, file, offset and length. The directory is sparse: one row for
``BLOCK`` captures. A look-up finds the block by binary search, reads that range,
and then reads the records' ranges from the archives. ``Lookup`` does so for one
url; ``look_up`` for a table of urls on the cluster: an index file holds one range
of keys, so the files' own key ranges (a row for each task that wrote the index)
come first, then the blocks of a file, then the lines of a block.

Archives and blocks are written and read by pyarrow file systems, so the shared
folder may be any that has one. A task writes under a name of its own attempt,
and only names that its committed rows carry are ever read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import materialize, shared_path

BLOCK, SALTS, LEVEL = 2000, 16, 4
#: Bytes of archives that a task reads.
READ_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``http://www.a.com:80/x?y`` gives ``com,a,www:80)/x?y``."""
    rest = (url or "").partition("://")[2] or (url or "")
    m = re.match(r"([^/?#]*)([^#]*)", rest)
    host, _, port = m[1].lower().rpartition("@")[2].partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")
    return re.sub(r"[\x00-\x20]", lambda x: f"%{ord(x[0]):02X}", key)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", "" if value is None else str(value))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member. ``refers_to``: a list with the response's id, or empty for a response."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <urn:page:{clean(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{clean(refers_to[0])}>"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if refers_to else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    plain = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(plain) + deflate.flush()


def parsed(member: bytes) -> dict:
    """Headers and payload of one gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields | {"payload": body.partition(b"\r\n\r\n")[2]}


def marked(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(id, url, html, refers): ``refers`` is null for responses, else an array with the response's id.

    Rows are numbered, so of rows that repeat id and payload one is the response.
    """
    html = F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    light = rows.filter(F.length("html") >= least_bytes).select(F.sha1("html").alias("sha"), "id", F.xxhash64("url").alias("u"))
    first = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "u"))
    shared = light.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(shared, "shared-payloads")
    if not shared.limit(1).count():
        return rows.withColumn("refers", F.lit(None).cast(f"array<{rows.schema['id'].dataType.simpleString()}>"))
    # A payload that many pages share is dealt to SALTS tasks.
    side = shared.select(F.col("sha").alias("sha2"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt2")).hint("merge")
    own = rows.withColumn("sha", F.when(F.length("html") >= least_bytes, F.sha1("html"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    both = own.join(side, (F.col("sha") == F.col("sha2")) & (F.col("salt") == F.col("salt2")), "left")
    leads = F.col("id").eqNullSafe(F.col("first.id")) & F.xxhash64("url").eqNullSafe(F.col("first.u"))
    return both.select("id", "url", "html", F.when(F.col("first").isNotNull() & ~leads, F.array("first.id")).alias("refers"), F.when(leads, F.col("first.id")).alias("lead"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row; captures (id, key, url, digest, file, offset, length) of what was written."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    rows = marked(pages, id_col, url_col, html_col, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, out, at, led = f"{uuid.uuid4().hex}.warc.gz", None, 0, set()
        try:
            for b in batches:
                got = []
                lead = b.column(4).to_pylist() if b.num_columns > 4 else [None] * b.num_rows
                for i, url, html, refers, first in zip(*(b.column(k).to_pylist() for k in range(4)), lead, strict=True):
                    if first is not None:  # rows that repeat id, url and payload share a task: the first of them leads
                        digest = payload_digest(html)
                        if (first, url, digest) in led:
                            refers = [first]
                        led.add((first, url, digest))
                    else:
                        digest = payload_digest(html)
                    if out is None:
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(i, url, html, digest, refers)
                    out.write(member)
                    got.append((url_key(url), url, digest, name, at, len(member)))
                    at += len(member)
                cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "key", "url", "digest", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    kind = rows.schema["id"].dataType.simpleString()
    captures = rows.mapInArrow(run, f"id {kind}, key string, url string, digest string, file string, offset long, length long")
    return materialize(captures.withColumn("folder", F.lit(folder)), "captures")


def write_index(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """Block directory (first_key, last_key, file, offset, length, n, record_bytes, folder), a row per block of ``block`` captures."""
    folder = shared_path(captures.sparkSession, "capture-index")
    rows = captures.select("key", F.to_json(F.struct(F.col("id").cast("string").alias("id"), "url", "digest", "folder", "file", "offset", "length")).alias("line"), F.col("length").alias("size"))
    rows = rows.repartitionByRange("key", F.xxhash64("line")).sortWithinPartitions("key", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, out, at, size, held, done = f"{uuid.uuid4().hex}.idx", None, 0, 0, [], []

        def flush() -> None:
            nonlocal out, at, size
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            data = zlib.compress("\n".join(f"{k} {x}" for k, x in held).encode(), 6)
            out.write(data)
            done.append((held[0][0], held[-1][0], name, at, len(data), len(held), size))
            at, size = at + len(data), 0
            held.clear()

        try:
            for b in batches:
                for k, line, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append((k, line))
                    size += n
                    if len(held) == block:
                        flush()
            if held:
                flush()
        finally:
            if out is not None:
                out.close()
        kinds = (pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=["first_key", "last_key", "file", "offset", "length", "n", "record_bytes"])

    found = rows.mapInArrow(run, "first_key string, last_key string, file string, offset long, length long, n long, record_bytes long")
    return materialize(found.withColumn("folder", F.lit(folder)), "block-directory")


def read_range(folder: str, name: str, offset: int, length: int) -> bytes:
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        return f.read_at(length, offset)


def block_lines(folder: str, name: str, offset: int, length: int) -> list[tuple[str, dict]]:
    text = zlib.decompress(read_range(folder, name, offset, length)).decode()
    return [(k, json.loads(line)) for k, _, line in (x.partition(" ") for x in text.split("\n"))]


class Lookup:
    """Captures by url over a block directory that the caller holds (one entry for ``BLOCK`` captures)."""

    def __init__(self, directory: list[dict]) -> None:
        self.blocks = sorted(directory, key=lambda d: (d["first_key"], d["last_key"]))
        self.firsts = [d["first_key"] for d in self.blocks]

    def captures(self, url: str) -> list[dict]:
        key, out = url_key(url), []
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.blocks) and self.blocks[k]["first_key"] <= key:
            d = self.blocks[k]
            if d["last_key"] >= key:
                lines = block_lines(d["folder"], d["file"], d["offset"], d["length"])
                keys = [x[0] for x in lines]
                out += [x for _, x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
            k += 1
        return out

    def records(self, url: str) -> list[dict]:
        return [parsed(read_range(c["folder"], c["file"], c["offset"], c["length"])) for c in self.captures(url)]


def keys_of(urls: DataFrame, url_col: str) -> DataFrame:
    """(key) for each distinct url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(F.col(f"`{url_col}`").cast("string").alias("url")).distinct().mapInArrow(run, "key string").distinct()


SPOTS = "id string, folder string, file string, offset long, length long"


def look_up(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, folder, file, offset, length) of the captures of ``keys(key)``; keys that nothing was captured of give none.

    Every block is read once, for all the keys that are looked up in it.
    """
    spans = directory.groupBy("folder", "file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
    files = sorted((r["low"], r["high"], r["folder"], r["file"]) for r in spans.collect())  # as many as tasks that wrote the index
    shared = directory.sparkSession.sparkContext.broadcast(files)

    def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = [f[0] for f in shared.value], [f[1] for f in shared.value]
        for b in batches:
            out = [(shared.value[n][3], k) for k in b.column(0).to_pylist() for n in range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.string()) for j in (0, 1)], names=["file", "key"])

    def to_blocks(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        rows = sorted(blocks.to_pylist(), key=lambda r: (r["first_key"], r["last_key"]))
        lows, highs, wanted = [r["first_key"] for r in rows], [r["last_key"] for r in rows], {}
        for k in asked.column("key").to_pylist():
            for n in range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k)):
                wanted.setdefault(n, []).append(k)
        hit = [rows[n] for n in wanted]
        columns = {c: pa.array([r[c] for r in hit], t) for c, t in (("folder", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))}
        return pa.table(columns | {"keys": pa.array(list(wanted.values()), pa.list_(pa.string()))})

    def to_captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.to_pylist():
                lines = block_lines(d["folder"], d["file"], d["offset"], d["length"])
                own = [x[0] for x in lines]
                found = [x for k in d["keys"] for _, x in lines[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]]
                cols = [pa.array([x.get(c) for x in found], t) for c, t in (("id", pa.string()), ("folder", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "folder", "file", "offset", "length"])

    asked = keys.select("key").mapInArrow(to_files, "file string, key string")
    small = directory.select("folder", "file", "offset", "length", "first_key", "last_key")
    blocks = small.groupBy("file").cogroup(asked.groupBy("file")).applyInArrow(to_blocks, "folder string, file string, offset long, length long, keys array<string>")
    return blocks.mapInArrow(to_captures, SPOTS)


def read_records(captures: DataFrame, id_type: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, payload) of ``look_up``'s captures."""
    spots = materialize(captures, "found-captures")  # small: no payloads
    total = spots.agg(F.sum("length").alias("n")).first()["n"] or 0
    # Ranges of one archive are read together and in order. The number of tasks follows the archives' bytes: the rows
    # dealt here are small, and would be coalesced into few tasks if it were left open.
    tasks = max(captures.sparkSession.sparkContext.defaultParallelism, 2 * (total // READ_BYTES + 1))
    spots = spots.withColumn("part", F.floor(F.col("offset") / (READ_BYTES // 8))).repartition(tasks, "file", "part").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, (start, data) = None, None, (0, b"")
        for b in batches:
            ids, folders, files, offsets, lengths = (b.column(k).to_pylist() for k in range(5))
            rows = []
            for i, folder, file, offset, length in zip(ids, folders, files, offsets, lengths, strict=True):
                if file != name:
                    if held is not None:
                        held.close()
                    fs, base = file_system(folder)
                    name, held, (start, data) = file, fs.open_input_file(f"{base}/{file}"), (0, b"")
                if not start <= offset <= offset + length <= start + len(data):
                    start, data = offset, held.read_at(max(length, 4 << 20), offset)
                r = parsed(data[offset - start : offset - start + length])
                refers = r.get("WARC-Refers-To")
                digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                if r["WARC-Type"] == "response" and payload_digest(r["payload"]) != digest:
                    raise ValueError(f"{file} at {offset}: the payload does not fit its digest")
                rows.append((i, int(r["X-Payload-Length"]), digest, r["WARC-Type"], (refers[10:-1] or None) if refers else None, r["payload"].decode()))
                if len(rows) == 500:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
        if held is not None:
            held.close()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    got = spots.select("id", "folder", "file", "offset", "length").mapInArrow(read, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string")
    return got.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write archives and index; (block directory, records of the pages' urls looked up in it).

    Null html is an empty payload, a null url an empty one; null ids keep their rows and lead a payload only where all
    its rows have null ids. Of rows that repeat id and payload one is the response and the others revisit its id.
    Other columns are not read. An empty table gives neither files nor records.
    """
    captures = write_archives(pages, id_col, url_col, html_col, least_bytes)
    directory = write_index(captures)
    return directory, read_records(look_up(directory, keys_of(pages, url_col)), pages.schema[id_col].dataType.simpleString())


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record as the archives hold it."""
    _, records = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of 160 bits: every five hex digits are four letters.
OP5_SQL = r"""
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
hashed AS (SELECT page_id, octet_length(p) AS payload_bytes, upper(sha1(p)) AS hex, max(page_id) OVER (PARTITION BY p) AS lead FROM payloads),
spelled AS (
  SELECT *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT) >> (15 - 5 * k)) & 31 AS INT) + 1, 1)), '')), '') AS digest FROM hashed
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM spelled
"""
