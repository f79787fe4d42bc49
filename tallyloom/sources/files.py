"""Small files and folders wherever Spark reads and writes: local disks, HDFS, object stores.

Everything goes through the Hadoop file system of the path, so a run's root may be any path that Spark takes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(path: str):
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def names(path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    fs, p = _at(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def has_rows(path: str) -> bool:
    """Whether a table was written to a folder: files or partitions that aren't hidden."""
    return any(not n.startswith(("_", ".")) for n in names(path))


def make_folder(path: str) -> None:
    fs, p = _at(path)
    fs.mkdirs(p)


def remove(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def _forget_checksum(path: str) -> None:
    """Local file systems keep a checksum beside a file; people edit these files, and then it would not fit."""
    fs, p = _at(path)
    beside = _at(f"{p.getParent()}/.{p.getName()}.crc")[1]
    if fs.exists(beside):
        fs.delete(beside, False)


def move(source: str, target: str) -> None:
    """In one step where the file system has one. The target must not exist."""
    fs, p = _at(source)
    to = _at(target)[1]
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"cannot move {source} to {target}")


def read_text(path: str) -> str | None:
    fs, p = _at(path)
    if not fs.exists(p):
        return None
    spark = SparkSession.active()
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Whole or not at all: a reader finds the old file or the new one, or for a moment none."""
    fs, p = _at(path)
    tmp = _at(f"{path}.{uuid.uuid4().hex[:8]}.tmp")[1]
    fs.mkdirs(p.getParent())
    stream = fs.create(tmp, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"cannot write {path}")
    _forget_checksum(path)


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=1, ensure_ascii=False, default=str))


def read_json(path: str):
    text = read_text(path)
    return None if text is None else json.loads(text)


def write_one(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """``df`` as one CSV file with a header. One task writes it row by row, so neither it nor the driver holds the table."""
    if exists(path):
        if not overwrite:
            raise FileExistsError(path)
        remove(path)
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    writer = df.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "")
    writer.csv(tmp)
    parts = [n for n in names(tmp) if n.startswith("part-")]
    if parts:
        move(f"{tmp}/{parts[0]}", path)
        _forget_checksum(path)
    else:  # no rows and no part: a header alone
        write_text(path, ",".join(df.columns) + "\n")
    remove(tmp)
