"""Regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian of the statistics: its mean and its covariance, shrunk
towards the pooled covariance and then towards a multiple of the identity. All
labelled training rows enter by sums (n, sum x, sum x x'), aggregated on the
executors; the driver sees one row per class. A score is the logistic function
of the difference of the classes' log densities and priors; the Cholesky factors
are computed once and travel with the closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import materialize

NAMES = ("words", "word_length", "length_spread", "long_words", "symbols", "capitals", "digits", "stops", "marks", "variety", "same_again", "dup_lines", "line_words")
_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate((b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?"), 1):
    _CLASS[list(_set)] = _k


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, transformed to be roughly bell-shaped; an empty text has all zero counts."""
    raw = (text or "").encode()
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    chars = max(1, int(lengths.sum()))
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 6) if raw else np.zeros(6)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    share = lambda x, of: np.log((x + 0.5) / (of + 1))
    return [
        np.log1p(len(words)),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        share(int((lengths > 12).sum()), n),
        share(kinds[1], chars),
        share(kinds[2], chars),
        share(kinds[3], chars),
        share(kinds[4], n),
        share(kinds[5], n),
        share(len(set(words)), n),
        share(sum(map(bytes.__eq__, words, words[1:])), n),
        share(len(lines) - len(set(lines)), max(1, len(lines))),
        float(np.log1p(n / max(1, len(lines)))),
    ]


def statistic_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x array<double>) for every row."""
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # inverse of the covariance's Cholesky factor
    log_density0: float  # log prior - log det / 2

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return self.log_density0 - 0.5 * (z * z).sum(axis=1)


def gaussians(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = 0.3, ridge: float = 0.05) -> dict[int, Gaussian]:
    """By class, from (n, sum of x, sum of x x'). ``pooled`` and ``ridge`` are the two shrinkage weights."""
    total = sum(n for n, _, _ in sums.values())
    scatter = {c: xx - np.outer(s, s) / n for c, (n, s, xx) in sums.items()}
    common = sum(scatter.values()) / max(1, total)
    out = {}
    for c, (n, s, _) in sums.items():
        cov = (1 - pooled) * scatter[c] / n + pooled * common
        scale = max(float(np.trace(cov)) / len(cov), 1e-6)
        low = np.linalg.cholesky((1 - ridge) * cov + ridge * scale * np.eye(len(cov)))
        out[c] = Gaussian(s / n, np.linalg.inv(low), float(np.log(n / total) - np.log(np.diag(low)).sum()))
    return out


def class_sums(rows: DataFrame, d: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Sums over ``rows(label, x)``; one row per label reaches the driver."""
    at = lambda k: F.col("x")[k]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(at(k)) for k in range(d))).alias("s"), F.array(*(F.sum(at(i) * at(j)) for i, j in pairs)).alias("xx")).collect()
    out = {}
    for r in got:
        xx = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["xx"], strict=True):
            xx[i, j] = xx[j, i] = v
        out[int(r["label"])] = (r["n"], np.array(r["s"]), xx)
    return out


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """True for rows whose label is never learnt from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **shrinkage) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``.

    Labels other than 0 and 1, null ids and repeated label rows are left out of the fit (of repeated ones the least
    label counts). Without both classes among the training rows the score is the one class's share, or 0.5 without any.
    Null texts count as empty; repeated rows are scored alike. Other columns are not read.
    """
    rows = materialize(statistic_rows(docs, id_col, text_col), "document-statistics")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    sums = class_sums(rows.join(known, "id").select("label", "x"), len(NAMES))
    fitted = gaussians(sums, **shrinkage) if len(sums) == 2 else None
    flat = 0.5 if not sums else float(1 in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(2).to_pylist(), float).reshape(-1, len(NAMES))
            if fitted:
                d = np.clip(fitted[1].log_density(x) - fitted[0].log_density(x), -700, 700)
                score = 1 / (1 + np.exp(-d))
            else:
                score = np.full(len(x), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    scored = rows.select("id", held_out(F.col("id")).alias("held_out"), "x")
    kind = rows.schema["id"].dataType.simpleString()
    return scored.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels are learnt outside the held-out fold."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
