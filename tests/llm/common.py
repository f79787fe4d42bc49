"""What the tests of the training-data operators share: odd tables and brute-force versions."""

import glob
import os
import re
from collections import Counter

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators might use themselves.
CLASH = ("id", "key", "fp", "label", "salt", "words", "votes", "kind", "g", "row", "n", "h", "no", "sha", "first", "stats", "_q_t", "_s_k", "_d_k", "_n_k")
PROSE = "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak tree near that quiet river bank every long summer evening"


def sentence(k: int, n: int = 60) -> str:
    words = PROSE.split()
    return " ".join(words[(k * 7 + i * (k % 5 + 1) + i * i // 9) % len(words)] + (str(i * k % 13) if i % 4 == k % 4 else "") for i in range(n))


def odd_rows() -> list[tuple]:
    """Null ids and texts, empty and blank texts, copies, repeated rows, one id twice, a very long text, other scripts."""
    long = " ".join(sentence(k, 50) for k in range(400))
    texts = [
        (1, sentence(1)), (2, sentence(2)), (3, None), (4, ""), (5, " \n\t "), (6, sentence(1)), (7, long), (8, "one two three"), (9, "w"), (10, sentence(3) + "\n" + sentence(3)), (10, sentence(4)),
        (None, sentence(5)), (None, None), (None, sentence(1)), (11, sentence(6)), (11, sentence(6)), (12, "ünï çödé 漢字 кот " * 30), (13, "buy now! " * 80), (14, sentence(7).upper()), (15, sentence(8) + " " + sentence(1)),
        (16, "a b c d\x85e " * 5), (17, "x" * 5000),
    ]
    return [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(texts)]


def odd_docs(spark, rows=None):
    """``odd_rows`` with extra columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def docs_at(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(df, *cols) -> Counter:
    """Rows as they occur, floats rounded."""
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in (df.select(*cols) if cols else df).collect())


def same_as_sql(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    theirs = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert bag(df, *cols) == Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in theirs)


class Sets:
    def __init__(self):
        self.up = {}

    def top(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
