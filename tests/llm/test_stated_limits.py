"""Limits that the README names: they hold as stated."""

import random

from common import docs_at, odd_docs
from pyspark.sql import functions as F

from tallyloom.llm import backoff, decontaminate, quality
from tallyloom.operators import chunking


def test_a_clean_document_with_one_bad_vote_stays(spark):
    docs = docs_at(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(5)) for _ in range(120)]

    def lines(width):
        return "\n".join(" ".join(words[k : k + width]) + "." for k in range(0, 120, width))

    clean, narrow = lines(30), lines(12)  # narrow: verse, whose lines are all short
    junk = "\n".join(" ".join(w + "&&&" for w in x.split()) for x in clean.split("\n"))
    more = spark.createDataFrame([(-1, clean), (-2, narrow), (-3, junk)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs.union(more)).collect()}
    assert got[-1]["votes"].count("b") == 0 and got[-1]["kept"]
    assert got[-2]["votes"].count("b") == 1 and got[-2]["votes"][-1] == "b" and got[-2]["kept"]
    assert got[-3]["votes"].count("b") > 1 and not got[-3]["base_failed"] and not got[-3]["kept"]


def test_a_bigram_of_one_document_backs_off_and_one_of_two_copies_does_not(spark):
    rows = [(1, "alpha beta " * 50, "", "", 0), (2, "gamma delta", "", "", 0), (3, "gamma delta", "", "", 0)]
    got = {r["doc_id"]: r["n_backoff"] for r in backoff.scores(odd_docs(spark, rows)).collect()}
    assert got == {1: 99, 2: 0, 3: 0}


def test_items_below_five_words_match_nothing(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, "漢字漢字漢字漢字漢字漢字"), (3, "one two three four five")], "item_id long, text string")
    docs = odd_docs(spark, [(1, "say one two three four five now", "", "", 0), (2, "漢字漢字漢字漢字漢字漢字", "", "", 0)])
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()] == [(1, 3)]


def test_chunks_of_a_text_beyond_the_range_of_the_sql(spark):
    c = spark.createDataFrame([("x" * 1_900_000,)], "text string").select(F.explode(chunking.fixed_chunks(F.col("text"), 1000, 900)).alias("c"))
    assert tuple(c.agg(F.count(F.lit(1)), F.max(F.col("c.start") + F.length("c.chunk"))).first()) == (2111, 1_900_000)
