"""Very long runs of white space inside texts."""

import corpus_pipeline
from test_classifier_packing_and_pipeline import assert_packed, tokenizer  # noqa: F401


def test_a_million_line_feeds_between_words_are_packed_whole(spark, tokenizer):  # noqa: F811
    n = 1_000_000
    rows = [(1, "a" + "\n" * n + "b c"), (2, "w a" + "\t\n" * (n // 2) + "b z"), (3, "x" * n + " y"), (4, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert_packed(corpus_pipeline.pack(spark, docs, "").collect(), rows, tokenizer)
