"""Typed questions over a corpus, answered and audited as Spark tables."""
