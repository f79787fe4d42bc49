"""Schemas from short text without a session."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def schema(text: str) -> T.StructType:
    """``name kind, name kind``; every column is nullable."""
    return T.StructType([T.StructField(name, _KINDS[kind], True) for name, kind in (x.split() for x in text.split(", "))])
