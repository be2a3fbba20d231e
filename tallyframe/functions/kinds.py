"""Short names of Spark types, for functions that are declared before there is a session."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, INT, DOUBLE, TRUTH = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def many(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)
