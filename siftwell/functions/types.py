"""Column types that can be named without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

_BY_NAME = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(),
}


def of(name: str) -> T.DataType:
    """``string``, ``array<string>``, ``map<string,int>`` and the like."""
    if name.startswith("array<"):
        return T.ArrayType(of(name[6:-1]))
    if name.startswith("map<"):
        key, _, value = name[4:-1].partition(",")
        return T.MapType(of(key), of(value))
    return _BY_NAME[name]


def struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, of(v) if isinstance(v, str) else v) for k, v in fields.items()])
