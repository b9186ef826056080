"""Schemas from the names of the tuple types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Tuple type names and what holds them.
TYPES = {
    "TLong": T.LongType(),
    "TString": T.StringType(),
    "TInt": T.IntegerType(),
    "TBoolean": T.BooleanType(),
    "TByte": T.ByteType(),
    "TByteArray": T.BinaryType(),
    "TIntArray": T.ArrayType(T.IntegerType()),
    "TStringArray": T.ArrayType(T.StringType()),
    "TLongArray": T.ArrayType(T.LongType()),
    "TBooleanArray": T.ArrayType(T.BooleanType()),
    "TDoubleArray": T.ArrayType(T.DoubleType()),
    "TDouble": T.DoubleType(),
}


def tuple_schema(*kinds: str, names: list[str] | None = None) -> T.StructType:
    """Fields c0, c1, ... (or names) of these types. TBag(a, b) is an array of such a struct."""
    names = names or [f"c{i}" for i in range(len(kinds))]
    if len(names) != len(kinds):
        raise ValueError("as many names as types")
    return T.StructType([T.StructField(n, _kind(k)) for n, k in zip(names, kinds)])


def _kind(kind: str) -> T.DataType:
    if kind.startswith("TBag(") and kind.endswith(")"):
        return T.ArrayType(tuple_schema(*[k.strip() for k in kind[5:-1].split(",")]))
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind}")
    return TYPES[kind]
