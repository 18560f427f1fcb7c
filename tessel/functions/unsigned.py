"""The unsigned type system: payload type names, their Spark types, and schema text."""

from __future__ import annotations

from pyspark.sql import types as T

#: Bytes of a value by type name; keys are always u64.
WIDTH = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "u128": 16}
#: Value-preserving signed types; u64 keeps its bit pattern, u128 is a pair of such halves.
SPARK_TYPE = {
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.LongType(),
    "u128": T.StructType([T.StructField("low", T.LongType(), False), T.StructField("high", T.LongType(), False)]),
}


def parse_schema(text: str) -> list[str]:
    """'u32,u64' to type names; empty text is a table of keys only."""
    names = [x.strip() for x in text.split(",")] if text.strip() else []
    for name in names:
        if name not in WIDTH:
            raise ValueError(f"unknown payload type {name!r}; known: {', '.join(WIDTH)}")
    return names


def format_schema(names: list[str]) -> str:
    return ",".join(names) or "<none>"


def row_bytes(names: list[str]) -> int:
    """Logical bytes of a row: the key and its payloads."""
    return 8 + sum(WIDTH[n] for n in names)


def signed(value: int) -> int:
    """The signed 64-bit number with the bits of value."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value
