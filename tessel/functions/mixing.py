"""A 64-bit finalising hash as staged columns, and what is read off it: partition ids, slots, unsigned remainders."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.unsigned import signed

# Fixed values of the hash.
ENTRY_XOR = 0x4CF5AD432745937F
MULTIPLIERS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SHIFT = 33


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Columns made inside use two's complement arithmetic that wraps around instead of raising."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _fold(name: str) -> Column:
    return F.col(name).bitwiseXOR(F.shiftrightunsigned(F.col(name), SHIFT))


def with_hash(df: DataFrame, value: Column | str, out: str) -> DataFrame:
    """df with the hash of a BIGINT column as column out.

    One projection for each step: nested in one expression, every fold would double the generated code.
    """
    value = F.col(value) if isinstance(value, str) else value
    with wrapping(df.sparkSession):
        df = df.withColumn(out, value.bitwiseXOR(F.lit(signed(ENTRY_XOR))))
        for k in MULTIPLIERS:
            df = df.withColumn(out, _fold(out) * F.lit(signed(k)))
        return df.withColumn(out, _fold(out))


def top_bits(hashed: Column, bits: int) -> Column:
    """Partition id: the highest bits of a hash, as INT."""
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def window_bits(hashed: Column, skip: int, bits: int) -> Column:
    """The bits that follow the first skip ones."""
    return F.shiftrightunsigned(hashed, 64 - skip - bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def low_bits(hashed: Column, slots: int) -> Column:
    """Slot: the lowest bits of a hash, for a power of two of slots."""
    return hashed.bitwiseAND(F.lit(slots - 1)).cast("int")


def unsigned_mod(value: Column, n: int) -> Column:
    """Remainder of the unsigned value, for 0 < n < 2**62."""
    half = F.pmod(F.shiftrightunsigned(value, 1), F.lit(n))
    return F.pmod(half * 2 + value.bitwiseAND(F.lit(1)), F.lit(n))


def hash_int(x: int) -> int:
    """The hash of one number, as a model for tests."""
    mask = (1 << 64) - 1
    x = (x ^ ENTRY_XOR) & mask
    for k in MULTIPLIERS:
        x = (x ^ x >> SHIFT) * k & mask
    return x ^ x >> SHIFT


def hash_sql(relation: str, value: str, out: str) -> str:
    """DuckDB's SQL for relation with the hash of a UBIGINT expression as UBIGINT column out, staged in the same way."""
    fold = f"xor({out}, {out} >> {SHIFT})"
    sql = f"SELECT *, xor(({value})::UBIGINT, {ENTRY_XOR}::UBIGINT) AS {out} FROM {relation}"
    for k in MULTIPLIERS:
        sql = f"SELECT * REPLACE ((({fold}::UHUGEINT * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS {out}) FROM ({sql})"
    return f"(SELECT * REPLACE ({fold} AS {out}) FROM ({sql}))"


def signed_sql(value: str) -> str:
    """DuckDB's SQL for the signed 64-bit number with the bits of a UBIGINT expression."""
    return f"(CASE WHEN {value} >= 9223372036854775808 THEN ({value}::HUGEINT - 18446744073709551616)::BIGINT ELSE {value}::BIGINT END)"
