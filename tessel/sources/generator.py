"""Deterministic build and probe tables from row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.mixing import hash_sql, signed_sql, unsigned_mod, with_hash, wrapping
from tessel.functions.unsigned import SPARK_TYPE, WIDTH, signed

# Fixed values of the generator.
BUILD_KEY_SALT = 0x6F1BDA28E54E2BD1
PROBE_PICK_SALT = 0xC52F01F0E0C46CD3
BUILD_PAYLOAD_SALT = 0xF3E9AA18B6517527
PROBE_PAYLOAD_SALT = 0x9E3779B97F4A7C15
COLUMN_STRIDE = 0x9DDFEA08EB382D69
HIGH_HALF = 1 << 33


def _payload_salt(seed: int, salt: int, column: int) -> int:
    return (seed ^ salt) ^ (COLUMN_STRIDE * (column + 1) & (1 << 64) - 1)


def _truncate(low: Column, kind: str) -> Column:
    if WIDTH[kind] >= 8:
        return low
    return low.bitwiseAND(F.lit((1 << 8 * WIDTH[kind]) - 1)).cast(SPARK_TYPE[kind])


def _with_payloads(df: DataFrame, kinds: list[str], prefix: str, seed: int, salt: int) -> DataFrame:
    for c, kind in enumerate(kinds):
        own, name = signed(_payload_salt(seed, salt, c)), f"{prefix}{c}"
        df = with_hash(df, F.lit(own).bitwiseXOR(F.col("i")), name)
        if kind == "u128":
            df = with_hash(df, F.lit(own).bitwiseXOR(F.col("i") + F.lit(HIGH_HALF)), "_high")
            df = df.withColumn(name, F.struct(F.col(name).alias("low"), F.col("_high").alias("high"))).drop("_high")
        else:
            df = df.withColumn(name, _truncate(F.col(name), kind))
    return df


def _with_key(df: DataFrame, number: str, seed: int) -> DataFrame:
    with wrapping(df.sparkSession):
        df = df.withColumn("_salted", F.lit(signed(seed ^ BUILD_KEY_SALT)) + F.col(number))
    return with_hash(df, "_salted", "key").drop("_salted")


def _numbers(rows: DataFrame) -> DataFrame:
    """Row numbers, null ones left out.

    The plan knows that what is computed from them isn't null either; otherwise a join would test its key for null below
    all projections, with the whole hash written out for each use.
    """
    return rows.where("i is not null").select(never_null(F.col("i").cast("long")).alias("i"))


def never_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def build_table(rows: DataFrame, kinds: list[str], seed: int = 42) -> DataFrame:
    """One build row (key, b0, b1, ...) for each row number in column i of rows; distinct numbers give distinct keys."""
    df = _with_payloads(_with_key(_numbers(rows), "i", seed), kinds, "b", seed, BUILD_PAYLOAD_SALT)
    return df.select("key", *[f"b{c}" for c in range(len(kinds))])


def probe_table(rows: DataFrame, build_rows: int, kinds: list[str], seed: int = 42) -> DataFrame:
    """One probe row (key, p0, p1, ...) for each number in column i: its key is that of a build row picked by a hash.

    Without build rows all cells are zero.
    """
    names = [f"p{c}" for c in range(len(kinds))]
    if build_rows == 0:
        zero = {"u128": F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))}
        cells = [zero.get(k, F.lit(0).cast(SPARK_TYPE[k])).alias(n) for k, n in zip(kinds, names, strict=True)]
        return rows.where("i is not null").select(F.lit(0).cast("long").alias("key"), *cells)
    df = _numbers(rows)
    with wrapping(df.sparkSession):
        df = df.withColumn("_pick", F.lit(signed(seed ^ PROBE_PICK_SALT)) + F.col("i"))
    df = with_hash(df, "_pick", "_pick")
    df = _with_key(df.withColumn("_row", never_null(unsigned_mod(F.col("_pick"), build_rows))), "_row", seed)
    return _with_payloads(df, kinds, "p", seed, PROBE_PAYLOAD_SALT).select("key", *names)


def _wrap_add(constant: int, column: str) -> str:
    return f"(({constant}::UHUGEINT + {column}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _payloads_sql(relation: str, kinds: list[str], prefix: str, seed: int, salt: int) -> tuple[str, list[str]]:
    cells = []
    for c, kind in enumerate(kinds):
        own, name = _payload_salt(seed, salt, c), f"{prefix}{c}"
        relation = hash_sql(relation, f"xor({own}::UBIGINT, i::UBIGINT)", f"u_{name}")
        if kind == "u128":
            relation = hash_sql(relation, f"xor({own}::UBIGINT, i::UBIGINT + {HIGH_HALF}::UBIGINT)", f"v_{name}")
            cells += [f"{signed_sql(f'u_{name}')} AS {name}_low", f"{signed_sql(f'v_{name}')} AS {name}_high"]
        elif kind == "u64":
            cells.append(f"{signed_sql(f'u_{name}')} AS {name}")
        else:
            integer = {"u8": "SMALLINT", "u16": "INTEGER", "u32": "BIGINT"}[kind]
            cells.append(f"(u_{name} & {(1 << 8 * WIDTH[kind]) - 1}::UBIGINT)::{integer} AS {name}")
    return relation, cells


def build_sql(rows: str, kinds: list[str], seed: int = 42) -> str:
    """DuckDB's SQL for build_table over a relation with column i; u128 columns come as two."""
    relation = hash_sql(rows, _wrap_add(seed ^ BUILD_KEY_SALT, "i"), "u_key")
    relation, cells = _payloads_sql(relation, kinds, "b", seed, BUILD_PAYLOAD_SALT)
    return f"SELECT {', '.join([f'{signed_sql("u_key")} AS key', *cells])} FROM {relation}"


def probe_sql(rows: str, build_rows: str, kinds: list[str], seed: int = 42) -> str:
    relation = hash_sql(rows, _wrap_add(seed ^ PROBE_PICK_SALT, "i"), "u_pick")
    relation = hash_sql(relation, _wrap_add(seed ^ BUILD_KEY_SALT, f"(u_pick % ({build_rows})::UBIGINT)"), "u_key")
    relation, cells = _payloads_sql(relation, kinds, "p", seed, PROBE_PAYLOAD_SALT)
    return f"SELECT {', '.join([f'{signed_sql("u_key")} AS key', *cells])} FROM {relation}"


def flat(df: DataFrame) -> DataFrame:
    """df with each pair of halves as two columns."""
    cells = []
    for name, kind in df.dtypes:
        cells += [F.col(f"{name}.{half}").alias(f"{name}_{half}") for half in ("low", "high")] if kind.startswith("struct") else [F.col(name)]
    return df.select(cells)
