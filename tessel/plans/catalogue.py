"""Registered queries over the driver's tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.mixing import hash_sql, low_bits, signed_sql, with_hash
from tessel.operators.joins import join, sort_merge_join
from tessel.operators.partition import RadixConfig, histogram, largest, with_pid, with_pid_by_passes
from tessel.operators.verify import differences
from tessel.sources.generator import build_sql, build_table, flat, probe_sql, probe_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BUILD_KINDS, PROBE_KINDS = ["u8", "u16", "u32", "u64", "u128"], ["u128", "u64", "u32", "u16", "u8"]
#: Logical bytes of a probe row of lineitem as the join below takes it: key, 32-bit number, double.
PROBE_ROW_BYTES = 8 + 4 + 8


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        ORACLE_SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_orderstatus")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_quantity")


JOIN_SQL = "SELECT o_orderkey AS key, o_custkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def lineitem_hash_sql(out: str = "h") -> str:
    return hash_sql("lineitem", "l_orderkey", out)


@register("join_broadcast", JOIN_SQL)
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(orders(spark, sf_dir), lineitem(spark, sf_dir), "broadcast")


@register("join_radix", JOIN_SQL)
def join_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(orders(spark, sf_dir), lineitem(spark, sf_dir), "radix")


@register("join_best_effort", JOIN_SQL)
def join_best_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(orders(spark, sf_dir), lineitem(spark, sf_dir), "best_effort", probe_row_bytes=PROBE_ROW_BYTES, budget_bytes=32 << 20)


@register("join_sort_merge", JOIN_SQL)
def join_sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(orders(spark, sf_dir), lineitem(spark, sf_dir), "sort_merge")


@register("slot_histogram", f"SELECT (h & 7)::INTEGER AS slot, count(*) AS n FROM {lineitem_hash_sql()} GROUP BY 1")
def slot_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = with_hash(lineitem(spark, sf_dir), "key", "h")
    return hashed.groupBy(low_bits(F.col("h"), 8).alias("slot")).agg(F.count("*").alias("n"))


@register("hash64_keys", f"SELECT DISTINCT l_orderkey AS key, {signed_sql('h')} AS h FROM {lineitem_hash_sql()}")
def hash64_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hash(lineitem(spark, sf_dir).select("key").distinct(), "key", "h")


@register("radix_histogram", f"SELECT (h >> 56)::INTEGER AS pid, count(*) AS n FROM {lineitem_hash_sql()} GROUP BY 1")
def radix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lineitem(spark, sf_dir), RadixConfig((8,)))


@register("radix_multipass", f"SELECT (h >> 54)::INTEGER AS pid, count(*) AS n FROM {lineitem_hash_sql()} GROUP BY 1")
def radix_multipass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pid_by_passes(lineitem(spark, sf_dir), RadixConfig((6, 4))).groupBy("pid").agg(F.count("*").alias("n"))


@register("radix_largest_bucket", f"SELECT (h >> 56)::INTEGER AS pid, count(*) AS n FROM {lineitem_hash_sql()} GROUP BY 1 ORDER BY n DESC, pid LIMIT 1")
def radix_largest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest(histogram(lineitem(spark, sf_dir), RadixConfig((8,))))


@register("join_multi_match", "SELECT user_id AS key, event_id, event_type, o_orderkey FROM events JOIN orders ON user_id = o_custkey")
def join_multi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "event_type")
    probe = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return join(build, probe, "best_effort", probe_row_bytes=16, budget_bytes=32 << 20)


@register("join_key_only", "SELECT o_orderkey AS key FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_key_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(orders(spark, sf_dir).select("key"), lineitem(spark, sf_dir).select("key"), "radix")


@register("join_projection", "SELECT o_orderkey AS key, o_orderstatus, o_custkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = orders(spark, sf_dir).select("key", "o_orderstatus", "o_custkey")
    return join(build, lineitem(spark, sf_dir).select("key", "l_quantity"), "radix")


ORDER_ROWS, EVENT_ROWS = "(SELECT o_orderkey AS i FROM orders)", "(SELECT event_id AS i FROM events)"
COUNT_ORDERS = "SELECT count(*) FROM orders"


def derived_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_table(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")), BUILD_KINDS)


def derived_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").count()
    return probe_table(table(spark, sf_dir, "events").select(F.col("event_id").alias("i")), n, PROBE_KINDS)


@register("synthetic_build", build_sql(ORDER_ROWS, BUILD_KINDS))
def synthetic_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(derived_build(spark, sf_dir))


@register("synthetic_probe", probe_sql(EVENT_ROWS, COUNT_ORDERS, PROBE_KINDS))
def synthetic_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(derived_probe(spark, sf_dir))


@register("synthetic_join", f"SELECT b.*, p.* EXCLUDE (key) FROM ({build_sql(ORDER_ROWS, BUILD_KINDS)}) b JOIN ({probe_sql(EVENT_ROWS, COUNT_ORDERS, PROBE_KINDS)}) p ON b.key = p.key")
def synthetic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(join(derived_build(spark, sf_dir), derived_probe(spark, sf_dir), "radix"))


@register("join_row_count", f"SELECT count(*) AS n FROM ({JOIN_SQL})")
def join_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_broadcast(spark, sf_dir).agg(F.count("*").alias("n"))


@register("multiset_check", f"SELECT count(*) AS left_rows, count(*) AS right_rows, 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM ({JOIN_SQL})")
def multiset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    build, probe = orders(spark, sf_dir), lineitem(spark, sf_dir)
    return differences(join(build, probe, "broadcast"), sort_merge_join(build, probe))


@register("rep_stats", 'SELECT event_type, median(value) AS med, min(value) AS "min", max(value) AS "max" FROM events GROUP BY 1')
def rep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("med"), F.min("value").alias("min"), F.max("value").alias("max"))


@register("partition_join_histogram", f"SELECT (h >> 56)::INTEGER AS pid, count(*) AS n FROM {lineitem_hash_sql()} JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def partition_join_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join(orders(spark, sf_dir).select("key"), lineitem(spark, sf_dir).select("key"), "radix")
    return histogram(joined, RadixConfig((8,)))


@register("probe_bytes", f"SELECT (h >> 56)::INTEGER AS pid, count(*) AS n, count(*) * {PROBE_ROW_BYTES} AS n_bytes FROM {lineitem_hash_sql()} GROUP BY 1")
def probe_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lineitem(spark, sf_dir), RadixConfig((8,))).withColumn("n_bytes", F.col("n") * PROBE_ROW_BYTES)


@register("flush_counts", f"SELECT (h >> 59)::INTEGER AS pid, greatest(1, ceil(count(*) * {PROBE_ROW_BYTES} / 65536.0))::INTEGER AS flushes FROM {lineitem_hash_sql()} GROUP BY 1")
def flush_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.operators.joins import flush_plan

    return flush_plan(lineitem(spark, sf_dir), "key", RadixConfig((5,)), PROBE_ROW_BYTES, 65536)


@register("largest_join_partition", f"SELECT (h >> 56)::INTEGER AS pid, count(DISTINCT l_orderkey) AS n FROM {lineitem_hash_sql()} GROUP BY 1 ORDER BY n DESC, pid LIMIT 1")
def largest_join_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest(with_pid(lineitem(spark, sf_dir).select("key").distinct(), RadixConfig((8,))).groupBy("pid").agg(F.count("*").alias("n")))


@register("empty_build_join", f"{JOIN_SQL} WHERE o_orderkey < 0")
def empty_build_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(orders(spark, sf_dir).where("key < 0"), lineitem(spark, sf_dir), "radix")
