"""One inner equi-join under interchangeable physical strategies; all give the same bag of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from tessel.operators.partition import RadixConfig, with_pid

STRATEGIES = ("broadcast", "radix", "best_effort", "sort_merge")
#: A build side is broadcast only if its hash table takes no more than this, and no more than one part of so many of the driver's heap.
BROADCAST_BYTES, HEAP_PARTS = 256 << 20, 16
#: Bytes of a row in a hash table besides its columns: slots, which are half empty, addresses, null bits.
ENTRY_BYTES = 64
#: Beyond a broadcast a partition's hash table gets one part of so many of a task's memory, as it grows by copying and can't spill; within these bytes.
TASK_PARTS, LEAST_BYTES, MOST_BYTES = 4, 8 << 20, 128 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def table_bytes(df: DataFrame, key: str) -> int:
    """About the bytes of a hash table of df, from one pass over its rows; null keys aren't held.

    Files are compressed, and Catalyst estimates by their size, which may be many times too low. Texts are measured; nested
    and other values count as eight times their text, which is more than they take.
    """
    size = F.lit(ENTRY_BYTES + 8 * len(df.columns)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, StringType | BinaryType):
            size += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif not isinstance(f.dataType, NumericType | BooleanType | DateType | TimestampType | TimestampNTZType):
            size += 8 * F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0))
    return df.where(F.col(key).isNotNull()).agg(F.sum(size)).first()[0] or 0


def driver_heap(spark: SparkSession) -> int:
    return spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()


def task_bytes(spark: SparkSession) -> int:
    """About the memory that Spark gives to each task while all cores of its JVM are busy, or less where an executor's cores aren't known."""
    sc = spark.sparkContext
    heap = driver_heap(spark) if sc._jsc.sc().isLocal() else sc._jsc.sc().executorMemory() << 20
    cores = sc.defaultParallelism if sc._jsc.sc().isLocal() else int(sc.getConf().get("spark.executor.cores") or sc.defaultParallelism)
    return int((heap - (300 << 20)) * float(sc.getConf().get("spark.memory.fraction", "0.6"))) // max(1, cores)


def _keyed(df: DataFrame, key: str, config: RadixConfig) -> DataFrame:
    """df with its partition ids, without null keys: they match nothing, and ids that can't be null need no check."""
    return with_pid(df.where(F.col(key).isNotNull()), config, key)


def _output(joined: DataFrame, build: DataFrame, probe: DataFrame, key: str) -> DataFrame:
    """Key, all build payloads, all probe payloads; their names must differ."""
    return joined.select(key, *[c for c in build.columns if c != key], *[c for c in probe.columns if c != key])


def broadcast_join(build: DataFrame, probe: DataFrame, key: str = "key", limit: int = BROADCAST_BYTES) -> DataFrame:
    """One shared table that every task probes in place; the probe side isn't moved.

    The driver builds the table and holds it more than once meanwhile. A build side whose table is beyond limit or beyond
    its part of the driver's heap takes the radix strategy, with as many partitions as keep each hash table within its part
    of a task's memory, which in local mode is the driver's, too. Its rows are measured before.
    """
    size = table_bytes(build, key)
    if size <= min(limit, driver_heap(build.sparkSession) // HEAP_PARTS):
        return _output(probe.join(F.broadcast(build), key), build, probe, key)
    target = min(MOST_BYTES, max(LEAST_BYTES, task_bytes(build.sparkSession) // TASK_PARTS))
    return radix_join(build, probe, key, RadixConfig.for_bytes(size, target))


def radix_join(build: DataFrame, probe: DataFrame, key: str = "key", config: RadixConfig | None = None) -> DataFrame:
    """Both sides placed by the highest bits of the key hash, then a hash join inside each partition.

    As partition id and key are the join keys, the placement serves the join and no further exchange is planned. Without
    a configuration, the number of partitions follows Catalyst's estimate of the build side. A key with very many build
    rows makes one large hash table: best_effort_join deals such leaves over tasks, sort_merge_join spills.
    """
    config = config or RadixConfig.for_bytes(estimated_bytes(build))
    left = _keyed(build, key, config).repartitionById(config.partitions, "pid")
    right = _keyed(probe, key, config).repartitionById(config.partitions, "pid")
    return _output(right.join(left.hint("shuffle_hash"), [key, "pid"]), build, probe, key)


def flush_plan(probe: DataFrame, key: str, config: RadixConfig, probe_row_bytes: int, budget_bytes: int) -> DataFrame:
    """Rows (pid, flushes): into how many pieces of at most about budget_bytes each leaf's probe rows fall.

    At most one row for each leaf, so it may be broadcast whatever the input.
    """
    if budget_bytes < 1:
        raise ValueError("the budget must be positive")
    counts = _keyed(probe, key, config).groupBy("pid").agg(F.count("*").alias("n"))
    return counts.select("pid", F.greatest(F.lit(1), F.ceil(F.col("n") * probe_row_bytes / budget_bytes)).cast("int").alias("flushes"))


def leaf_plan(build: DataFrame, probe: DataFrame, key: str, config: RadixConfig, row_bytes: tuple[int, int], budgets: tuple[int, int]) -> tuple[DataFrame, int]:
    """Rows (pid, parts, flushes, first): each leaf's pieces of build and of probe rows and its first slot; and the number of slots.

    The counts of leaves, at most one row for each, come to the driver.
    """
    if min(budgets) < 1:
        raise ValueError("the budget must be positive")
    if config.bits > 16:
        raise ValueError("leaves are planned one by one: 16 bits at most")
    count = lambda df, left, right: _keyed(df, key, config).select("pid", F.lit(left).alias("l"), F.lit(right).alias("r"))
    both = count(build, 1, 0).union(count(probe, 0, 1)).groupBy("pid").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    rows, slots = [], 0
    for pid, *counts in sorted(both.where("l > 0 and r > 0").collect()):
        parts, flushes = (max(1, -(-n * size // budget)) for n, size, budget in zip(counts, row_bytes, budgets, strict=True))
        rows.append((pid, parts, flushes, slots))
        slots += parts * flushes
    return probe.sparkSession.createDataFrame(rows, "pid int, parts int, flushes int, first int"), max(1, slots)


def best_effort_join(
    build: DataFrame,
    probe: DataFrame,
    key: str = "key",
    config: RadixConfig | None = None,
    probe_row_bytes: int = 64,
    budget_bytes: int = 512 << 20,
    build_row_bytes: int = 64,
    build_budget_bytes: int = 512 << 20,
) -> DataFrame:
    """The build side fully partitioned, the probe side in bounded pieces.

    A leaf whose probe rows exceed the budget is probed in several flushes, and one whose build rows exceed theirs has
    several hash tables: rows of either side are dealt over their pieces and copied to each piece of the other side. So
    neither a hot key nor a full leaf makes a task grow. Every pair of pieces has a slot of its own, and rows are placed by
    slot. Rows are counted before, and dealt by their hash and their place in the input: a repeated task must read the same
    rows in the same order, as it does from tables and files; write other inputs first.
    """
    config = config or RadixConfig.for_bytes(estimated_bytes(build))
    leaves, slots = leaf_plan(build, probe, key, config, (build_row_bytes, probe_row_bytes), (build_budget_bytes, budget_bytes))
    plan = F.broadcast(leaves)
    deal = lambda df, pieces: F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.col(pieces)).cast("int")
    copies = lambda pieces: F.explode(F.sequence(F.lit(0), F.col(pieces) - 1))
    slot = (F.col("first") + F.col("flush") * F.col("parts") + F.col("part")).alias("slot")
    dealt = _keyed(probe, key, config).join(plan, "pid").withColumn("flush", deal(probe, "flushes")).withColumn("part", copies("parts"))
    spread = _keyed(build, key, config).join(plan, "pid").withColumn("part", deal(build, "parts")).withColumn("flush", copies("flushes"))
    left, right = (df.select(*own.columns, slot).repartitionById(slots, "slot") for df, own in ((dealt, probe), (spread, build)))
    return _output(left.join(right.hint("shuffle_hash"), [key, "slot"]), build, probe, key)


def sort_merge_join(build: DataFrame, probe: DataFrame, key: str = "key") -> DataFrame:
    """An independent plan for the same result; adaptive execution splits its skewed partitions."""
    return _output(probe.join(build.hint("merge"), key), build, probe, key)


def join(build: DataFrame, probe: DataFrame, strategy: str, key: str = "key", **options) -> DataFrame:
    """NULL keys match nothing; every match of repeated keys is a row."""
    try:
        run = {"broadcast": broadcast_join, "radix": radix_join, "best_effort": best_effort_join, "sort_merge": sort_merge_join}[strategy]
    except KeyError:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}") from None
    return run(build, probe, key, **options)
