import csv

import duckdb
import pytest
from pyspark.sql import functions as F

from tessel.cli import parse
from tessel.functions.mixing import hash_int, low_bits, top_bits, unsigned_mod, with_hash
from tessel.functions.unsigned import format_schema, parse_schema, row_bytes, signed
from tessel.operators.joins import STRATEGIES, join
from tessel.operators.partition import RadixConfig, histogram, radix_partition, with_pid, with_pid_by_passes
from tessel.operators.verify import differences, same_bag
from tessel.plans.catalogue import ORACLE_SQL, QUERIES
from tessel.report import COLUMNS, append_csv, stats
from tessel.sources.generator import build_table, probe_table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
GOLDEN = {0: 2936252446218299915, 1: 8124547546169826776, 2: 12268264057896198860, 42: 6064031611603715754, 1 << 32: 6915672747850536428, 1 << 63: 16143041101828862749, (1 << 64) - 1: 3896583488888435752}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    assert got == sorted(map(repr, rel.select(*[f'"{c}"' for c in names]).fetchall()))


def test_hash_golden(spark):
    df = spark.createDataFrame([(signed(x),) for x in GOLDEN], "x long")
    rows = with_hash(df, "x", "h").withColumn("pid", top_bits(F.col("h"), 8)).withColumn("slot", low_bits(F.col("h"), 8)).withColumn("m", unsigned_mod(F.col("h"), 1000)).collect()
    by = {r.x: r for r in rows}
    for x, h in GOLDEN.items():
        r = by[signed(x)]
        assert hash_int(x) == h and r.h == signed(h) and (r.pid, r.slot, r.m) == (h >> 56, h & 7, h % 1000)


def test_generator_golden(spark):
    numbers = spark.range(3).withColumnRenamed("id", "i")
    rows = [tuple(r) for r in build_table(numbers, ["u32", "u64"]).collect()]
    assert sorted(rows) == sorted([(3853162593095120136, 1454114169, signed(9236911526259183169)), (3809812710617936398, 1349498049, 179916638735024303), (5580830696475959172, 782159176, 7845289805467067478)])
    got = probe_table(numbers, 1000, ["u8", "u128"]).collect()
    assert signed(15892780934328894801) in {r.key for r in got}
    assert {(r.key, r.p0, r.p1.low) for r in got} >= {(427451489692896344, 140, 8165854438928507473)}


def test_generated_keys(spark):
    numbers = lambda n, p: spark.range(0, n, 1, p).withColumnRenamed("id", "i")
    build = build_table(numbers(3000, 3), ["u8"])
    assert build.select("key").distinct().count() == 3000
    probe = probe_table(numbers(5000, 2), 3000, ["u16"])
    assert join(build, probe, "radix").count() == 5000
    assert same_bag(build, build_table(numbers(3000, 7), ["u8"]))
    assert join(build.limit(0), probe_table(numbers(5, 1), 0, ["u128"]), "radix").count() == 0


CASES = {
    "duplicates": ([1, 1, 2], [1, 1, 3], 4),
    "no match": ([1, 2], [3, 4], 0),
    "empty build": ([], [0, 0, 5], 0),
    "empty probe": ([1, 2], [], 0),
    "extremes": ([0, -(1 << 63), -1], [0, -(1 << 63), -1], 3),
    "nulls": ([1, None], [1, None], 1),
    "skew": ([7] * 1000 + list(range(10_000, 11_000)), [7] * 10, 10_000),
}


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("case", sorted(CASES))
def test_cases(spark, strategy, case):
    left, right, n = CASES[case]
    build = spark.createDataFrame([(k, i) for i, k in enumerate(left)], "key long, b0 int")
    probe = spark.createDataFrame([(k, i) for i, k in enumerate(right)], "key long, p0 int")
    options = {"budget_bytes": 40, "probe_row_bytes": 12} if strategy == "best_effort" else {}
    got = join(build, probe, strategy, **options)
    assert got.columns == ["key", "b0", "p0"]
    assert got.count() == n and same_bag(got, join(build, probe, "sort_merge"))


@pytest.mark.parametrize("budgets", [(200, 1000), (10**6, 200), (200, 200), (10**6, 10**6)])
def test_best_effort_deals_both_sides(spark, budgets):
    """Rows of a hot key, many of them equal, spread over slots that hold no more than about a budget of either side."""
    from tessel.operators.joins import leaf_plan

    build = spark.createDataFrame([(7, k % 5) for k in range(60)] + [(k, 0) for k in range(100, 130)], "key long, b0 int")
    probe = spark.createDataFrame([(7, 1)] * 50 + [(k, k) for k in range(90, 120)], "key long, p0 int")
    config, sizes = RadixConfig((2,)), dict(build_row_bytes=10, probe_row_bytes=10, build_budget_bytes=budgets[0], budget_bytes=budgets[1])
    got = join(build, probe, "best_effort", config=config, **sizes)
    assert same_bag(got, join(build, probe, "sort_merge")) and got.count() == 60 * 50 + 20
    plan, slots = leaf_plan(build, probe, "key", config, (10, 10), budgets)
    rows = plan.collect()
    assert slots == sum(r["parts"] * r["flushes"] for r in rows)
    assert (max(r["parts"] for r in rows) > 2) == (budgets[0] == 200) and (max(r["flushes"] for r in rows) > 2) == (budgets[1] == 200)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("shufflepartitionidpassthrough") == 2 and "Exchange hashpartitioning" not in text


def test_radix_partitions_follow_the_data(spark):
    sizes = {0: 5, 128 << 20: 5, 32 * (128 << 20): 5, 33 * (128 << 20): 6, 10 << 40: 16, (1 << 63) - 1: 8}
    assert {n: RadixConfig.for_bytes(n).bits for n in sizes} == sizes
    big = spark.range(10**10).withColumnRenamed("id", "key")
    plan = join(big, big, "radix")._jdf.queryExecution().sparkPlan().toString()
    assert "shufflepartitionidpassthrough" in plan and "1024" in plan  # 80 GB of keys


def test_generated_code_compiles(spark, sf_dir):
    """The joins of hashed columns run as generated code: no key is tested for null below the hash."""
    for name in ("synthetic_join", "synthetic_probe", "join_radix", "join_best_effort"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert max(map(len, plan.split("\n"))) < 4000, name
    build, probe = (spark.createDataFrame([(1,), (None,), (2,)], "i long") for _ in range(2))
    assert build_table(build, ["u8"]).count() == 2 and probe_table(probe, 5, ["u8"]).count() == 2 and probe_table(probe, 0, []).count() == 2


def test_plans(spark, sf_dir):
    from tessel.operators.joins import broadcast_join

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(QUERIES["join_broadcast"](spark, sf_dir))
    radix = plan(QUERIES["join_radix"](spark, sf_dir))
    assert "ShuffledHashJoin" in radix and radix.count("shufflepartitionidpassthrough") == 2 and "Exchange hashpartitioning" not in radix
    assert "SortMergeJoin" in plan(QUERIES["join_sort_merge"](spark, sf_dir))
    build, probe = (spark.range(100).withColumnRenamed("id", "key") for _ in range(2))
    assert "BroadcastHashJoin" not in plan(broadcast_join(build, probe, limit=10))


@pytest.fixture(scope="module")
def compressed(spark, tmp_path_factory):
    """Orders that take few bytes in a file and more than a broadcast table may in memory, and some lines."""
    path = str(tmp_path_factory.mktemp("compressed"))
    spark.range(0, 150_000, 1, 1).select(F.col("id").alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"), F.repeat(F.lit("x"), 2000).alias("o_orderstatus")).write.parquet(f"{path}/orders.parquet")
    lines = [(k, n, 0.5) for k in (3, 3, 140_000, 10**6) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_broadcast_goes_by_bytes_in_memory(spark, compressed, monkeypatch):
    from tessel.operators import joins
    from tessel.plans.catalogue import lineitem, orders

    got = QUERIES["join_broadcast"](spark, compressed)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "BroadcastHashJoin" not in text
    assert sorted((r["key"], r["l_linenumber"], len(r["o_orderstatus"])) for r in got.collect()) == sorted((k, n, 2000) for k in (3, 3, 140_000) for n in (1, 2))
    build, probe = orders(spark, compressed), lineitem(spark, compressed)
    assert joins.estimated_bytes(build) < 64 << 20 < 256 << 20 < joins.table_bytes(build, "key")
    small = spark.sql("SELECT * FROM VALUES (1L, 'a', NULL), (2L, NULL, array(1, 2)), (NULL, repeat('b', 1000), NULL) t(key, b0, b1)")
    assert joins.table_bytes(small, "key") == 2 * (joins.ENTRY_BYTES + 24) + 1 + 8 * len("[1, 2]") and joins.table_bytes(small.limit(0), "key") == 0
    plan = lambda: joins.broadcast_join(small, probe)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(joins, "driver_heap", lambda spark: 1600)
    assert "BroadcastHashJoin" not in plan()


def test_row_count_beyond_a_broadcast(spark, compressed):
    got = QUERIES["join_row_count"](spark, compressed)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(6,)]


def test_row_count_has_tables_within_a_tasks_memory(spark, compressed, monkeypatch):
    """In a small heap more partitions are made, so that each task's hash table can be built."""
    import re
    from types import SimpleNamespace

    from tessel.operators import joins
    from tessel.plans.catalogue import orders

    monkeypatch.setattr(joins, "driver_heap", lambda spark: 750 << 20)
    got = QUERIES["join_row_count"](spark, compressed)
    partitions = {int(n) for n in re.findall(r"shufflepartitionidpassthrough\(.*?, (\d+)\)", got._jdf.queryExecution().executedPlan().toString())}
    share = (450 << 20) * 0.6 / 8
    assert partitions == {64} and joins.table_bytes(orders(spark, compressed), "key") / 64 < share / 4
    assert [tuple(r) for r in got.collect()] == [(6,)]
    jvm = SimpleNamespace(sc=lambda: SimpleNamespace(isLocal=lambda: False, executorMemory=lambda: 1800))
    context = lambda **conf: SimpleNamespace(sparkContext=SimpleNamespace(_jsc=jvm, defaultParallelism=6, getConf=lambda: conf))
    assert joins.task_bytes(context()) == (900 << 20) // 6 and joins.task_bytes(context(**{"spark.executor.cores": "2"})) == (900 << 20) // 2


def test_multiset_check_beyond_a_broadcast(spark, compressed):
    """Two different plans are compared there, too: radix against sort-merge."""
    got = QUERIES["multiset_check"](spark, compressed)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and "ShuffledHashJoin" in text and "SortMergeJoin" in text
    assert [tuple(r) for r in got.collect()] == [(6, 6, 0, 0)]


def test_multiset_check_in_a_small_heap(spark, compressed, monkeypatch):
    """Its tasks get fewer rows there, and the driver reads each table's footer once for both sides."""
    import re

    from tessel.operators import joins
    from tessel.plans import catalogue

    read, table = [], catalogue.table
    monkeypatch.setattr(catalogue, "table", lambda spark, sf_dir, name: read.append(name) or table(spark, sf_dir, name))
    monkeypatch.setattr(joins, "driver_heap", lambda spark: 750 << 20)
    got = QUERIES["multiset_check"](spark, compressed)
    assert set(re.findall(r"shufflepartitionidpassthrough\(.*?, (\d+)\)", got._jdf.queryExecution().executedPlan().toString())) == {"64"}
    assert sorted(read) == ["lineitem", "orders"]
    assert [tuple(r) for r in got.collect()] == [(6, 6, 0, 0)]


def test_partitioning(spark):
    df = spark.range(10_000).withColumnRenamed("id", "key")
    config = RadixConfig((3, 2, 1))
    placed = radix_partition(df, config).withColumn("at", F.spark_partition_id())
    assert placed.where("at <> pid").isEmpty()
    assert histogram(df, config).agg(F.sum("n")).first()[0] == 10_000
    assert same_bag(with_pid(df, config), with_pid_by_passes(df, config))
    assert RadixConfig.split(1024, 3).pass_bits == (4, 3, 3)
    for bad in (lambda: RadixConfig.split(6), lambda: RadixConfig.split(1), lambda: RadixConfig.split(4, 3), lambda: RadixConfig((16, 16, 1))):
        with pytest.raises(ValueError):
            bad()


def test_differences(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert tuple(differences(a, b).first()) == (3, 3, 1, 1)


def test_budget_rejected(spark):
    df = spark.range(3).withColumnRenamed("id", "key")
    with pytest.raises(ValueError):
        join(df, df, "best_effort", budget_bytes=0)
    with pytest.raises(SystemExit) as e:
        parse(["--bep-budget-mib", "0"])
    assert e.value.code == 2


def test_bounded_stream(spark, tmp_path):
    from tessel.streaming.bounded_probe import probe_stream, start_bounded_join

    build = build_table(spark.range(200).withColumnRenamed("id", "i"), ["u32"])
    probe = probe_table(spark.range(0, 4000, 1, 4).withColumnRenamed("id", "i"), 200, ["u16"])
    probe.write.parquet(str(tmp_path / "probe"))
    stream = probe_stream(spark, str(tmp_path / "probe"), probe.schema, 20_000)
    query = start_bounded_join(build, stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) > 1
    assert same_bag(spark.read.parquet(str(tmp_path / "out")), join(build, probe, "sort_merge"))


def test_report(tmp_path):
    assert stats([3.0, 1.0, 2.0]) == (2.0, 1.0, 3.0) and stats([4.0, 1.0, 2.0, 3.0])[0] == 2.5
    path = str(tmp_path / "m.csv")
    for rep in range(2):
        append_csv(path, [{"scheme": "CHJ", "rep": rep, "e2e_wall_ms": 1.5}])
    rows = list(csv.reader(open(path)))
    assert rows[0] == COLUMNS and len(rows) == 3 and len(COLUMNS) == 27
    assert rows[1][COLUMNS.index("e2e_wall_ms")] == "1.500000" and rows[1][COLUMNS.index("partitions")] == ""


def test_schemas():
    assert parse_schema("u32,u64") == ["u32", "u64"] and parse_schema("") == [] and format_schema([]) == "<none>" and row_bytes(["u8", "u128"]) == 25
    with pytest.raises(ValueError):
        parse_schema("u32,")


def test_cli(spark, tmp_path, capsys):
    from tessel.cli import run

    path = str(tmp_path / "runs.csv")
    o = parse(["--scheme=all", "--build-rows", "500", "--probe-rows", "900", "--build-payload-schema", "u32", "--partitions", "16", "--passes", "2", "--reps", "2", "--check", "--csv", path])
    assert o.config.pass_bits == (2, 2)
    assert run(spark, o) == 0
    assert "PHJ-PURE (2 repetitions)" in capsys.readouterr().out
    rows = list(csv.DictReader(open(path)))
    assert len(rows) == 6
    for r in rows:
        shuffled = r["scheme"] != "CHJ"
        assert all((float(r[c]) > 0) if shuffled else r[c] == "" for c in ("build_shuffle_wall_ms", "probe_shuffle_ns_per_row"))
        assert float(r["peak_mem_mib"]) > 0 and float(r["build_ns_per_row"]) >= 0
