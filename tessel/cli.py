"""Command line: generate two tables, join them under each strategy, report, check."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from tessel.functions.unsigned import format_schema, parse_schema, row_bytes
from tessel.metrics import each, plan_metrics, total
from tessel.operators.joins import join
from tessel.operators.partition import RadixConfig
from tessel.operators.verify import differences
from tessel.report import append_csv, summary
from tessel.sources.generator import build_table, probe_table

log = logging.getLogger("tessel")
#: Strategy by the scheme's name on the command line, and the name in reports.
SCHEMES = {"chj": ("broadcast", "CHJ"), "phj-pure": ("radix", "PHJ-PURE"), "phj": ("best_effort", "PHJ")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessel", description=__doc__)
    p.add_argument("--scheme", choices=[*SCHEMES, "all"], help="default: chj and phj")
    p.add_argument("--build-rows", type=int, default=1_000_000)
    p.add_argument("--probe-rows", type=int, default=1_000_000)
    p.add_argument("--build-payload-schema", type=parse_schema, default=[])
    p.add_argument("--probe-payload-schema", type=parse_schema, default=[])
    p.add_argument("--threads", type=int, default=1)
    p.add_argument("--partitions", type=int, default=256)
    p.add_argument("--passes", type=int, default=1)
    p.add_argument("--partition-bits-per-pass", type=lambda s: tuple(map(int, s.split(","))))
    p.add_argument("--bep-budget-mib", type=int, default=512)
    p.add_argument("--reps", type=int, default=1)
    p.add_argument("--csv")
    p.add_argument("--check", action="store_true")
    p.add_argument("--seed", type=int, default=42)
    return p


def parse(args: list[str]) -> argparse.Namespace:
    """Options with the partitioning worked out; wrong ones end with status 2."""
    p = parser()
    o = p.parse_args(args)
    if min(o.build_rows, o.probe_rows) < 0 or min(o.threads, o.reps, o.bep_budget_mib) < 1:
        p.error("rows must not be negative; threads, reps and budget must be positive")
    try:
        o.config = RadixConfig(o.partition_bits_per_pass) if o.partition_bits_per_pass else RadixConfig.split(o.partitions, o.passes)
    except ValueError as e:
        p.error(str(e))
    return o


def measure(o: argparse.Namespace, scheme: str, rep: int, build: DataFrame, probe: DataFrame) -> tuple[dict, DataFrame]:
    """One end-to-end run into a sink that drops rows; phases come from the plan's metrics where Spark has them.

    Times of phases are sums over tasks: building hash tables, and writing either side's shuffle. Memory is that of all
    hash tables, or of the broadcast one.
    """
    strategy, name = SCHEMES[scheme]
    options = {} if strategy == "broadcast" else {"config": o.config}
    if strategy == "best_effort":
        options |= {"probe_row_bytes": row_bytes(o.probe_payload_schema), "budget_bytes": o.bep_budget_mib << 20}
    begun = time.perf_counter()
    joined = join(build, probe, strategy, **options)  # counts leaves first, where the strategy does
    rows = joined._jdf.toDF().queryExecution().toRdd().count()
    wall = (time.perf_counter() - begun) * 1000
    log.info("%s rep %d: %d rows in %.1f ms", name, rep, rows, wall)
    found = plan_metrics(joined)
    n, shuffled = max(1, o.build_rows), strategy != "broadcast"
    built = total(found, "ShuffledHashJoin", "buildTime") if shuffled else total(found, "BroadcastExchange", "buildTime")
    held = total(found, "ShuffledHashJoin", "buildDataSize") if shuffled else total(found, "BroadcastExchange", "dataSize")
    written = each(found, "Exchange", "shuffleWriteTime") if shuffled else []
    probe_ns, build_ns = written if len(written) == 2 else (None, None)
    row = {
        "scheme": name, "rep": rep, "threads": o.threads, "build_rows": o.build_rows, "probe_rows": o.probe_rows,
        "build_payload_schema": format_schema(o.build_payload_schema), "probe_payload_schema": format_schema(o.probe_payload_schema),
        "partitions": o.config.partitions if shuffled else None, "distribution": "uniform", "match_rate": 1.0,
        "build_wall_ms": None if built is None else float(built), "build_ns_per_row": None if built is None else built * 1e6 / n, "e2e_wall_ms": wall,
        "build_shuffle_wall_ms": None if build_ns is None else build_ns / 1e6, "build_shuffle_ns_per_row": None if build_ns is None else build_ns / n,
        "probe_shuffle_wall_ms": None if probe_ns is None else probe_ns / 1e6, "probe_shuffle_ns_per_row": None if probe_ns is None else probe_ns / max(1, o.probe_rows),
        "peak_mem_mib": None if held is None else held / (1 << 20),
        "bep_budget_mib": o.bep_budget_mib if strategy == "best_effort" else None,
    }
    return row, joined


def run(spark: SparkSession, o: argparse.Namespace) -> int:
    """0, or 1 if a check failed; then nothing is reported."""
    build = build_table(spark.range(o.build_rows).withColumnRenamed("id", "i"), o.build_payload_schema, o.seed).persist()
    probe = probe_table(spark.range(o.probe_rows).withColumnRenamed("id", "i"), o.build_rows, o.probe_payload_schema, o.seed).persist()
    log.info("generated %d build and %d probe rows", build.count(), probe.count())
    names = list(SCHEMES) if o.scheme == "all" else [o.scheme] if o.scheme else ["chj", "phj"]
    rows, failed = [], False
    for scheme in names:
        for rep in range(o.reps):
            row, joined = measure(o, scheme, rep, build, probe)
            rows.append(row)
            if o.check and rep == 0:
                d = differences(joined, join(build, probe, "sort_merge")).first()
                bad = d["only_left"] or d["only_right"]
                log.info("%s check: %s", row["scheme"], f"{d['only_left']} rows too many, {d['only_right']} missing" if bad else "same rows")
                failed |= bool(bad)
    if failed:
        return 1
    print(summary(rows))
    if o.csv:
        append_csv(o.csv, rows)
    return 0


def main(args: list[str] | None = None) -> int:
    o = parse(sys.argv[1:] if args is None else args)
    logging.basicConfig(level=logging.INFO, format="[%(levelname)s] %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.master(f"local[{o.threads}]").appName("tessel").config("spark.driver.memory", "6g").config("spark.sql.adaptive.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    try:
        return run(spark, o)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
