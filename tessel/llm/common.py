"""Shared pieces of the training-data operators: tables, durable intermediate results, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers get record batches of at most this many rows and, but for a single longer row, bytes.
BATCH_ROWS, BATCH_BYTES = 1500, 16 << 20

_local_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; the settings are read when a plan runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Only a purely local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_scratch.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="spark-tessel-"))
    return f"{base.rstrip('/')}/tessel-{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once to shared storage and go on from the files: cuts lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node of an edge.

    component is the smallest node that can be reached. Each round takes the smallest label among the neighbours and
    then jumps to the label's own label, so chains shrink geometrically; labels live in Spark and are written between
    rounds, only a count of changes comes to the driver. Null ends are left out; self loops only name their node.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    both = stage(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        nearest = labels.select("node", "component").union(seen).groupBy("node").agg(F.min("component").alias("near"))
        roots = labels.select(F.col("node").alias("near"), F.col("component").alias("root"))
        jumped = nearest.join(roots, "near").select("node", F.least("near", "root").alias("component"))
        old = labels.select("node", F.col("component").alias("old"))
        new = stage(jumped.join(old, "node"), "labels")
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
