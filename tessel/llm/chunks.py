"""Overlapping chunks of huge texts and where neighbouring chunks agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import stage

#: A boundary closer than this to the right end of a chunk that goes on may still change with more text.
MARGIN = 32


def split_long(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text) with at most chunk characters, and the others, each with a row number uid of its own."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk)
    long = rows.where(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())
    return short, stage(long, "long")


def explode_chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows (uid, i, last, base, text): chunk i starts at character base = i * chunk and reaches overlap past the next start."""
    n = F.ceil(F.length("text") / chunk).cast("int")
    rows = long.select("uid", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    base = F.col("i") * chunk
    piece = F.substring("text", base + 1, F.lit(chunk + overlap))
    rows = rows.select("uid", "i", (F.col("i") == F.col("n") - 1).alias("last"), base.cast("long").alias("base"), piece.alias("text"))
    return rows.repartition("uid", "i")


def stitches(edges: DataFrame) -> DataFrame:
    """Where each chunk hands over to the next: rows (uid, i, at, before, after), at null where they don't agree.

    edges has uid, i, last and, for the overlap at either side, the stable boundaries (head_at, tail_at: characters from
    the start of the text) with the tokens of the chunk before each (head_n, tail_n). before and after count the tokens
    before the common boundary in chunk i and in chunk i + 1.
    """
    left = edges.where("not last").select("uid", "i", "tail_at", "tail_n")
    right = edges.where("i > 0").select("uid", (F.col("i") - 1).alias("i"), "head_at", "head_n")
    at = F.array_min(F.array_intersect("tail_at", "head_at"))
    rows = left.join(right, ["uid", "i"]).withColumn("at", at)
    count = lambda n, where: F.element_at(n, F.array_position(where, F.col("at")).cast("int"))
    known = F.col("at").isNotNull()
    return rows.select("uid", "i", "at", F.when(known, count("tail_n", "tail_at")).alias("before"), F.when(known, count("head_n", "head_at")).alias("after"))
