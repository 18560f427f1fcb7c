"""Bag comparison of two results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: the rows of each side, and how many rows, counted with repetition, one side has and the other lacks.

    One aggregation over both sides by whole rows; each row counts 1 on the left and -1 on the right.
    """
    names = left.columns
    both = left.select(*names, F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(right.select(*names, F.lit(0), F.lit(1)))
    balance = both.groupBy(*names).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    only = F.col("l") - F.col("r")
    return balance.agg(
        total("l").alias("left_rows"),
        total("r").alias("right_rows"),
        total(F.greatest(only, F.lit(0))).alias("only_left"),
        total(F.greatest(-only, F.lit(0))).alias("only_right"),
    )


def same_bag(left: DataFrame, right: DataFrame) -> bool:
    row = differences(left, right).first()
    return row["only_left"] == 0 and row["only_right"] == 0
