"""Radix partitioning by the highest bits of the key hash, with exact placement, and what is counted over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.mixing import top_bits, window_bits, with_hash


@dataclass(frozen=True)
class RadixConfig:
    """Bits for each pass. Passes take consecutive windows of the hash from the top, so one pass over all bits is the same."""

    pass_bits: tuple[int, ...] = field(default=(8,))

    def __post_init__(self) -> None:
        if not self.pass_bits or any(not 1 <= b <= 16 for b in self.pass_bits) or sum(self.pass_bits) > 32:
            raise ValueError("each pass takes 1 to 16 bits, all passes 32 at most")

    @property
    def bits(self) -> int:
        return sum(self.pass_bits)

    @property
    def partitions(self) -> int:
        return 1 << self.bits

    @classmethod
    def for_bytes(cls, size: int, target: int = 128 << 20) -> RadixConfig:
        """As many bits as make partitions of about target bytes, 5 to 16; 8 where the size isn't known."""
        if size >= 1 << 62:
            return cls()
        return cls((min(16, max(5, (-(-size // target) - 1).bit_length())),))

    @classmethod
    def split(cls, partitions: int, passes: int = 1) -> RadixConfig:
        """Even bits for each pass, the remainder to the first ones."""
        if partitions < 2 or partitions & partitions - 1:
            raise ValueError("partitions must be a power of two, 2 at least")
        bits = partitions.bit_length() - 1
        if not 1 <= passes <= bits:
            raise ValueError(f"passes must be 1 to {bits} for {partitions} partitions")
        share, more = divmod(bits, passes)
        return cls(tuple(share + (k < more) for k in range(passes)))


def with_pid(df: DataFrame, config: RadixConfig, key: str = "key", out: str = "pid") -> DataFrame:
    return with_hash(df, F.col(key).cast("long"), out).withColumn(out, top_bits(F.col(out), config.bits))


def with_pid_by_passes(df: DataFrame, config: RadixConfig, key: str = "key", out: str = "pid") -> DataFrame:
    """The partition id composed pass by pass: each pass splits a partition into the next bits' sub-partitions."""
    df = with_hash(df, F.col(key).cast("long"), "_hash").withColumn(out, F.lit(0))
    done = 0
    for bits in config.pass_bits:
        df = df.withColumn(out, (F.col(out) * (1 << bits) + window_bits(F.col("_hash"), done, bits)).cast("int"))
        done += bits
    return df.drop("_hash")


def radix_partition(df: DataFrame, config: RadixConfig, key: str = "key", columns: list[str] | None = None) -> DataFrame:
    """df with column pid, rows placed so that partition number and pid are the same; columns picks and orders payloads."""
    if columns is not None:
        df = df.select(key, *columns)
    return with_pid(df, config, key).repartitionById(config.partitions, "pid")


def histogram(df: DataFrame, config: RadixConfig, key: str = "key") -> DataFrame:
    return with_pid(df, config, key).groupBy("pid").agg(F.count("*").alias("n"))


def largest(counts: DataFrame) -> DataFrame:
    """The fullest partition; ties go to the lowest number."""
    return counts.orderBy(F.desc("n"), F.asc("pid")).limit(1)
