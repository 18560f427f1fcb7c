"""Token-id output as ORC: run-length encoded id columns, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import scratch_path, small_batches, stage, table
from tessel.llm.encoders import piece_encoder

FILE_SCHEMA = "doc_id long, block long, block_start long, ids array<int>"
DIGEST_SCHEMA = "doc_id long, block long, block_start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 16 << 20) -> None:
    """Encode docs (doc_id, text) and write their ids below path, in ascending doc_id over ascending blocks.

    One ORC file is one block, a range of doc_id. Integers are run-length encoded (ORC's direct and delta runs), row
    index entries come every 1000 documents and a Bloom filter covers doc_id, so that a reader takes stripes in
    parallel and skips those whose range or filter rules an id out. block_start counts the block's ids before a
    document. Null text is empty and gives the end id alone; null doc_id sorts first; rows with equal doc_id are kept,
    ordered by text hash. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = piece_encoder(tokenizer), np.array([end_id], dtype="<u4")
        block, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            coded = encoder.encode_many(batch.column("text"))
            sizes = np.array([len(c) + 1 for c in coded], dtype=np.int64)
            ends = np.cumsum(sizes)
            ids = pa.array(np.concatenate([part for c in coded for part in (c, end)] or [end[:0]]).view("<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(coded), block, np.int64)), pa.array(before + ends - sizes), lists],
                ["doc_id", "block", "block_start", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, block, block_start, ids) of the files; filters on doc_id reach the stripes' statistics and filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, by document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    small_batches(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("block"), batch.column("block_start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "block", "block_start", "n_tokens", "ids_crc32"],
            )

    rows = stage(read_token_files(spark, path).mapInArrow(digest, DIGEST_SCHEMA), "digest")
    # one row for each file: its ids, then the ids of all files before it
    sizes = rows.groupBy("block").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("block", (F.sum("size").over(Window.orderBy("block")) - F.col("size")).alias("before"))
    return rows.join(before, "block").select("doc_id", (F.col("before") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "ids")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return digest_token_files(spark, path)
