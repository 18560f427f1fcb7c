"""Byte-level BPE encoding and decoding with the ranks of a tiktoken file, chunk by chunk."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.chunks import MARGIN, explode_chunks, split_long, stitches
from tessel.llm.common import small_batches, stage, table
from tessel.llm.encoders import CACHE_ENTRIES

EDGES = "uid long, i int, last boolean, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"
CODES = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankCodec:
    """Pre-tokens by a pattern, their ids by merge ranks, and back.

    Ids are kept as decimal text joined by blanks, the form that is hashed; pre-tokens that occur again come from a
    bounded cache.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.scan = regex.compile(pattern)
        self.one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.raw = {str(rank): token for token, rank in ranks.items()}
        self.names = [str(k) for k in range(max(ranks.values(), default=0) + 1)]
        self.cache: dict[str, str] = {}

    def spans(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self.scan.finditer(text, start))

    def pieces(self, text: str, start: int, stop: int) -> list[str]:
        """Pre-tokens from a true boundary up to another one; the text may go on behind it."""
        if start == 0 and stop >= len(text):
            return self.scan.findall(text)
        out = []
        for a, b in self.spans(text, start):
            if a >= stop:
                break
            out.append(text[a:b])
        return out

    def ids(self, pieces: list[str]) -> str:
        """Decimal ids joined by one blank."""
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for piece in set(pieces).difference(cache):
            cache[piece] = " ".join(map(str, self.one(piece)))
        return " ".join(map(cache.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.split(" "))) if ids else b""


@functools.lru_cache(maxsize=4)
def rank_codec(path: str, pattern: str) -> RankCodec:
    return RankCodec(path, pattern)


def _row(ids: str, raw: bytes) -> tuple[int, str, str]:
    return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _codes(doc_ids: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, ids, raw = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode(docs: DataFrame, ranks: str, pattern: str, chunk: int = 16_384, overlap: int = 1024) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts of more than chunk characters are cut into overlapping chunks that are pre-tokenised in parallel. A chunk
    starts anywhere, so its first pre-tokens may be wrong; from the first boundary that it has in common with the chunk
    before, both scans are the same. The pieces between these stitches are encoded in parallel; decoding concatenates
    the raw bytes of the pieces. Where two chunks share no boundary in their overlap (one run of letters longer than
    it), the document is scanned as one chunk. Null text is empty: no tokens and the hashes of nothing. Rows with equal
    doc_id each have their result; other columns are ignored; an empty table gives no rows. The pattern must not look
    behind, and must look ahead by no more than 32 characters beyond a match that is no run.
    """
    small_batches(docs.sparkSession)
    short, long = split_long(docs, chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(ranks, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = codec.ids(codec.pieces(text, 0, len(text)))
                rows.append(_row(ids, codec.decode(ids)))
            yield _codes(batch.column("doc_id"), rows)

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(ranks, pattern)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                sure = len(x["text"]) + (1 if x["last"] else -MARGIN)
                starts = np.array([a for a, b in codec.spans(x["text"]) if a <= sure], dtype=np.int64)
                head, tail = starts[starts <= overlap], starts[starts >= chunk]
                out.append((x["uid"], x["i"], x["last"], head + x["base"], np.zeros(len(head), np.int64), tail + x["base"], np.zeros(len(tail), np.int64)))
            yield pa.RecordBatch.from_pylist([dict(zip(EDGE_NAMES, r, strict=True)) for r in out], schema=EDGE_ARROW)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(ranks, pattern)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                start = (x["start"] or x["base"]) - x["base"]
                stop = len(x["text"]) if x["stop"] is None else x["stop"] - x["base"]
                ids = codec.ids(codec.pieces(x["text"], start, stop))
                out.append({"uid": x["uid"], "i": x["i"], "ids": np.array(ids.split(), "<u4").tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=PIECE_ARROW)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(ranks, pattern)
        for batch in batches:
            rows = []
            for parts in batch.column("parts").to_pylist():
                ids = [" ".join(map(codec.names.__getitem__, np.frombuffer(p["ids"], "<u4").tolist())) for p in parts]
                rows.append(_row(" ".join(x for x in ids if x), b"".join(map(codec.decode, ids))))
            yield _codes(batch.column("doc_id"), rows)

    cut = explode_chunks(long, chunk, overlap)
    joints = stage(stitches(cut.mapInArrow(boundaries, EDGES)), "joints")
    failed = joints.where("at is null").select("uid").distinct()
    ends = joints.select("uid", "i", F.col("at").alias("stop"))
    starts = joints.select("uid", (F.col("i") + 1).alias("i"), F.col("at").alias("start"))
    ready = cut.join(failed, "uid", "left_anti").join(starts, ["uid", "i"], "left").join(ends, ["uid", "i"], "left")
    pieces = ready.mapInArrow(encode, "uid long, i int, ids binary")
    parts = pieces.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    joined = parts.join(long.select("uid", "doc_id"), "uid").select("doc_id", "parts").mapInArrow(join_up, CODES)
    rest = long.join(failed, "uid", "left_semi").select("doc_id", "text").mapInArrow(whole, CODES)
    return short.mapInArrow(whole, CODES).unionByName(joined).unionByName(rest)


_LONGS = pa.list_(pa.int64())
EDGE_ARROW = pa.schema([("uid", pa.int64()), ("i", pa.int32()), ("last", pa.bool_()), ("head_at", _LONGS), ("head_n", _LONGS), ("tail_at", _LONGS), ("tail_n", _LONGS)])
EDGE_NAMES = EDGE_ARROW.names
PIECE_ARROW = pa.schema([("uid", pa.int64()), ("i", pa.int32()), ("ids", pa.binary())])


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
