"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.bpe_codec import EDGE_ARROW, EDGE_NAMES, EDGES
from tessel.llm.chunks import MARGIN, explode_chunks, split_long, stitches
from tessel.llm.common import small_batches, stage, table
from tessel.llm.encoders import piece_encoder


class LibraryCounter:
    """Counts and word boundaries from the library that a vocabulary file belongs to."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            self.pieces = None

    def counts(self, texts: pa.Array) -> list[int]:
        if self.pieces is not None:
            return [len(self.pieces.encode(text)) for text in texts.to_pylist()]
        return [len(ids) for ids in piece_encoder(self.path).encode_many(texts)]

    def boundaries(self, text: str) -> tuple[list[tuple[int, int]], int]:
        """(character, tokens before it) where a word starts, and the number of all tokens.

        Merges never cross the start of a word, so a word start that two encodings of overlapping texts share is stable:
        what follows is encoded alike in both.
        """
        if self.pieces is not None:
            got = self.pieces.encode(text, return_type="proto").pieces
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            characters = np.cumsum((raw & 0xC0) != 0x80) - 1  # the library's offsets count bytes
            starts = [(p.begin, k) for k, p in enumerate(got) if k and p.piece.startswith("▁") and raw[p.begin : p.begin + 1].tobytes() == b" "]
            return [(int(characters[a]), k) for a, k in starts], len(got)
        e = piece_encoder(self.path).tokenizer.encode(text, add_special_tokens=False)
        out, last = [], object()
        for k, (word, (a, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word != last or word is None:
                out.append((a, k))
            last = word
        return out, len(e.ids)


@functools.lru_cache(maxsize=4)
def library_counter(path: str) -> LibraryCounter:
    return LibraryCounter(path)


def count_by_widening(counter: LibraryCounter, text: str, chunk: int, overlap: int) -> int:
    """Tokens of text from chunks whose overlaps grow fourfold until every pair of neighbours is aligned."""
    while chunk + overlap < len(text):
        total, bases, edges = 0, range(0, len(text), chunk), []
        for base in bases:
            piece = text[base : base + chunk + overlap]
            found, n = counter.boundaries(piece)
            sure = len(piece) + (1 if base + chunk >= len(text) else -MARGIN)
            edges.append(({a + base: k for a, k in found if a <= sure}, n))
        for k, (own, n) in enumerate(edges):
            if k == len(edges) - 1:
                return total + n
            following, start = edges[k + 1][0], bases[k + 1]
            common = min((a for a in own if start <= a <= start + overlap and a in following), default=None)
            if common is None:
                break
            total += own[common] - following[common]
        overlap *= 4
        chunk = max(chunk, 2 * overlap)
    return counter.counts(pa.array([text], pa.string()))[0]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, chunk: int = 65_536, overlap: int = 1024) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary is a .json file of the tokenizers library or a .model file of sentencepiece. Texts of more than chunk
    characters become overlapping chunks, encoded in parallel with offsets; counts are spliced at the first word start
    that both neighbours have in their overlap and that lies clear of a cut end. A document with neighbours that don't
    align is counted again from chunks with overlaps four times as wide, and so on, at last as a whole. Null text is
    empty (0 bytes, 0 tokens). Rows with equal doc_id each have their result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = library_counter(vocabulary)
        for batch in batches:
            n = counter.counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = library_counter(vocabulary)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                found, n = counter.boundaries(x["text"])
                sure, base = len(x["text"]) + (1 if x["last"] else -MARGIN), x["base"]
                head = [(a + base, k) for a, k in found if a <= min(sure, overlap)]
                tail = [(len(x["text"]) + base, n)] if x["last"] else [(a + base, k) for a, k in found if chunk <= a <= sure]
                out.append((x["uid"], x["i"], x["last"], [a for a, _ in head], [k for _, k in head], [a for a, _ in tail], [k for _, k in tail]))
            yield pa.RecordBatch.from_pylist([dict(zip(EDGE_NAMES, r, strict=True)) for r in out], schema=EDGE_ARROW)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = library_counter(vocabulary)
        for batch in batches:
            n = [count_by_widening(counter, text, chunk, overlap * 4) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    short, long = split_long(docs, chunk)
    sized = lambda rows: rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    ends = explode_chunks(long, chunk, overlap).mapInArrow(edges, EDGES)
    ends = stage(ends, "edges")
    joints = stage(stitches(ends), "joints")
    failed = joints.where("at is null").select("uid").distinct()
    parts = joints.where("at is not null").select("uid", (F.col("before") - F.col("after")).alias("n"))
    parts = parts.union(ends.where("last").select("uid", F.element_at("tail_n", 1).alias("n")))
    sums = parts.groupBy("uid").agg(F.sum("n").alias("n_tokens")).join(failed, "uid", "left_anti")
    sizes = long.select("uid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    spliced = sizes.join(sums, "uid").select("doc_id", "n_bytes", "n_tokens")
    again = sized(long.join(failed, "uid", "left_semi")).mapInArrow(widen, schema)
    counted = sized(short).mapInArrow(whole, schema).unionByName(spliced).unionByName(again)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
