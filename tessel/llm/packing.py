"""Packing documents into training sequences of a fixed length, balanced by estimated cost."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import small_batches, table
from tessel.llm.encoders import piece_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"
#: Tokens that one task packs together; more would not lower the padding, which is none.
WINDOW_TOKENS = 4_000_000


def piece_cost(length: int, linear: float, quadratic: float) -> float:
    """Estimated cost of a piece: projections grow with its length, attention within it with the square."""
    return linear * length + quadratic * length * length


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence) and the sizes of the sequences, all filled exactly.

    Whole multiples of capacity in a document become sequences of their own. The rest of each document, longest first,
    goes whole into the sequence of lowest cost with enough room left; sequences too full for the current length wait
    until shorter ones come. What fits nowhere is cut over the room that is left, cheapest sequences first. Tokens
    beyond a multiple of capacity make up sequences whose sizes are powers of two, so nothing is padded.
    """
    pieces: list[tuple[int, int, int, int]] = []
    sizes: list[int] = []
    rests: list[tuple[int, int, int]] = []
    for k, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((k, start, capacity, len(sizes)))
            sizes.append(capacity)
        if n % capacity:
            rests.append((n % capacity, k, n - n % capacity))
    total = sum(r[0] for r in rests)
    first = len(sizes)
    sizes += [capacity] * (total // capacity)
    bits = total % capacity
    sizes += [1 << b for b in reversed(range(bits.bit_length())) if bits >> b & 1]
    room = sizes[first:]
    cost = [0.0] * len(room)
    ready = [(0.0, s) for s in range(len(room))]
    waiting: list[tuple[int, int]] = []  # (-room, sequence)
    left: list[tuple[int, int, int]] = []

    def put(k: int, start: int, n: int, s: int) -> None:
        pieces.append((k, start, n, first + s))
        room[s] -= n
        cost[s] += piece_cost(n, linear, quadratic)

    for n, k, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while waiting and -waiting[0][0] >= n:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (cost[s], s))
        while ready and room[ready[0][1]] < n:
            s = heapq.heappop(ready)[1]
            if room[s]:
                heapq.heappush(waiting, (-room[s], s))
        if not ready:
            left.append((n, k, start))
            continue
        s = heapq.heappop(ready)[1]
        put(k, start, n, s)
        if room[s]:
            heapq.heappush(ready, (cost[s], s))
    gaps = iter(sorted((s for s in range(len(room)) if room[s]), key=lambda s: (cost[s], s)))
    s = next(gaps, None)
    for n, k, start in left:
        while n:
            part = min(n, room[s])
            put(k, start, part, s)
            n, start = n - part, start + part
            if not room[s]:
                s = next(gaps, None)
    return pieces, sizes


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text) in sequences of at most capacity tokens.

    Each task encodes its rows (null text: empty; each document gets end_id behind it) and packs them in windows of
    about WINDOW_TOKENS, so packing needs no shuffle and a lost task is simply done again. Columns: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id (unique over all tasks), offset, and the sequence's tokens and cost. Rows
    with equal doc_id are packed one by one; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = piece_encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 32
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            pieces, sizes = assign([len(x) // 4 for x in ids], capacity, linear, quadratic)
            costs, filled = [0.0] * len(sizes), [0] * len(sizes)
            for _, _, n, s in pieces:
                costs[s] += piece_cost(n, linear, quadratic)
            rows = []
            for k, start, n, s in pieces:
                crc = zlib.crc32(ids[k][4 * start : 4 * (start + n)])
                rows.append((names[k], start, n, crc, len(ids[k]) // 4, number + s, filled[s], sizes[s], costs[s]))
                filled[s] += n
            number += len(sizes)
            ids.clear()
            names.clear()
            held = 0
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64()] * 8 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], NAMES)

        for batch in batches:
            for name, own in zip(batch.column("doc_id").to_pylist(), encoder.encode_many(batch.column("text")), strict=True):
                names.append(name)
                ids.append(own.tobytes() + end)
                held += len(ids[-1]) // 4
                if held >= WINDOW_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
