"""Byte-level convolutional quality classifier in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import small_batches, table

#: Bytes under one filter, filters, bytes of a chunk; chunks overlap by a filter's width less one.
WIDTH, FILTERS, CHUNK = 6, 12, 4096
#: The fit takes at most this many labelled rows of each class, those with the lowest hash, of at most MAX_BYTES bytes.
SAMPLE_ROWS, MAX_BYTES = 700, 12_000
EPOCHS = 25


def weights(seed: int = 7) -> dict[str, np.ndarray]:
    """table[k, byte, filter]: what a byte at offset k adds to a filter; out: over the filters' greatest and mean maxima."""
    rng = np.random.default_rng(seed)
    return {"table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}


def pair_tables(w: dict[str, np.ndarray]) -> np.ndarray:
    """Tables over two neighbouring bytes: half the look-ups."""
    t = w["table"]
    return np.stack([(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)])


def chunk_maxima(raw: bytes, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each overlapping chunk of the whole text, every filter's greatest response and where in the text it lies."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < WIDTH:
        data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
    both = data[:-1].astype(np.int32) * 256 + data[1:]
    best, where = [], []
    for start in range(0, len(data) - WIDTH + 1, CHUNK):
        own = both[start : start + CHUNK + WIDTH - 2]
        n = len(own) - WIDTH + 2
        response = pairs[0][own[:n]]
        for j in range(1, WIDTH // 2):
            response += pairs[j][own[2 * j : 2 * j + n]]
        at = response.argmax(0)
        best.append(response[at, np.arange(FILTERS)])
        where.append(at + start)
    return np.array(best), np.array(where)


def probability(maxima: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """The score from the chunks' maxima, with what the gradient needs: pooled features and the greatest chunk of each."""
    active = np.tanh(maxima)
    top = active.argmax(0)
    pooled = np.concatenate([active[top, np.arange(FILTERS)], active.mean(0)])
    return float(1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["bias"][0], -30, 30)))), pooled, top


def fit(texts: list[bytes], labels: list[int], seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the log loss, classes weighted alike; a gradient touches only the windows that won the pooling."""
    w = weights(seed)
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        w["out"][:] = 0
        w["bias"][0] = np.log(share / (1 - share))
        return w
    y = np.array(labels, np.float64)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros(v.shape, np.float32) for k, v in w.items()}
    second = {k: np.zeros(v.shape, np.float32) for k, v in w.items()}
    data = [np.frombuffer(t.ljust(WIDTH, b"\0"), np.uint8) for t in texts]
    step, each = 0, np.arange(FILTERS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            pairs = pair_tables(w)
            grads = {k: np.zeros(v.shape, np.float32) for k, v in w.items()}
            for i in batch:
                maxima, where = chunk_maxima(texts[i], pairs)
                p, pooled, top = probability(maxima, w)
                g = weight[i] * (p - y[i]) / len(batch)
                grads["out"] += g * pooled
                grads["bias"] += g
                slope = 1 - np.tanh(maxima) ** 2
                d = np.repeat((g * w["out"][FILTERS:] / len(maxima))[None], len(maxima), 0)
                d[top, each] += g * w["out"][:FILTERS]
                d *= slope
                for k in range(WIDTH):
                    np.add.at(grads["table"][k], (data[i][where + k], each[None].repeat(len(maxima), 0)), d)
            step += 1
            for k, g in grads.items():
                g += 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] -= (0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[bytes, int]]:
    """At most SAMPLE_ROWS labelled rows of each class whose text has at most MAX_BYTES bytes, lowest hash first.

    Only rows whose crc32 of the id's text leaves no 1 modulo 3 are eligible; so the sample fits the driver at any scale.
    Of rows with one doc_id the text with the lowest hash is taken.
    """
    eligible = docs.where((F.octet_length("text") <= MAX_BYTES) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)).select("doc_id", "text")
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = []
    for label in (0, 1):
        ids = marked.where(F.col("quality") == label).join(eligible.select("doc_id").distinct(), "doc_id", "left_semi")
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        chosen.append(ids)
    ids = chosen[0].union(chosen[1])
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("one")
    rows = eligible.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(one).collect()
    return [(r["one"]["text"].encode(), r["one"]["quality"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def score(docs: DataFrame, labels: DataFrame, whole: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    A filter is a table of what each byte at each of WIDTH offsets adds. Every text is read whole in overlapping chunks;
    a chunk is pooled to each filter's greatest response, chunks by their greatest and their mean, and one logistic unit
    makes the probability of quality label 1. Filters and unit are learned together. held_out: crc32 of the id's text
    modulo 3 is 1; such rows never reach the fit. Null and empty texts score like a few zero bytes. A null doc_id is not
    held out. Rows with equal doc_id are scored one by one; without labels of both classes the score is the smoothed
    share of label 1; other columns are ignored. With whole, _row has all columns of the row that is scored.
    """
    small_batches(docs.sparkSession)
    own = ["_row"] if whole else []
    sample = training_sample(docs, labels)
    w = fit([t for t, _ in sample], [q for _, q in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pair_tables(w)
        for batch in batches:
            scores = [probability(chunk_maxima(t, pairs)[0], w)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), *batch.columns[2:]], ["doc_id", "score", *own])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *[F.struct("*").alias(c) for c in own])
    scored = rows.mapInArrow(run, ", ".join(["doc_id long, score double", *[f"{c} {dict(rows.dtypes)[c]}" for c in own]]))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *own)


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
