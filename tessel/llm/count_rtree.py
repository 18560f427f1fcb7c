"""Exact Jaccard links between documents by an R-tree over group counts of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import components, small_batches, stage, table
from tessel.llm.lattice_lm import batch_words, split_words

#: Coordinates of the points that bound an overlap: FINE ones for documents of LARGE shingles or more, as the bound grows
#: blunt when a group holds many; they fold into GROUPS. COARSE is the size of the table of group frequencies.
GROUPS, FINE, LARGE, COARSE = 128, 1024, 1000, 1 << 16
#: Points of one leaf, and points of a cell that one task compares at once.
LEAF, CELL = 32, 1024
_M1, _M2, _SPREAD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct 64-bit hashes of the k-word shingles of each of many texts, in ascending order."""

    def __init__(self, k: int):
        self.k = k

    def windows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows, repeated ones too, and where each text's begin and end among them."""
        import xxhash

        bounds, which, names, _ = batch_words(texts)
        h = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[which]
        sizes, k = np.diff(bounds), self.k
        n = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
        ends = np.cumsum(n)
        out = np.zeros(int(ends[-1]) if len(n) else 0, np.uint64)
        long = np.repeat(sizes >= k, n)
        if long.any():
            first = (np.arange(len(out)) - np.repeat(ends - n, n) + np.repeat(bounds[:-1], n))[long]
            every = np.full(max(0, len(h) - k + 1), k, np.uint64)
            for j in range(k):
                every = mix(every * _SPREAD + h[j : j + len(every)])
            out[long] = every[first]
        for t in np.flatnonzero((sizes > 0) & (sizes < k)):  # all words as one shingle
            one = np.full(1, sizes[t], np.uint64)
            for x in h[bounds[t] : bounds[t + 1]]:
                one = mix(one * _SPREAD + x)
            out[ends[t] - 1] = one[0]
        return out, np.concatenate(([0], ends))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        hashes, bounds = self.windows(texts)
        return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def least_overlap(sizes: int, percent: int) -> int:
    """The smallest intersection for which 100 * intersection >= percent * union, given the sum of both sizes."""
    return -(-percent * sizes // (100 + percent))


def first_cells(hashes: np.ndarray, rank: np.ndarray, many: int) -> np.ndarray:
    """Cells of the first hashes in one order for all documents: groups of everyday frequency come first, ever more frequent ones later."""
    key = rank[(hashes >> np.uint64(48)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | hashes >> np.uint64(6)
    if many < len(key):
        key = np.partition(key, many - 1)[:many]
    return (key >> np.uint64(10) & np.uint64(0xFFFFFFFF)).astype("<u4")


def point(hashes: np.ndarray) -> np.ndarray:
    """How many of the shingles fall into each group; counts beyond 16 bits make a bound useless, never wrong."""
    many = FINE if len(hashes) >= LARGE else GROUPS
    return np.minimum(np.bincount(((hashes >> np.uint64(20)) % np.uint64(many)).astype(np.int64), minlength=many), 65535).astype("<u2")


def folded(points: list[bytes]) -> np.ndarray:
    """Points as rows of GROUPS counts; a full 16-bit count stays full."""
    out = np.zeros((len(points), GROUPS), np.int64)
    for k, p in enumerate(points):
        x = np.frombuffer(p, "<u2")
        out[k] = x if len(x) == GROUPS else x.reshape(-1, GROUPS).sum(0, dtype=np.int64)
        if (x == 65535).any():
            out[k] = np.iinfo(np.int32).max
    return out


def bounded(lows: tuple[np.ndarray, np.ndarray], highs: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Matrix of what may link: points or boxes given by least sizes and greatest counts, left against right.

    An intersection is at most the sum over groups of the smaller count.
    """
    need = -(-percent * (lows[0][:, None] + lows[1][None, :]) // (100 + percent))
    most = np.zeros(need.shape, np.int64)
    for g in range(GROUPS):
        most += np.minimum(highs[0][:, g, None], highs[1][None, :, g])
    return most >= need


def tree_pairs(n: np.ndarray, x: np.ndarray, comp: np.ndarray, own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (own row, other row) of different components that the bounds don't rule out, by a two-level R-tree.

    Leaves are packed by size, so their boxes are tight; leaf boxes are compared before the points of surviving leaves.
    """
    by = np.lexsort((comp, n))
    leaves = [by[k : k + LEAF] for k in range(0, len(by), LEAF)]
    low = np.array([n[v].min() for v in leaves])
    top = np.array([n[v].max() for v in leaves])
    high = np.array([x[v].max(0) for v in leaves]).astype(np.int64)
    near = bounded((low, low), (high, high), percent) & (100 * top[:, None] >= percent * low[None, :]) & (100 * top[None, :] >= percent * low[:, None])
    left, right = [], []
    for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
        a, b = leaves[i], leaves[j]
        ok = bounded((n[a], n[b]), (x[a].astype(np.int64), x[b].astype(np.int64)), percent)
        ok &= (comp[a][:, None] != comp[b][None, :]) & (own[a][:, None] | own[b][None, :])
        ok &= (100 * n[a][:, None] >= percent * n[b][None, :]) & (100 * n[b][None, :] >= percent * n[a][:, None])
        if i == j:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        p, q = np.nonzero(ok)
        left.append(a[p])
        right.append(b[q])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def group_ranks(docs: DataFrame, k: int) -> np.ndarray:
    """For each of COARSE hash groups, how far its shingles' occurrences are from the everyday number (0), in powers of two.

    All documents are counted; a fixed number of sums reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, total = Shingler(k), np.zeros(COARSE, np.int64)
        for batch in batches:
            total += np.bincount((shingle.windows(batch.column("text"))[0] >> np.uint64(48)).astype(np.int64), minlength=COARSE)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["g", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COARSE)
    counts[rows["g"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    everyday = max(1.0, np.median(counts[counts > 0]) if (counts > 0).any() else 1.0)
    return np.floor(np.maximum(0, np.log2(np.maximum(counts, 1) / everyday) - 0.5)).astype(np.int8)


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose texts link: exact, from the shingles' words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, held = [], None, None
            for s, t in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if t != last:
                    last, held = t, shingle_words(t, k)
                own = shingle_words(s, k)
                both = len(own & held)
                keep.append(100 * both >= percent * (len(own) + len(held) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select("doc_id", "text")
    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").mapInArrow(run, "a long, b long")


def shingle_words(text: str, k: int) -> set[tuple[bytes, ...]]:
    words = split_words(text)
    return {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()


def ratio_ok(a: Column, b: Column, percent: int) -> Column:
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def bound_pairs(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of rows (a, n_a, b, n_b) whose points leave room for the overlap that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("point_a").to_pylist(), batch.column("point_b").to_pylist()
            most = np.minimum(folded(left), folded(right)).sum(1)
            for k, (p, q) in enumerate(zip(left, right, strict=True)):
                if len(p) == len(q) == 2 * FINE:
                    x, y = np.frombuffer(p, "<u2"), np.frombuffer(q, "<u2")
                    if x.max() < 65535 and y.max() < 65535:
                        most[k] = np.minimum(x, y).sum(dtype=np.int64)
            need = -(-percent * (batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()) // (100 + percent))
            ok = most >= need
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    side = lambda s: points.select(F.col("node").alias(s), F.col("point").alias(f"point_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def shared_cells(entries: DataFrame) -> DataFrame:
    """Entries (cell, node, n) of cells with more than one, and the cell's leader, its smallest (node, n).

    Leaders are found before the shuffle as far as they can be, and a hot cell's entries are a join's, which adaptive
    execution can split over tasks.
    """
    heads = entries.groupBy("cell").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("many")).where("many > 1")
    return entries.join(heads.select("cell", "head"), "cell").select("cell", "node", "n", F.col("head.node").alias("leader"), F.col("head.n").alias("leader_n"))


def leaf_pairs(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Pairs of like size and different components within cells of at most LEAF documents, as (a, n_a, b, n_b) with a > b."""
    side = lambda s: rows.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "comp", "own")])
    fit = (F.col("node_a") > F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.col("own_a") | F.col("own_b"))
    met = side("a").join(side("b"), keys).where(fit & ratio_ok(F.col("n_a"), F.col("n_b"), percent))
    return met.select(F.col("node_a").alias("a"), "n_a", F.col("node_b").alias("b"), "n_b")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Two documents link if 100 * intersection >= percent * union of their distinct k-word shingles; fewer words make one
    shingle, no words an empty set that links with nothing. Null text has no words. A row with null doc_id has a null
    component. Rows that share a doc_id are one document that links by any of its texts. Tied documents are told apart
    by doc_id only. Other columns are ignored; an empty table gives no rows.

    Shingles are hashed into groups, and a document is the point of its group counts; an intersection is no larger than
    the sum over groups of the smaller count. With groups as fine as the hash, the bound says that linked documents have
    a common group among their first n - ceil(percent * n / 100) + 1 ones, in an order common to all documents that puts
    frequent groups last. So the cells of the upper level are those groups' half-spaces: documents meet only there.
    Documents with equal sets become one first. In each cell every document is bounded against, and verified with, the
    cell's smallest one, which is linear in the cell and joins groups of near copies of any size. Then each cell's
    documents of still different components are compared by a two-level R-tree over coarser counts, size band by size
    band, large bands in blocks over several tasks; what survives is verified from the texts. No pair that may link is
    left out: pairs in one component already need no look.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rank = spark.sparkContext.broadcast(group_ranks(rows, k))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        shingle, levels = Shingler(k), rank.value
        for batch in batches:
            sizes, signs, points, cells = [], [], [], []
            for h in shingle(batch.column("text")):
                n = len(h)
                sizes.append(n)
                signs.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if n else None)
                points.append(point(h).tobytes())
                cells.append(first_cells(h, levels, n - -(-percent * n // 100) + 1) if n else h.astype("<u4"))
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(c) for c in cells]))).astype(np.int32), pa.array(np.concatenate([*cells, np.zeros(0, np.uint32)]).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(points, pa.binary()), lists], ["doc_id", "n", "sign", "point", "cells"])

    filled = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = stage(filled.mapInArrow(read, "doc_id long, n long, sign binary, point binary, cells array<int>"), "shingles")
    sets = seen.where("n > 0 and doc_id is not null")
    reps = stage(sets.groupBy("sign").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")), "reps")
    chosen = sets.join(reps.select("sign", F.col("rep").alias("doc_id")), ["sign", "doc_id"], "left_semi")
    entries = chosen.select(F.col("doc_id").alias("node"), F.col("n").cast("int").alias("n"), F.explode("cells").alias("cell"))
    shared = stage(shared_cells(entries), "cells")

    points = stage(chosen.select(F.col("doc_id").alias("node"), "point"), "points")
    stars = shared.where((F.col("node") != F.col("leader")) & ratio_ok(F.col("n"), F.col("leader_n"), percent)).select("node", "n", "leader", "leader_n").distinct()
    near = stage(bound_pairs(stars.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("leader").alias("b"), F.col("leader_n").alias("n_b")), points, percent), "near")
    texts = rows.where("text is not null")
    first = stage(verified(near, texts, k, percent), "links")
    joined = components(first)

    labelled = shared.join(joined, "node", "left").select("cell", "node", "n", F.coalesce("component", "node").alias("comp"))
    mixed = labelled.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low <> high").select("cell", "m")
    left = stage(labelled.join(mixed, "cell"), "mixed")
    direct = leaf_pairs(left.where(F.col("m") <= LEAF).withColumn("own", F.lit(True)), ["cell"], percent)
    # in larger cells a document of size n meets sizes in its own band and the next one only
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) + 1e-9)).cast("int")
    banded = left.where(F.col("m") > LEAF).drop("m").withColumn("band", band).withColumn("own", F.lit(True))
    banded = banded.unionByName(banded.withColumn("band", F.col("band") - 1).withColumn("own", F.lit(False)))
    counted = banded.groupBy("cell", "band").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("own").alias("any"))
    # written first: where it is small, it goes to the entries, and a hot cell's need no shuffle
    counted = stage(counted.where("low <> high and any").select("cell", "band", "m"), "sizes")
    banded = stage(banded.join(counted, ["cell", "band"]), "bands")
    direct = direct.union(leaf_pairs(banded.where(F.col("m") <= LEAF), ["cell", "band"], percent))
    split = banded.where(F.col("m") > LEAF).withColumn("parts", F.ceil(F.col("m") / CELL).cast("int"))
    split = split.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select("cell", "band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "n", "comp", "own").join(points, "node")

    def compare(rows):
        import pandas as pd

        x = folded(list(rows["point"]))
        node = rows["node"].to_numpy(np.int64)
        n = rows["n"].to_numpy(np.int64)
        a, b = tree_pairs(n, x, rows["comp"].to_numpy(np.int64), rows["own"].to_numpy(bool), percent)
        a, b = np.where(node[a] > node[b], a, b), np.where(node[a] > node[b], b, a)
        return pd.DataFrame({"a": node[a], "n_a": n[a], "b": node[b], "n_b": n[b]})

    pairs = split.groupBy("cell", "band", "p", "q").applyInPandas(compare, "a long, n_a int, b long, n_b int")
    pairs = bound_pairs(pairs.union(direct).distinct(), points, percent).distinct()
    more = stage(pairs.join(near, ["a", "b"], "left_anti"), "pairs")
    second = first.limit(0) if more.isEmpty() else stage(verified(more, texts, k, percent), "links")
    copies = sets.join(reps.where("m > 1").select("sign", F.col("rep")), "sign").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    classes = components(first.union(second))
    lifted = stage(copies.where("a <> b").distinct().withColumnRenamed("b", "node").join(classes, "node", "left").select(F.col("a").alias("node"), F.coalesce("component", "node").alias("component")), "copies")
    # equal sets under one doc_id with several texts may tie classes together
    again = lifted.groupBy("node").count().where("count > 1").isEmpty() and lifted.join(classes, "node", "left_semi").isEmpty()
    if again:
        final = classes.union(lifted)
        lowest = final
    else:
        lowest = components(first.union(second).union(copies))
    result = seen.select("doc_id", "n").join(lowest.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
