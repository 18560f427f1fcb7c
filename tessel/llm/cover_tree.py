"""Near-duplicate vectors: cover trees over blocks of vectors, traversed in pairs under covering-radius bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import components, small_batches, stage, table

#: Vectors in a block at most, about, and blocks in a group; pivots are drawn from so many vectors and are so many at most.
BLOCK, GROUP, SAMPLE, PIVOTS = 1024, 8, 4096, 256
#: Slack on bounds from distances, above what sqrt(2 - 2 * dot) rounds by (1.5e-8 for one last bit of dot, 1e-6 for the
#: bound on 4096 terms); nodes within it are opened, and decisions on pairs have none.
SLACK = 1e-6


class Node:
    """Points under a centre: all lie within radius of it; children have centres from the points and about half the reach."""

    __slots__ = ("center", "points", "radius", "children")

    def __init__(self, center: int, points: np.ndarray, radius: float):
        self.center, self.points, self.radius, self.children = center, points, radius, None


class CoverTree:
    """Nested levels over the rows of x (unit vectors): level radii halve, each node's centre is one of its points."""

    LEAF = 8

    def __init__(self, x: np.ndarray):
        self.x = x
        everything = np.arange(len(x))
        far = self.distances(0, everything)
        self.root = Node(0, everything, float(far.max()))
        todo = [(self.root, max(self.root.radius, 1e-12) / 2)]
        while todo:
            node, reach = todo.pop()
            if len(node.points) <= self.LEAF or node.radius <= 1e-12:
                node.children = [Node(int(p), np.array([p]), 0.0) for p in node.points]
                continue
            node.children = self.split(node, reach)
            todo += [(c, reach / 2) for c in node.children if len(c.points) > 1]

    def distances(self, center: int, points: np.ndarray) -> np.ndarray:
        """From a row to rows; a row is at 0 from itself even if its rounded square isn't 1."""
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[points] @ self.x[center])))
        d[points == center] = 0.0
        return d

    def split(self, node: Node, reach: float) -> list[Node]:
        """A net of the node's points: centres are more than reach apart, each point is within reach of its centre."""
        rest, out = node.points, []
        center = node.center
        while len(rest):
            d = self.distances(center, rest)
            near = d <= reach
            own = rest[near]
            out.append(Node(center, own, float(d[near].max())))
            rest = rest[~near]
            if len(rest):
                center = int(rest[0])
        return out


def dual_traverse(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """All pairs (row of a, row of b) with cosine at least the threshold, as blocks.

    Yields (rows, rows, True) where every row of the one links with every row of the other, and (rows, rows, False) for
    single pairs. Two nodes part ways if their centres are further apart than the threshold's distance and both radii;
    if they are closer by both radii, all their points link and none is looked at. Nodes of one point each are decided by
    their product alone.
    """
    limit = np.sqrt(2 - 2 * cosine)
    stack = [(a.root, b.root)]
    while stack:
        m, n = stack.pop()
        left, right = m.children or [m], n.children or [n]
        dots = a.x[[c.center for c in left]] @ b.x[[c.center for c in right]].T
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
        reach = np.array([c.radius for c in left])[:, None] + np.array([c.radius for c in right])[None, :]
        # a radius of 0 doesn't make a node one point: distances between points that differ in the last bits round to 0
        points = np.array([len(c.points) == 1 for c in left])[:, None] & np.array([len(c.points) == 1 for c in right])[None, :]
        exact = points & (dots >= cosine)
        if exact.any():
            i, j = np.nonzero(exact)
            yield np.array([left[k].center for k in i]), np.array([right[k].center for k in j]), False
        for i, j in zip(*np.nonzero(~points & (apart - reach <= limit + SLACK)), strict=True):
            if apart[i, j] + reach[i, j] <= limit - SLACK:
                yield left[i].points, right[j].points, True
            else:
                stack.append((left[i], right[j]))


class Links:
    """Counts of links of the rows of several blocks, and edges that span what is linked: none between rows joined already."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights, self.counts = weights, [np.zeros(len(w), np.int64) for w in weights]
        self.first = np.cumsum([0, *map(len, weights)])[:-1].tolist()
        self.parent = list(range(sum(map(len, weights))))
        self.edges: list[tuple[int, int]] = []

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def tie(self, i: int, j: int) -> None:
        ri, rj = self.find(i), self.find(j)
        if ri != rj:
            self.parent[ri] = rj
            self.edges.append((i, j))

    def add(self, a: int, b: int, p: np.ndarray, q: np.ndarray, full: bool) -> None:
        """Rows p of block a link with rows q of block b, all with all or one by one; a block with itself comes both ways."""
        if full:
            self.counts[a][p] += self.weights[b][q].sum()
            if a != b:
                self.counts[b][q] += self.weights[a][p].sum()
            pairs = [(i, q[0]) for i in p] + [(p[0], j) for j in q]
        else:
            np.add.at(self.counts[a], p, self.weights[b][q])
            if a != b:
                np.add.at(self.counts[b], q, self.weights[a][p])
            pairs = zip(p, q, strict=True)
        for i, j in pairs:
            self.tie(self.first[a] + int(i), self.first[b] + int(j))


def link_groups(units: list[np.ndarray], weights: list[np.ndarray], many: int, cosine: float) -> Links:
    """Links between the first many blocks and the others, or of all blocks with each other if there are no others."""
    links, trees = Links(weights), [CoverTree(x) for x in units]
    centers = np.array([x.mean(0) for x in units])
    radii = np.array([np.sqrt(((x - c) ** 2).sum(1)).max() for x, c in zip(units, centers, strict=True)])
    limit = np.sqrt(2 - 2 * cosine)
    for a in range(many):
        for b in range(many, len(units)) if many < len(units) else range(a, many):
            if np.sqrt(((centers[a] - centers[b]) ** 2).sum()) <= radii[a] + radii[b] + limit + SLACK:
                for p, q, full in dual_traverse(trees[a], trees[b], cosine):
                    links.add(a, b, p, q, full)
    return links


def pivots(reps: DataFrame, many: int) -> np.ndarray:
    """Centres for the uppermost level: farthest-first among a bounded sample (lowest hashes)."""
    rows = reps.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    x = [np.frombuffer(r["unit"]) for r in rows]
    width = max(map(len, x))
    x = np.array([v for v in x if len(v) == width])
    chosen, nearest = [0], 1 - x @ x[0]
    while len(chosen) < min(many, len(x)):
        k = int(nearest.argmax())
        if nearest[k] <= 1e-12:
            break
        chosen.append(k)
        nearest = np.minimum(nearest, 1 - x @ x[k])
    return x[chosen]


def near_pairs(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors with one label that isn't null link if their cosine, in double precision, is at least the threshold (above 0).
    Equal vectors of a label become one representative with a count first, so a group of copies is one point. The
    uppermost level deals representatives by label and nearest pivot into cells; cells that their radii don't part meet.
    A cell's vectors are dealt by hash into blocks, and blocks into groups. A pair of groups is one row: it builds each
    block's cover tree once and traverses the trees of blocks in pairs, those that their covering radii don't part. So a
    block is sent once for a pair of groups, not for a pair of blocks. Only links that span what is linked go on; counts
    are sums. Null, empty, zero or non-finite vectors link with nothing and are their own component; so do rows with a
    null label or a null vec_id, whose component is null. Vectors of different lengths don't link. Rows repeated with one
    vec_id each count as a vector, each with its own result. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    numbered = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").alias("label"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                unit = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    norm = np.sqrt(np.dot(x / np.abs(x).max(), x / np.abs(x).max())) * np.abs(x).max() if np.isfinite(x).all() and x.any() else 0.0
                    if norm > 0 and np.isfinite(norm):
                        unit = (x / norm + 0.0).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    kind = dict(numbered.dtypes)["label"]
    valid = stage(numbered.mapInArrow(units, f"vec_id long, label {kind}, unit binary"), "units")
    links_at_all = "vec_id is not null and label is not null and unit is not null"
    usable = valid.where(links_at_all)
    found = usable.groupBy("label", "unit").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    reps = stage(found.withColumn("rep", F.monotonically_increasing_id()), "reps")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    centers = pivots(reps, max(1, min(PIVOTS, -(-largest // (block * GROUP)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, away = [], []
            for u in batch.column("unit").to_pylist():
                x = np.frombuffer(u)
                dots = centers @ x if len(x) == centers.shape[-1] else None
                cells.append(-len(x) if dots is None else int(dots.argmax()))
                away.append(0.0 if dots is None else float(np.sqrt(max(0.0, 2 - 2 * dots.max()))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(away)], [*batch.schema.names, "cell", "away"])

    placed = stage(reps.drop("first").mapInArrow(place, f"label {kind}, unit binary, copies long, rep long, cell int, away double"), "placed")
    # one row for each cell: at most PIVOTS of a label, and one for each other length of vectors
    parts = F.ceil(F.count("*") / block).cast("int")
    cells = stage(placed.groupBy("label", "cell").agg(parts.alias("parts"), F.max("away").alias("radius")), "cells")
    dealt = placed.join(cells.drop("radius"), ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = dealt.groupBy("label", "cell", "part").agg(F.collect_list(F.struct("rep", "copies", "unit")).alias("rows"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [batch.column("rows")[k].values for k in range(batch.num_rows)]
            raw = lambda c, flat=flat: pa.array([x.field(c).to_numpy().tobytes() for x in flat], pa.binary())
            unit = pa.array([b"".join(x.field("unit").to_pylist()) for x in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw("rep"), raw("copies"), unit], [*batch.schema.names[:3], "reps", "copies", "units"])

    blocks = stage(rows.mapInArrow(packed, f"label {kind}, cell int, part int, reps binary, copies binary, units binary"), "blocks")
    blocks = blocks.withColumn("lot", F.floor(F.col("part") / GROUP).cast("int"))
    # PIVOTS squared rows at most
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centers @ centers.T)) if len(centers) else np.zeros((0, 0))
    gaps = spark.createDataFrame([(a, b, float(apart[a, b])) for a in range(len(apart)) for b in range(a + 1, len(apart))], "cell_a int, cell_b int, gap double")
    lots = F.ceil(F.col("parts") / GROUP).cast("int")
    side = lambda s: cells.select("label", F.col("cell").alias(f"cell_{s}"), lots.alias(f"lots_{s}"), F.col("radius").alias(f"radius_{s}"))
    close = F.col("gap") <= F.col("radius_a") + F.col("radius_b") + float(np.sqrt(2 - 2 * cosine)) + SLACK
    across = gaps.join(side("a"), "cell_a").join(side("b"), ["label", "cell_b"]).where(close).select("label", "cell_a", "cell_b", "lots_a", "lots_b")
    within = side("a").select("label", "cell_a", F.col("cell_a").alias("cell_b"), "lots_a", F.col("lots_a").alias("lots_b"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = across.unionByName(within).select("label", "cell_a", "cell_b", "lots_b", upto("lots_a").alias("lot_a")).select("label", "cell_a", "cell_b", "lot_a", upto("lots_b").alias("lot_b"))
    pairs = stage(pairs.where("cell_a <> cell_b or lot_a <= lot_b").withColumn("pair", F.monotonically_increasing_id()), "pairs")
    load = F.struct("reps", "copies", "units").alias("block")
    sent = lambda s: pairs.select("pair", "label", F.col(f"cell_{s}").alias("cell"), F.col(f"lot_{s}").alias("lot"), F.lit(s == "b").alias("second"))
    other = sent("b").join(pairs.where("cell_a = cell_b and lot_a = lot_b").select("pair"), "pair", "left_anti")
    full = sent("a").unionByName(other).join(blocks, ["label", "cell", "lot"]).select("pair", "second", load)
    full = full.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "pair").groupBy("pair").agg(
        F.collect_list(F.when(~F.col("second"), F.col("block"))).alias("one"), F.collect_list(F.when(F.col("second"), F.col("block"))).alias("two")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                one, two = one.as_py(), two.as_py()
                reps_, weights = ([np.frombuffer(x[c], np.int64) for x in one + two] for c in ("reps", "copies"))
                x = [np.frombuffer(b["units"]).reshape(len(w), -1) for b, w in zip(one + two, weights, strict=True)]
                links, names = link_groups(x, weights, len(one), cosine), np.concatenate(reps_)
                n = np.concatenate(links.counts)
                linked, edges = np.flatnonzero(n), np.array(links.edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.nulls(len(linked), pa.int64()), pa.array(n[linked])], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(names[edges[:, 0]]), pa.array(names[edges[:, 1]]), pa.array(np.zeros(len(edges), np.int64))], ["a", "b", "n"])

    found = stage(full.select("one", "two").mapInArrow(compare, "a long, b long, n long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg((F.sum("n") - 1).alias("n_links"))  # a row counts itself once
    classes = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = stage(reps.select("label", "unit", "rep", "first").join(links, "rep", "left").join(classes, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "classes")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = named.join(lowest, "component").select("label", "unit", "n_links", "component_id")
    met = usable.join(known, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    alone = valid.where(f"not ({links_at_all})").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(alone).select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "embeddings"))
