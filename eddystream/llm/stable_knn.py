"""Approximate nearest neighbours by low-dimensional stable projections.

Largest inner products become nearest points by one more coordinate, which gives
all vectors one length. A Gaussian projection to ``m`` numbers is 2-stable:
a squared projected distance is the true one times a chi-square variable of m
degrees. The projections are indexed by a kd-tree: its upper levels part all
rows into cells (splits from a bounded sample, every row indexed), its lower
levels are built within each cell. A query takes leaves in order of their
projected distance and verifies their vectors, until the chi-square test says
that an unseen vector nearer than its k-th best would have shown up by now
with probability ``sure``. It searches its own cell first and then visits the
cells whose boxes that test still admits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddystream.llm.common import small_batches, stored, tidy
from eddystream.llm.vectors import by_group, kind_of, matrix, valid_vectors

#: Numbers of a projection, and the test's probability.
M, SURE, SEED = 8, 0.98, 8
#: Rows that the upper splits are made from, rows of a cell in the mean, and cells at most.
SAMPLE, CELL, MOST_CELLS = 65_536, 16_384, 4096
#: Rows of a block and queries of one task: fuller cells and larger query sets are searched part by part.
BLOCK, QUERIES = 32_768, 4096
LEAF = 128


def chi_square(x: float, m: int) -> float:
    """The distribution function for ``m`` degrees, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = m / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_bound(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


class Projection:
    """Per length of vectors: the Gaussian matrix and the largest squared length."""

    def __init__(self, dim: int, m: int, most: float) -> None:
        self.most = most
        self.g = np.random.Generator(np.random.PCG64([SEED, dim])).normal(size=(dim + 1, m))

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))
        return x @ self.g[:-1] + rest[:, None] * self.g[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.g[:-1]

    def squares(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distances that belong to inner products."""
        return np.maximum((q * q).sum(1) + self.most - 2 * score, 0)


def split(z: np.ndarray, leaf: int) -> list[np.ndarray]:
    """kd-tree leaves as row numbers: halves at the median of the widest coordinate; equal rows are halved as well."""
    out, todo = [], [np.arange(len(z))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(z[rows], axis=0)))
        half = len(rows) // 2
        order = np.argpartition(z[rows, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def upper_splits(z: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A complete kd-tree of ``cells`` (a power of two) leaves in heap order: (axis, value) of each inner node."""
    nodes: list[tuple[int, float]] = []
    level = [z]
    while len(level) < cells:
        following = []
        for part in level:
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            nodes.append((axis, value))
            below = part[:, axis] < value if len(part) else np.zeros(0, bool)
            following += [part[below], part[~below]]
        level = following
    return nodes


def cell_of(z: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(z), np.int64)
    if nodes:
        axis, value = np.array([a for a, _ in nodes]), np.array([v for _, v in nodes])
        while at[0] < len(nodes) if len(at) else False:
            at = 2 * at + 1 + (z[np.arange(len(z)), axis[at]] >= value[at])
    return at - len(nodes)


def search(x: np.ndarray, ids: np.ndarray, row_no: np.ndarray, q: np.ndarray, own: np.ndarray, project: Projection, k: int, bound: float, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of each query's ``k`` nearest in one block, scores of -inf where there are fewer.

    Rows have numbers ``row_no``, of which ``own`` are the queries'. ``known`` are scores that the k-th neighbour has at least, from elsewhere.
    """
    z, zq = project.rows(x), project.queries(q)
    leaves = split(z, LEAF)
    low, high = np.stack([z[r].min(0) for r in leaves]), np.stack([z[r].max(0) for r in leaves])
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), -1, np.int64)
    far = np.zeros((len(q), len(leaves)))
    for j in range(zq.shape[1]):
        gap = np.maximum(np.maximum(low[:, j] - zq[:, j, None], zq[:, j, None] - high[:, j]), 0)
        far += gap * gap
    order = np.argsort(far, axis=1)
    live = np.arange(len(q))
    for step in range(len(leaves)):
        reach = project.squares(q[live], np.maximum(best[live, -1], known[live])) * bound
        live = live[far[live, order[live, step]] < np.maximum(reach, 1e-12)] if step else live
        if not len(live):
            break
        at = order[live, step]
        for leaf in np.unique(at):
            rows, cols = live[at == leaf], leaves[leaf]
            score = q[rows] @ x[cols].T
            score[own[rows][:, None] == row_no[cols]] = -np.inf
            better = np.flatnonzero((score >= best[rows, -1:]).any(1) & (score.max(1) > -np.inf))
            if len(better):
                rows = rows[better]
                all_s = np.concatenate([best[rows], score[better]], 1)
                all_i = np.concatenate([who[rows], np.broadcast_to(ids[cols], (len(rows), len(cols)))], 1)
                top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best[rows], who[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
    return who, best


def nearest(table: DataFrame, every: int = 20, k: int = 20, m: int = M, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by inner product of each row of ``table`` (vec_id, embedding) whose id ``every`` divides.

    All rows but the query's own are candidates; ties go to the smaller id.
    Scores are inner products of the vectors as given, in double precision.
    Vectors of different lengths aren't compared. Null, empty and zero vectors,
    ones with null or non-finite numbers, and rows without an id take no part.
    Rows that repeat an id all take part, as candidates (of one another as
    well) and as queries, each of which has its own ranks. An empty table gives
    no rows.
    """
    spark = table.sparkSession
    small_batches(spark)
    kind = kind_of(table)
    size_of = int(kind[-1])
    rows = valid_vectors(table, once=False).withColumn("dim", (F.length("v") / size_of).cast("int"))
    # a row's number holds from here on, as the table is written
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "knn-vectors")

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = b.column("dim").to_numpy()
            for d in np.unique(lens):
                x = matrix(b.column("v").take(pa.array(np.flatnonzero(lens == d))), kind)
                yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([float((x * x).sum(1).max())]), pa.array([len(x)])], ["dim", "most", "n"])

    sizes = rows.mapInArrow(tidy(squares), "dim int, most double, n long").groupBy("dim").agg(F.max("most").alias("most"), F.sum("n").alias("n")).collect()
    projections = {r["dim"]: Projection(r["dim"], m, r["most"]) for r in sizes}
    trees: dict[int, list[tuple[int, float]]] = {}
    for r in sizes:
        cells = min(MOST_CELLS, 1 << max(0, round(math.log2(r["n"] / CELL)))) if r["n"] > CELL else 1
        if cells > 1:
            share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / r["n"]))
            some = rows.where((F.col("dim") == r["dim"]) & share).select("v").limit(2 * SAMPLE).collect()
            x = np.frombuffer(b"".join(bytes(v[0]) for v in some), kind).reshape(len(some), -1).astype(np.float64)
            trees[r["dim"]] = upper_splits(projections[r["dim"]].rows(x), cells)
    index = spark.sparkContext.broadcast((projections, trees))
    bound = chi_square_bound(sure, m)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projections, trees = index.value
        for b in batches:
            lens = b.column("dim").to_numpy()
            for d in np.unique(lens):
                part = b.take(pa.array(np.flatnonzero(lens == d)))
                x = matrix(part.column("v"), kind)
                z = projections[int(d)].rows(x)
                cell = cell_of(z, trees.get(int(d), []))
                home = cell_of(projections[int(d)].queries(x), trees.get(int(d), []))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(home), pa.array(list(z), pa.list_(pa.float64()))], ["id", "v", "dim", "row", "cell", "home", "z"])

    placed = stored(rows.mapInArrow(tidy(place), "id long, v binary, dim int, row long, cell long, home long, z array<double>"), "knn-cells")
    # a cell's box and its blocks: a few numbers each, for MOST_CELLS cells at most a length
    boxes = placed.groupBy("dim", "cell").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        F.array(*(F.min(F.col("z")[i]) for i in range(m))).alias("low"), F.array(*(F.max(F.col("z")[i]) for i in range(m))).alias("high"),
    ).collect()
    known_boxes: dict[int, tuple] = {}
    for d in projections:
        own = [r for r in boxes if r["dim"] == d]
        known_boxes[d] = np.array([r["cell"] for r in own]), np.array([r["low"] for r in own]), np.array([r["high"] for r in own])
    blocks = F.broadcast(spark.createDataFrame([(r["dim"], r["cell"], r["blocks"]) for r in boxes], "dim int, cell long, blocks int"))
    where = spark.sparkContext.broadcast(known_boxes)
    base = placed.join(blocks, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).select("row", "id", "v", "dim", "cell", "block")
    asked = placed.where(F.pmod(F.col("id"), F.lit(every)) == 0)

    def run(visits: DataFrame) -> DataFrame:
        """(query, query_id, vec_id, score) of visits (row, id, v, dim, cell, known); a query is a row's number."""
        visits = visits.join(blocks, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        parts = visits.groupBy("dim", "cell", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        visits = visits.join(parts, ["dim", "cell", "block"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        there = base.join(parts, ["dim", "cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = visits.select("dim", "cell", "block", "part", "row", "id", "v", "known", F.lit(True).alias("asks")).unionByName(
            there.select("dim", "cell", "block", "part", "row", "id", "v", F.lit(0.0).alias("known"), F.lit(False).alias("asks"))
        )

        def answer(t: pa.Table) -> pa.RecordBatch:
            asks = t.column("asks").to_numpy(zero_copy_only=False)
            found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
            if asks.any() and not asks.all():
                v, ids, row_no = matrix(t.column("v"), kind), t.column("id").to_numpy(), t.column("row").to_numpy()
                q, qids, own, known = v[asks], ids[asks], row_no[asks], t.column("known").to_numpy()[asks]
                project = index.value[0][t.column("dim")[0].as_py()]
                for a in range(0, len(q), 512):
                    who, score = search(v[~asks], ids[~asks], row_no[~asks], q[a : a + 512], own[a : a + 512], project, k, bound, known[a : a + 512])
                    row, col = np.nonzero(np.isfinite(score))
                    found.append((own[a + row], qids[a + row], who[row, col], score[row, col]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query", "query_id", "vec_id", "score"])

        keys = ("dim", "cell", "block", "part")
        return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(by_group(keys, answer)), "query long, query_id long, vec_id long, score double")

    first = stored(run(asked.select("row", "id", "v", "dim", F.col("home").alias("cell"), F.lit(float("-inf")).alias("known"))), "knn-home")
    # the k-th best so far, where there are k
    kth = first.groupBy("query").agg(F.when(F.count("*") >= k, F.sort_array(F.collect_list("score"), asc=False)[k - 1]).alias("known"))
    again = asked.join(kth, asked["row"] == kth["query"], "left").select("row", "id", "v", "dim", "home", F.coalesce("known", F.lit(float("-inf"))).alias("known"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projections = index.value[0]
        for b in batches:
            lens = b.column("dim").to_numpy()
            for d in np.unique(lens):
                part = b.take(pa.array(np.flatnonzero(lens == d)))
                q, known = matrix(part.column("v"), kind), part.column("known").to_numpy()
                project = projections[int(d)]
                cells, low, high = where.value[int(d)]
                zq = project.queries(q)
                gap = np.maximum(np.maximum(low - zq[:, None], zq[:, None] - high), 0)
                near = (gap * gap).sum(2) <= (project.squares(q, known) * bound)[:, None]
                near &= cells != part.column("home").to_numpy()[:, None]
                row, cell = np.nonzero(near)
                got = part.select(["row", "id", "v", "dim"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(cells[cell].astype(np.int64)), pa.array(known[row])], ["row", "id", "v", "dim", "cell", "known"])

    other = run(again.mapInArrow(tidy(visit), "row long, id long, v binary, dim int, cell long, known double"))
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(other).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_stable_projections(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
