"""Density clustering of every window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddystream.functions.geometry import cell, cell_centre, dense_side, join_side, near, squared_distance, stencil
from eddystream.operators.components import components
from eddystream.operators.kernel import cluster_chunk, cluster_window, roots
from eddystream.operators.neighbors import all_near, by_chunk, moved_cells, sparse_counts, window_pairs
from eddystream.operators.windows import count_windows, dense_cells
from eddystream.params import BORDER, CORE, NOISE, DbscanParams
from eddystream.session import ship, stored

RESULT = "window_id int, seq long, pos int, label int, cluster_id long"


def core_points(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, seq, pos) of rows with at least min_pts near rows; dense cells are never compared inside."""
    return sparse_counts(points, p).where("core").select("window_id", "seq", "pos")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("window_id", F.col("pos_a").alias("pos"), F.col("pos_b").alias("other")).union(pairs.select("window_id", "pos_b", "pos_a"))


def point_labels(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, seq, pos, label): cores, rows next to a core, the rest."""
    return dbscan_windows(points, p).select("window_id", "seq", "pos", "label")


def joined_labels(points: DataFrame, p: DbscanParams) -> DataFrame:
    """The same by joins alone."""
    pairs = _both_ways(window_pairs(points, p))
    counts = pairs.groupBy("window_id", "pos").agg((F.count("*") + 1).alias("nn"))
    cores = counts.where(F.col("nn") >= p.min_pts).select("window_id", "pos")
    if p.min_pts == 1:
        cores = count_windows(points, p).select("window_id", "pos")
    beside = pairs.join(cores.withColumnRenamed("pos", "other"), ["window_id", "other"], "left_semi").select("window_id", "pos").distinct()
    rows = count_windows(points, p).select("window_id", "seq", "pos")
    marked = rows.join(cores.withColumn("core", F.lit(True)), ["window_id", "pos"], "left").join(beside.withColumn("beside", F.lit(True)), ["window_id", "pos"], "left")
    label = F.when(F.col("core"), CORE).when(F.col("beside"), BORDER).otherwise(NOISE)
    return marked.select("window_id", "seq", "pos", label.alias("label"))


def border_points(points: DataFrame, p: DbscanParams) -> DataFrame:
    return point_labels(points, p).where(F.col("label") == BORDER).select("window_id", "seq", "pos")


def noise_points(points: DataFrame, p: DbscanParams) -> DataFrame:
    return point_labels(points, p).where(F.col("label") == NOISE).select("window_id", "seq", "pos")


def window_components(edges: DataFrame) -> DataFrame:
    """(window_id, pos, root): the smallest pos reachable along ``edges`` (window_id, pos_a, pos_b), window by window.

    A window's edges are a task's work; their number is bounded by the window, not by the stream.
    """

    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pd.unique(pd.concat([pdf["pos_a"], pdf["pos_b"]]).sort_values())
        index = pd.Index(nodes)
        up = roots(len(nodes), index.get_indexer(pdf["pos_a"]), index.get_indexer(pdf["pos_b"]))
        return pd.DataFrame({"window_id": pdf["window_id"].iloc[0], "pos": nodes, "root": nodes[up]})

    ship(edges.sparkSession)
    return edges.groupBy("window_id").applyInPandas(connect, "window_id int, pos int, root int")


def dbscan_components(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, pos, root) of all cores, by the join path."""
    pairs = window_pairs(points, p)
    counts = _both_ways(pairs).groupBy("window_id", "pos").agg((F.count("*") + 1).alias("nn"))
    cores = counts.where(F.col("nn") >= p.min_pts).select("window_id", "pos") if p.min_pts > 1 else count_windows(points, p).select("window_id", "pos")
    kept = pairs.join(cores.withColumnRenamed("pos", "pos_a"), ["window_id", "pos_a"], "left_semi").join(cores.withColumnRenamed("pos", "pos_b"), ["window_id", "pos_b"], "left_semi")
    alone = cores.select("window_id", F.col("pos").alias("pos_a"), F.col("pos").alias("pos_b"))
    return window_components(kept.select("window_id", "pos_a", "pos_b").union(alone))


def dbscan_windows_joined(points: DataFrame, p: DbscanParams) -> DataFrame:
    """The result of :func:`dbscan_windows` by joins, with Python only for components: for very large windows of few neighbours."""
    comps = dbscan_components(points, p)
    labels = joined_labels(points, p)
    pairs = _both_ways(window_pairs(points, p))
    beside = pairs.join(comps.select("window_id", F.col("pos").alias("other"), "root"), ["window_id", "other"]).groupBy("window_id", "pos").agg(F.min("root").alias("beside"))
    out = labels.join(comps, ["window_id", "pos"], "left").join(beside, ["window_id", "pos"], "left")
    cid = F.when(F.col("label") == CORE, F.col("root")).when(F.col("label") == BORDER, F.col("beside")).otherwise(F.col("pos"))
    return out.select("window_id", "seq", "pos", "label", cid.cast("long").alias("cluster_id"))


def dbscan_windows(points: DataFrame, p: DbscanParams, collapse: bool = True) -> DataFrame:
    """Labels and clusters of every row of every window.

    The unit of work is as many consecutive windows as overlap (window / stride
    of them): about two windows of rows, so each row is shuffled twice instead
    of once for every window that holds it, and near pairs are found once for
    all these windows. What a task holds is bounded by the window's size and
    not by the stream, and there are as many tasks as the stream is long.
    ``collapse`` spares comparisons within cells that are dense.
    """

    def step(seq: np.ndarray, xyz: np.ndarray, first: int, last: int) -> Iterator[pd.DataFrame]:
        for k, at, label, cluster in cluster_chunk(seq, xyz, p, first, last, collapse):
            yield pd.DataFrame({"window_id": np.int32(k), "seq": seq[at], "pos": (seq[at] % p.window).astype(np.int32), "label": label, "cluster_id": cluster})

    return by_chunk(points, p, RESULT, step)


def brute_force_windows(points: DataFrame, p: DbscanParams) -> DataFrame:
    """The result of :func:`dbscan_windows` by comparing every two rows of a window and walking from core to core: without grid, chunks or pairs, to hold others against."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        xyz, pos, n = pdf[list(p.axes)].to_numpy(), pdf["pos"].to_numpy().astype(np.int64), len(pdf)
        core = np.concatenate([all_near(xyz[i : i + 256], xyz, p).sum(1) >= p.min_pts for i in range(0, n, 256)])
        cluster, label = np.full(n, -1, np.int64), np.where(core, CORE, NOISE).astype(np.int32)
        for start in np.flatnonzero(core):  # in order of pos: the first core of a cluster names it, and borders go to the first cluster
            if cluster[start] >= 0:
                continue
            wave = np.array([start])
            cluster[start] = pos[start]
            while len(wave):
                reach = np.zeros(n, bool)
                for i in range(0, len(wave), 256):
                    reach |= all_near(xyz[wave[i : i + 256]], xyz, p).any(0)
                reach &= cluster < 0
                cluster[reach] = pos[start]
                wave = np.flatnonzero(reach & core)
        label[~core & (cluster >= 0)] = BORDER
        return pd.DataFrame({"window_id": pdf["window_id"].to_numpy(), "seq": pdf["seq"].to_numpy(), "pos": pdf["pos"].to_numpy(), "label": label, "cluster_id": np.where(cluster >= 0, cluster, pos)})

    ship(points.sparkSession)
    return count_windows(points, p).groupBy("window_id").applyInPandas(run, RESULT)


def dbscan_static(points: DataFrame, p: DbscanParams, n: int) -> DataFrame:
    """One clustering of the first ``n`` rows: a single window. (seq, label, cluster_id)."""
    one = points.where(F.col("seq") < n).select(F.lit(1).alias("window_id"), "seq", F.col("seq").cast("int").alias("pos"), "x", "y", "z")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, cluster = cluster_window(pdf["pos"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(), p)
        return pd.DataFrame({"seq": pdf["seq"], "label": label, "cluster_id": cluster})

    ship(points.sparkSession)
    return one.groupBy("window_id").applyInPandas(run, "seq long, label int, cluster_id long")


def dbscan_whole(points: DataFrame, p: DbscanParams) -> DataFrame:
    """One clustering of all rows, however many: (seq, label, cluster_id), as :func:`dbscan_static` has them for a single window.

    Rows at one place are one point with a count. Near points come from a join
    on cells, so they cost what the points near one another are, and points
    that many others are near to are spread as that join is. Cores of one
    dense cell hang together, so what is handed to :func:`components` is links
    between cells. Tables between are written to the shared folder. No rows
    give no rows.
    """
    axes, fine = [f"c{a}" for a in p.axes], [f"d{a}" for a in p.axes]
    # the axes beyond p.dims have no say in what is near
    places = stored(points.groupBy(*p.axes).agg(F.min("seq").alias("at"), F.count("*").alias("n")), "places")
    cells = places.withColumns(cell(p, join_side(p)))
    a = cells.select("at", "n", *p.axes, F.explode(moved_cells(p)).alias("to")).select("at", "n", *p.axes, "to.*").alias("a")
    b = cells.alias("b")
    on = F.col("a.at") < F.col("b.at")
    for k in axes:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, on & near(p)).select(F.col("a.at").alias("at"), F.col("a.n").alias("n"), F.col("b.at").alias("other"), F.col("b.n").alias("n_other"))
    pairs = stored(pairs, "near-places")
    both = pairs.select("at", "other", "n_other").union(pairs.select("other", "at", "n"))
    beside = both.groupBy("at").agg(F.sum("n_other").alias("more"))
    counted = places.join(beside, "at", "left").where(F.col("n") + F.coalesce("more", F.lit(0)) >= p.min_pts)
    cored = counted.withColumns(cell(p, dense_side(p), "d")).select("at", *fine)
    heads = cored.groupBy(*fine).agg(F.min("at").alias("head"))
    cores = stored(cored.join(heads, fine).select("at", "head"), "cores")
    links = pairs.select("at", "other").join(cores, "at").join(cores.select(F.col("at").alias("other"), F.col("head").alias("head_other")), "other")
    comps = components(links.where("head <> head_other").select("head", "head_other").distinct(), "cells")
    rooted = stored(cores.join(comps, F.col("head") == F.col("node"), "left").select("at", F.coalesce("component", "head").alias("root")), "roots")
    touched = both.join(rooted.withColumnRenamed("at", "other"), "other").groupBy("at").agg(F.min("root").alias("touched"))
    marked = places.join(rooted, "at", "left").join(touched, "at", "left").select(*p.axes, "root", "touched")
    label = F.when(F.col("root").isNotNull(), CORE).when(F.col("touched").isNotNull(), BORDER).otherwise(NOISE)
    return points.select("seq", *p.axes).join(marked, list(p.axes)).select("seq", label.alias("label"), F.coalesce("root", "touched", "seq").alias("cluster_id"))


# ---- mixed primitives --------------------------------------------------------


def sphere_list(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, kind, pos, radius_x2): what a search has to visit: sparse points with the radius, dense cells with one and a half of it."""
    rows = count_windows(points, p).withColumns(cell(p, dense_side(p)))
    axes = [f"c{a}" for a in p.axes]
    dense = dense_cells(count_windows(points, p), p)
    sparse = rows.join(dense, ["window_id", *axes], "left_anti").select("window_id", F.lit("sparse").alias("kind"), "pos", F.lit(2).alias("radius_x2"))
    return sparse.unionByName(dense.select("window_id", F.lit("dense").alias("kind"), F.col("min_pos").alias("pos"), F.lit(3).alias("radius_x2")))


def sphere_hits(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, pos, hits): spheres of :func:`sphere_list` that hold each row, dense cells' around their centres; by a join on cells as wide as the largest."""
    axes = [f"c{a}" for a in p.axes]
    rows = count_windows(points, p).withColumns(cell(p, dense_side(p)))
    dense = dense_cells(count_windows(points, p), p).select("window_id", *axes)
    centre = cell_centre(p, dense_side(p))
    around = dense.select("window_id", *(c.alias(a) for a, c in zip(p.axes, centre.values(), strict=True)), F.lit(1.5 * p.radius).alias("r"))
    sparse = rows.join(dense, ["window_id", *axes], "left_anti").select("window_id", *p.axes, F.lit(float(p.radius)).alias("r"))
    wide = 1.5 * join_side(p)
    spheres = around.unionByName(sparse).withColumns(cell(p, wide))
    spheres = spheres.select("window_id", *p.axes, "r", F.explode(moved_cells(p)).alias("to")).select("window_id", *p.axes, "r", "to.*").alias("a")
    held = count_windows(points, p).withColumns(cell(p, wide)).alias("b")
    on = F.col("a.window_id") == F.col("b.window_id")
    for k in axes:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    hit = spheres.join(held, on & (squared_distance(p) < F.col("a.r") * F.col("a.r")))
    return hit.groupBy(F.col("b.window_id").alias("window_id"), F.col("b.pos").alias("pos")).agg(F.count("*").alias("hits"))


def _dense_pairs(points: DataFrame, p: DbscanParams) -> DataFrame:
    """Pairs of dense cells (d, e) of a window whose centres are less than two radii apart, each pair once, by a join on coarse cells."""
    side = dense_side(p)
    axes = [f"c{a}" for a in p.axes]
    # a coarse cell is four fine ones wide, which is more than two radii in any dimension
    cells = dense_cells(count_windows(points, p), p).withColumns({f"k{a}": F.floor(F.col(f"c{a}") / 4) for a in p.axes})
    around = F.array(*(F.struct(*((F.col(f"k{a}") + o).alias(f"k{a}") for a, o in zip(p.axes, move, strict=True))) for move in stencil(p.dims)))
    d = cells.select("window_id", *axes, "min_pos", F.explode(around).alias("k")).select("window_id", *axes, "min_pos", "k.*").alias("d")
    e = cells.select("window_id", *axes, "min_pos", *(f"k{a}" for a in p.axes)).alias("e")
    on = F.col("d.window_id") == F.col("e.window_id")
    for a in p.axes:
        on = on & (F.col(f"d.k{a}") == F.col(f"e.k{a}"))
    apart = F.lit(0)
    for a in axes:
        apart = apart + (F.col(f"d.{a}") - F.col(f"e.{a}")) * (F.col(f"d.{a}") - F.col(f"e.{a}"))
    close = apart * F.lit(side * side) < F.lit(4 * p.radius * p.radius)
    return d.join(e, on & (F.col("d.min_pos") < F.col("e.min_pos")) & close)


def dense_neighbor_cells(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, pos_a, pos_b): dense cells, by their first points, with centres less than two radii apart."""
    return _dense_pairs(points, p).select(F.col("d.window_id").alias("window_id"), F.col("d.min_pos").alias("pos_a"), F.col("e.min_pos").alias("pos_b"))


def dense_cell_links(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, pos_a, pos_b): dense cells, by their first points, that hold a pair of near points."""
    side, axes = dense_side(p), [f"c{a}" for a in p.axes]
    heads = dense_cells(count_windows(points, p), p).select("window_id", *axes, F.col("min_pos").alias("head"))
    member = count_windows(points, p).withColumns(cell(p, side)).join(heads, ["window_id", *axes]).select("window_id", "pos", "head")
    pairs = window_pairs(points, p)
    joined = pairs.join(member.select("window_id", F.col("pos").alias("pos_a"), F.col("head").alias("ha")), ["window_id", "pos_a"]).join(
        member.select("window_id", F.col("pos").alias("pos_b"), F.col("head").alias("hb")), ["window_id", "pos_b"]
    )
    return joined.where("ha <> hb").select("window_id", F.least("ha", "hb").alias("pos_a"), F.greatest("ha", "hb").alias("pos_b")).distinct()
