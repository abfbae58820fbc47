"""Summaries, verification, and the choice of the radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddystream.functions.geometry import cell, join_side
from eddystream.operators.cluster import brute_force_windows
from eddystream.operators.neighbors import live_pairs, moved_cells
from eddystream.operators.windows import count_windows, dense_totals
from eddystream.params import DbscanParams
from eddystream.session import ship


def cluster_sizes(result: DataFrame) -> DataFrame:
    """(window_id, cluster_id, n_points) of every cluster id, noise rows each being their own."""
    return result.groupBy("window_id", "cluster_id").agg(F.count("*").alias("n_points"))


def cluster_summary(result: DataFrame, min_pts: int) -> DataFrame:
    """(window_id, n_clusters, n_small, n_points): ids with min_pts rows or more, the others, and rows less those others."""
    many = F.col("n_points") >= min_pts
    return cluster_sizes(result).groupBy("window_id").agg(
        F.count(F.when(many, 1)).alias("n_clusters"), F.count(F.when(~many, 1)).alias("n_small"),
        (F.sum("n_points") - F.count(F.when(~many, 1))).alias("n_points"),
    )


def verify(result: DataFrame, points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, pos, problem): rows of ``result`` that a brute-force clustering contradicts; none if all is well.

    Every row of every window is expected once: one that lacks is "missing",
    one too many (also a repeated one) "extra", the others are "label" or
    "cluster" where that differs.
    """
    got = result.groupBy("window_id", "pos").agg(F.count("*").alias("times"), F.min("label").alias("label"), F.min("cluster_id").alias("cluster_id"))
    want = brute_force_windows(points, p).select("window_id", "pos", F.col("label").alias("right_label"), F.col("cluster_id").alias("right_id"))
    both = got.join(want, ["window_id", "pos"], "full")
    problem = (
        F.when(F.col("times").isNull(), "missing").when(F.col("right_label").isNull() | (F.col("times") > 1), "extra")
        .when(~F.col("label").eqNullSafe(F.col("right_label")), "label").when(~F.col("cluster_id").eqNullSafe(F.col("right_id")), "cluster")
    )
    return both.select("window_id", "pos", problem.alias("problem")).where("problem is not null")


def rt_counters(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, candidates, pairs, dense_cells, dense_points): work of the search: pairs that share a neighbourhood of cells, and near ones."""
    axes = [f"c{a}" for a in p.axes]
    counted = count_windows(points, p).withColumns(cell(p, join_side(p))).groupBy("window_id", *axes).agg(F.count("*").alias("n"))
    here = counted.select("window_id", "n", F.explode(moved_cells(p)).alias("to")).select("window_id", "n", "to.*")
    there = counted.withColumnRenamed("n", "m")
    seen = here.join(there, ["window_id", *axes]).groupBy("window_id").agg(F.sum(F.col("n") * F.col("m")).alias("candidates"))
    out = seen.join(live_pairs(points, p), "window_id", "left").join(dense_totals(count_windows(points, p), p), "window_id")
    return out.select("window_id", "candidates", F.coalesce("pairs", F.lit(0)).alias("pairs"), "dense_cells", "dense_points")


def sampled(points: DataFrame, most: int) -> DataFrame:
    """``most`` rows by the hash of their seq: the same ones each time."""
    return points.orderBy(F.md5(F.col("seq").cast("string").cast("binary")), "seq").limit(most)


def kth_distance(points: DataFrame, k: int, dims: int, sample: int = 10_000) -> DataFrame:
    """(seq, distance) to the ``k``-th nearest other row of a sample of at most ``sample`` rows.

    The sample has a bound, so it is sent to all tasks, which take its rows in
    blocks; fewer than ``k`` others give null.
    """
    axes = ["x", "y", "z"][:dims]
    some = sampled(points, sample).select("seq", *axes)
    rows = some.toPandas()
    ship(points.sparkSession)
    shared = points.sparkSession.sparkContext.broadcast(rows[axes].to_numpy(np.float64))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = shared.value
        for pdf in frames:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                d2 = np.zeros((len(part), len(all_)))
                for j, a in enumerate(axes):
                    d = part[a].to_numpy()[:, None] - all_[:, j]
                    d2 += d * d
                # the row itself is among them, at distance 0
                far = np.sqrt(np.partition(d2, k, axis=1)[:, k]) if k < len(all_) else np.full(len(part), np.nan)
                yield pd.DataFrame({"seq": part["seq"], "distance": far})

    spread = points.sparkSession.createDataFrame(rows).repartition(max(1, len(rows) // 512))
    return spread.mapInPandas(measure, "seq long, distance double").select("seq", F.nanvl("distance", F.lit(None)).alias("distance"))


def estimate_eps(points: DataFrame, k: int, dims: int, noise_ratio: float = 0.01, sample: int = 10_000) -> DataFrame:
    """(eps): of the k-distances from far to near, the one at ``int(rows * noise_ratio)``. A rule of thumb for k is 2*dims - 1."""
    far = kth_distance(points, k, dims, sample)
    order = Window.orderBy(F.desc("distance"))  # over the sample, which is bounded
    ranked = far.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    return ranked.where(F.col("i") == F.floor(F.col("n") * noise_ratio)).select(F.col("distance").alias("eps"))
