"""Count-based sliding windows and the grid over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddystream.functions.geometry import cell, dense_side
from eddystream.params import DbscanParams


def n_windows(points: DataFrame, p: DbscanParams) -> Column:
    """Windows after the first full one; a scalar subquery, so no job runs here."""
    return F.floor((points.agg(F.count("*")).scalar() - p.window) / p.stride).cast("long")


def window_bounds(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, first_seq, last_seq): window k holds rows k*stride up to k*stride + window - 1, for k from 1 on."""
    n = points.agg(F.floor((F.count("*") - p.window) / p.stride).cast("long").alias("n")).where("n >= 1")
    ids = n.select(F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("window_id"))
    return ids.select(F.col("window_id").cast("int").alias("window_id"), (F.col("window_id") * p.stride).alias("first_seq"), (F.col("window_id") * p.stride + p.window - 1).alias("last_seq"))


def first_window(p: DbscanParams, seq: str = "seq") -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor((F.col(seq) - p.window) / p.stride) + 1)


def last_window(p: DbscanParams, n: Column, seq: str = "seq") -> Column:
    return F.least(n, F.floor(F.col(seq) / p.stride))


def count_windows(points: DataFrame, p: DbscanParams) -> DataFrame:
    """Each point once in every window that holds it: (window_id, seq, pos, x, y, z); pos is its slot in a ring of ``window``."""
    bounded = points.withColumn("_lo", first_window(p)).withColumn("_hi", last_window(p, n_windows(points, p))).where("_lo <= _hi")
    # sequence() would count down from _lo to a smaller _hi
    ids = F.explode(F.sequence("_lo", "_hi"))
    return bounded.withColumn("window_id", ids).select(F.col("window_id").cast("int").alias("window_id"), "seq", (F.col("seq") % p.window).cast("int").alias("pos"), "x", "y", "z")


def live_windows(pairs: DataFrame, points: DataFrame, p: DbscanParams) -> DataFrame:
    """``pairs`` (a.seq < b.seq) with the windows (lo, hi) that hold both rows."""
    return pairs.withColumn("lo", first_window(p, "seq_b")).withColumn("hi", last_window(p, n_windows(points, p), "seq_a")).where("lo <= hi")


def cell_counts(windowed: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, cell, n_points, min_pos) of each cell in which any two points are near."""
    side = dense_side(p)
    cells = windowed.withColumns(cell(p, side))
    return cells.groupBy("window_id", *(f"c{a}" for a in p.axes)).agg(F.count("*").alias("n_points"), F.min("pos").alias("min_pos"))


def dense_cells(windowed: DataFrame, p: DbscanParams) -> DataFrame:
    """Cells with at least min_pts points: all their points are cores, the first of them stands for the cell."""
    return cell_counts(windowed, p).where(F.col("n_points") >= p.min_pts)


def dense_totals(windowed: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, dense_cells, dense_points, sparse_points)."""
    dense = F.col("n_points") >= p.min_pts
    return cell_counts(windowed, p).groupBy("window_id").agg(
        F.count(F.when(dense, 1)).alias("dense_cells"),
        F.coalesce(F.sum(F.when(dense, F.col("n_points"))), F.lit(0)).alias("dense_points"),
        F.coalesce(F.sum(F.when(~dense, F.col("n_points"))), F.lit(0)).alias("sparse_points"),
    )


def cell_offsets(windowed: DataFrame, p: DbscanParams) -> DataFrame:
    """Cells in order with the place of their first point in the window's points sorted by (cell, pos)."""
    axes = [f"c{a}" for a in p.axes]
    run = Window.partitionBy("window_id").orderBy(*axes).rowsBetween(Window.unboundedPreceding, -1)
    counted = cell_counts(windowed, p)
    return counted.withColumn("first", F.coalesce(F.sum("n_points").over(run), F.lit(0))).select("window_id", *axes, "n_points", "first")
