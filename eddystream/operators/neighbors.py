"""Neighbours within the radius.

The stream is cut into chunks of as many consecutive windows as overlap (fewer
if the stream is short), about two windows of rows: a pair of rows of one window lies in one or two of them,
each row is shuffled about twice, and what a task holds is bounded by the
window. Within a chunk, rows are sorted by grid cell and compared with half the
cells around. ``eps_pairs_joined`` says the same as an equi-join on cells and
blocks, for windows that are too large for a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddystream.functions.geometry import cell, join_side, near, stencil
from eddystream.operators.kernel import count_chunk, near_pairs
from eddystream.operators.windows import count_windows, first_window, last_window, live_windows, n_windows
from eddystream.params import DbscanParams
from eddystream.session import ship


def moved_cells(p: DbscanParams, half: bool = False) -> Column:
    """An array of the cells around (cx, cy, cz), to be exploded."""
    return F.array(*(F.struct(*((F.col(f"c{a}") + d).alias(f"c{a}") for a, d in zip(p.axes, o, strict=True))) for o in stencil(p.dims, half)))


def by_chunk(points: DataFrame, p: DbscanParams, schema: str, step: Callable[[np.ndarray, np.ndarray, int, int], Iterator[pd.DataFrame]]) -> DataFrame:
    """What ``step`` gives for (seq, xyz, first window, last window) of every chunk of windows, its rows in order."""
    n, least = n_windows(points, p), points.sparkSession.sparkContext.defaultParallelism
    # fewer windows at once where a stream is so short that some cores would have none
    some = F.least(F.lit(p.window // p.stride), F.greatest(F.lit(1), F.ceil(n / least))).cast("long")
    bounded = points.withColumn("_lo", first_window(p)).withColumn("_hi", last_window(p, n)).withColumn("_some", some).where("_lo <= _hi")
    chunk = F.explode(F.sequence(F.expr("(_lo - 1) div _some"), F.expr("(_hi - 1) div _some")))
    rows = bounded.select(chunk.alias("chunk"), F.col("_some").alias("some"), "seq", "x", "y", "z")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        seq, some = pdf["seq"].to_numpy(), int(pdf["some"].iloc[0])
        first = int(key[0]) * some + 1
        # the last chunk of a stream may hold fewer windows: those whose last row has come
        last = min(first + some - 1, (int(seq[-1]) + 1 - p.window) // p.stride)
        done = list(step(seq, pdf[["x", "y", "z"]].to_numpy(), first, last))
        return pd.concat(done) if done else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    ship(points.sparkSession)
    return rows.groupBy("chunk").applyInPandas(run, schema)


def eps_pairs(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(seq_a, seq_b): pairs of near rows less than a window apart, the earlier first, each once.

    A task has two blocks of ``window`` rows and gives the pairs whose earlier row is in its first.
    """
    block = F.floor(F.col("seq") / p.window)
    rows = points.select(F.explode(F.array(block, block - 1)).alias("block"), "seq", "x", "y", "z")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seq = pdf["seq"].to_numpy()
        a, b = near_pairs(np.ascontiguousarray(pdf[["x", "y", "z"]].to_numpy()[:, : p.dims]), p)
        a, b = np.minimum(seq[a], seq[b]), np.maximum(seq[a], seq[b])
        mine = (a // p.window == int(key[0])) & (b - a < p.window)
        return pd.DataFrame({"seq_a": a[mine], "seq_b": b[mine]})

    ship(points.sparkSession)
    return rows.groupBy("block").applyInPandas(run, "seq_a long, seq_b long")


def eps_pairs_joined(points: DataFrame, p: DbscanParams) -> DataFrame:
    """The same by a join on cells and blocks, in the JVM: one side is repeated for half the cells around and the blocks beside."""
    axes = [f"c{a}" for a in p.axes]
    cells = points.withColumns(cell(p, join_side(p))).withColumn("block", F.floor(F.col("seq") / p.window)).select("seq", *p.axes, "block", *axes)
    beside = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")
    own = cells.select("seq", *p.axes, beside, *axes)
    around = cells.select("seq", *p.axes, "block", F.explode(moved_cells(p, half=True)).alias("to")).select("seq", *p.axes, beside, "to.*")

    def met(a: DataFrame, more: Column) -> DataFrame:
        on = F.col("a.block") == F.col("b.block")
        for k in axes:
            on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        pairs = a.alias("a").join(cells.alias("b"), on & more & (F.abs(F.col("b.seq") - F.col("a.seq")) < p.window) & near(p))
        return pairs.select(F.least("a.seq", "b.seq").alias("seq_a"), F.greatest("a.seq", "b.seq").alias("seq_b"))

    return met(own, F.col("a.seq") < F.col("b.seq")).union(met(around, F.lit(True)))


def window_pairs(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, pos_a, pos_b): near pairs in every window that holds both rows, found once: what needs edges window by window takes them from here."""
    alive = live_windows(eps_pairs(points, p), points, p)
    each = alive.select(F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("window_id"), "seq_a", "seq_b")
    return each.select("window_id", *((F.col(f"seq_{s}") % p.window).cast("int").alias(f"pos_{s}") for s in "ab"))


def live_pairs(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, pairs): near pairs of each window, by differences at the ends of each pair's windows."""
    alive = live_windows(eps_pairs(points, p), points, p)
    steps = alive.select(F.explode(F.array(F.struct(F.col("lo").alias("k"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("k"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(F.col("s.k").alias("k")).agg(F.sum("s.d").alias("d"))
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row a window, never a pair
    ids = points.agg(F.floor((F.count("*") - p.window) / p.stride).cast("long").alias("n")).where("n >= 1").select(F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    both = ids.join(steps, "k", "left").select("k", F.sum(F.coalesce("d", F.lit(0))).over(run).alias("pairs"))
    return both.select(F.col("k").cast("int").alias("window_id"), "pairs")


def neighbor_counts(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, seq, pos, nn): near rows of each row in each window, itself included.

    From the pairs, each found once, by sums of differences at the ends of the windows that hold both rows.
    """
    pairs = live_windows(eps_pairs(points, p), points, p)
    ends = pairs.select(F.explode(F.array("seq_a", "seq_b")).alias("seq"), "lo", "hi")
    steps = ends.select("seq", F.explode(F.array(F.struct(F.col("lo").alias("k"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("k"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy("seq", F.col("s.k").alias("k")).agg(F.sum("s.d").alias("d"))
    held = points.select("seq").withColumn("lo", first_window(p)).withColumn("hi", last_window(p, n_windows(points, p))).where("lo <= hi")
    held = held.select("seq", F.explode(F.sequence("lo", "hi")).alias("k"), F.lit(0).cast("long").alias("d"), F.lit(1).alias("row"))
    both = held.unionByName(steps.withColumn("row", F.lit(0))).groupBy("seq", "k").agg(F.sum("d").alias("d"), F.max("row").alias("row"))
    run = Window.partitionBy("seq").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("nn", F.sum("d").over(run) + 1).where("row = 1")
    return out.select(F.col("k").cast("int").alias("window_id"), "seq", (F.col("seq") % p.window).cast("int").alias("pos"), "nn")


def neighbor_counts_incremental(points: DataFrame, p: DbscanParams) -> DataFrame:
    """The same by differences within a chunk of windows: pairs stay in the task that finds them."""

    def step(seq: np.ndarray, xyz: np.ndarray, first: int, last: int) -> Iterator[pd.DataFrame]:
        for k, at, nn, _ in count_chunk(seq, xyz, p, first, last):
            yield pd.DataFrame({"window_id": np.int32(k), "seq": seq[at], "pos": (seq[at] % p.window).astype(np.int32), "nn": nn})

    return by_chunk(points, p, "window_id int, seq long, pos int, nn long", step)


def sparse_counts(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, seq, pos, core): whether each row is a core; rows of cells that hold min_pts are so without being compared with one another."""

    def step(seq: np.ndarray, xyz: np.ndarray, first: int, last: int) -> Iterator[pd.DataFrame]:
        for k, at, _, core in count_chunk(seq, xyz, p, first, last, collapse=True):
            yield pd.DataFrame({"window_id": np.int32(k), "seq": seq[at], "pos": (seq[at] % p.window).astype(np.int32), "core": core})

    return by_chunk(points, p, "window_id int, seq long, pos int, core boolean", step)


def _delta(points: DataFrame, p: DbscanParams, out: bool) -> DataFrame:
    """Near pairs between a window's rows and a stride that leaves or enters it, summed for the rows that stay or come."""
    pairs = eps_pairs(points, p).select("seq_a", "seq_b")
    n = n_windows(points, p)
    # window k drops the stride of rows (k-1)*S .. k*S-1 and takes in rows (k-1)*S+W .. k*S+W-1
    k = F.floor(F.col("seq_a") / p.stride) + 1 if out else F.floor((F.col("seq_b") - p.window) / p.stride) + 1
    moved = pairs.withColumn("window_id", k.cast("int")).where((F.col("window_id") >= 1) & (F.col("window_id") <= n))
    if out:  # the earlier row leaves; the later one stays if it is beyond the stride and was in the window before
        stays = (F.col("seq_b") >= F.col("window_id") * p.stride) & (F.col("seq_b") < (F.col("window_id") - 1) * p.stride + p.window)
        return moved.where(stays).groupBy("window_id", F.col("seq_b").alias("seq")).agg((-F.count("*")).alias("delta"))
    here = moved.where(F.col("seq_a") >= F.col("window_id") * p.stride)
    return here.select("window_id", F.explode(F.array("seq_a", "seq_b")).alias("seq")).groupBy("window_id", "seq").agg(F.count("*").alias("delta"))


def delta_outgoing(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, seq, delta): neighbours that rows which stay lose with the stride that leaves."""
    return _delta(points, p, True)


def delta_incoming(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, seq, delta): neighbours that rows gain with the stride that comes, on both sides."""
    return _delta(points, p, False)


def brute_force_counts(points: DataFrame, p: DbscanParams) -> DataFrame:
    """(window_id, seq, pos, nn) by comparing every two rows of a window, without a grid: what other counts are held against."""
    rows = count_windows(points, p)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz, nn = pdf[list(p.axes)].to_numpy(), np.zeros(len(pdf), np.int64)
        for i in range(0, len(pdf), 256):
            nn[i : i + 256] = all_near(xyz[i : i + 256], xyz, p).sum(1)
        return pd.DataFrame({"window_id": pdf["window_id"], "seq": pdf["seq"], "pos": pdf["pos"], "nn": nn})

    ship(points.sparkSession)
    return rows.groupBy("window_id").applyInPandas(run, "window_id int, seq long, pos int, nn long")


def all_near(a: np.ndarray, b: np.ndarray, p: DbscanParams) -> np.ndarray:
    """Which rows of ``b`` are nearer than the radius to each row of ``a``."""
    kind = np.float32 if p.precision == "float" else np.float64
    d2 = np.zeros((len(a), len(b)), kind)
    for j in range(p.dims):
        d = a[:, j, None].astype(kind) - b[:, j].astype(kind)
        d2 += d * d
    return d2 < kind(p.radius) * kind(p.radius)


def differing_counts(one: DataFrame, other: DataFrame) -> DataFrame:
    """(window_id, pos, nn, nn_other) where two maps of neighbour counts (window_id, pos, nn) disagree, rows that only one has included."""
    a, b = one.select("window_id", "pos", "nn"), other.select("window_id", "pos", F.col("nn").alias("nn_other"))
    return a.join(b, ["window_id", "pos"], "full").where(~F.col("nn").eqNullSafe(F.col("nn_other")))
