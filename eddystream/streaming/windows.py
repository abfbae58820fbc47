"""Clustering of a live stream.

Rows may come in any order and in batches of any size; a window is clustered
and emitted once all rows up to its last one have come, exactly as the batch
operator has it, or once that has been waited for long enough. State per
stream: the rows of the current window and what came ahead of its turn. Streams
are keyed, so each is a unit of parallel work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eddystream.operators.kernel import cluster_chunk, cluster_window
from eddystream.params import CORE, NOISE, DbscanParams
from eddystream.session import ship

RESULT = "stream_id string, window_id int, seq long, pos int, label int, cluster_id long"
STATE = "done long, rows binary"


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, 4)


def advance(rows: np.ndarray, done: int, p: DbscanParams, patience: int) -> tuple[int, np.ndarray]:
    """From buffered ``rows`` (seq, x, y, z), sorted, after ``done`` windows: how many windows are done now, and the rows to cluster them from.

    A window is done once all its rows have come, or rows ``patience`` beyond its end: then it goes without the missing ones.
    """
    seq = rows[:, 0].astype(np.int64)
    k = done
    while len(seq):
        low, high = np.searchsorted(seq, [(k + 1) * p.stride, (k + 1) * p.stride + p.window])
        if high - low < p.window and seq[-1] < (k + 1) * p.stride + p.window + patience:
            break
        if (k + 1) * p.stride + p.window > seq[-1] + 1:
            break
        k += 1
    return k, rows[: np.searchsorted(seq, k * p.stride + p.window)]


def cluster_stream(stream: DataFrame, p: DbscanParams, patience: int | None = None) -> DataFrame:
    """Finished windows of ``stream`` (stream_id, seq, x, y, z), appended as they end.

    Rows before the first window and rows of windows that are done, however
    late they come, are dropped; a row that repeats a seq counts once. A
    window waits for its rows until rows ``patience`` (ten windows, unless
    given) beyond its end have come, and is then clustered without those that
    lack. So state holds the rows of some eleven windows at most, whatever the
    stream leaves out. Windows that end in one batch share their near pairs.
    """
    waits = 10 * p.window if patience is None else patience

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, raw = state.get if state.exists else (0, b"")
        rows = np.concatenate([_unpack(raw), *(f[["seq", "x", "y", "z"]].to_numpy(np.float64) for f in frames)])
        rows = rows[rows[:, 0] >= (done + 1) * p.stride]
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        rows = rows[np.diff(rows[:, 0], prepend=-1) > 0] if len(rows) else rows
        now, ready = advance(rows, done, p, waits)
        state.update((now, rows[np.searchsorted(rows[:, 0], (now + 1) * p.stride) :].astype("<f8").tobytes()))
        some = p.window // p.stride
        for first in range(done + 1, now + 1, some):  # as many windows at once as overlap
            last = min(first + some - 1, now)
            a, b = np.searchsorted(ready[:, 0], [first * p.stride, last * p.stride + p.window])
            seq = ready[a:b, 0].astype(np.int64)
            for k, at, label, cluster in cluster_chunk(seq, ready[a:b, 1:], p, first, last):
                yield pd.DataFrame({"stream_id": key[0], "window_id": np.int32(k), "seq": seq[at], "pos": (seq[at] % p.window).astype(np.int32), "label": label, "cluster_id": cluster})

    ship(stream.sparkSession)
    keyed = stream.select(F.col("stream_id").cast("string").alias("stream_id"), "seq", "x", "y", "z")
    return keyed.groupBy("stream_id").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_time_windows(stream: DataFrame, p: DbscanParams, size: str, slide: str, late: str) -> DataFrame:
    """(window_start, n, clusters, cores, noise): clustering by event time (ts, x, y, z) instead of counts; an extension.

    A window's rows are kept as Spark's own state until the watermark, ``late``
    behind the newest row, has passed its end; then it comes out, once. Later
    rows are dropped. Batches may cut a window as they like.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for start, held in zip(pdf["start"], pdf["held"], strict=True):
                xyz = np.array(sorted((r["ts"], r["x"], r["y"], r["z"]) for r in held), object)[:, 1:].astype(np.float64)
                label, cluster = cluster_window(np.arange(len(xyz)), xyz, p)
                out.append((start, len(xyz), len(np.unique(cluster[label == CORE])), int((label == CORE).sum()), int((label == NOISE).sum())))
            yield pd.DataFrame(out, columns=["window_start", "n", "clusters", "cores", "noise"])

    ship(stream.sparkSession)
    # watermarks need a time with a zone
    windows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w")).agg(F.collect_list(F.struct("ts", "x", "y", "z")).alias("held"))
    return windows.select(F.col("w.start").alias("start"), "held").mapInPandas(run, "window_start timestamp, n long, clusters long, cores long, noise long")
