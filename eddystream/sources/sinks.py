"""Where results go."""

from __future__ import annotations

from dataclasses import asdict
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eddystream.params import DbscanParams


def write_results(result: DataFrame, path: str) -> None:
    """Results by window: later reads of some windows touch only their folders."""
    result.repartition("window_id").sortWithinPartitions("window_id", "pos").write.mode("overwrite").partitionBy("window_id").parquet(path)


def stream_results(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished windows; files and checkpoint make each window land once."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def packed(points: DataFrame) -> DataFrame:
    """Points as records of three little-endian doubles, for a binary dump: (seq, record)."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            xyz = np.stack([b.column(a).to_numpy() for a in "xyz"], 1).astype("<f8")
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array([r.tobytes() for r in xyz], pa.binary())], ["seq", "record"])

    return points.select("seq", "x", "y", "z").mapInArrow(pack, "seq long, record binary")


def write_binary(points: DataFrame, path: str) -> None:
    """One file of such records in the order of seq, in whatever store ``path`` names.

    A raw file has one writer, the driver, which takes the rows partition by
    partition and never holds more than two.
    """
    sc = points.sparkSession.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        rows = packed(points.repartitionByRange("seq").sortWithinPartitions("seq")).select("record").toLocalIterator()
        while some := b"".join(bytes(r[0]) for r in islice(rows, 65_536)):
            out.write(some)
    finally:
        out.close()


def config_log(p: DbscanParams, **more: object) -> str:
    """The settings of a run as the lines that a log begins with, in the order of their names."""
    return "\n".join(f"[Config] {k}: {v}" for k, v in sorted((asdict(p) | more).items()))


def time_report(progress: list[dict]) -> dict[str, float]:
    """Mean milliseconds of each phase over the batches of a streaming query's progress."""
    sums: dict[str, list[float]] = {}
    for p in progress:
        for phase, ms in (p.get("durationMs") or {}).items():
            sums.setdefault(phase, []).append(float(ms))
    return {phase: sum(v) / len(v) for phase, v in sums.items()}
