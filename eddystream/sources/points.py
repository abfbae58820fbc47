"""Point sources. Every reader gives (seq, x, y, z); seq is the order of the stream.

Text files have no order that a distributed read keeps, so the readers of files
without an id column number lines by file position: byte offsets for text,
record offsets for binary files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddystream.session import stored

POINT = "seq long, x double, y double, z double"


def _numbered_lines(spark: SparkSession, path: str | list[str], each_file: bool = False) -> DataFrame:
    """(seq, file, value) of lines, numbered by file name and place in the file: those that aren't blank over all files, or all of ``each_file`` by itself.

    A file is read in blocks; counting each block's lines first gives every
    block its first number, and lines then count on within their block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines if each_file else lines.where(F.trim("value") != "")
    lines = lines.withColumn("_row", F.monotonically_increasing_id())
    counts = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    order = Window.partitionBy("file").orderBy("_block") if each_file else Window.orderBy("file", "_block")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).select("file", "_block", "_first", "_before")  # a row a block of a file
    return lines.join(counts, ["file", "_block"]).select((F.col("_row") - F.col("_first") + F.col("_before")).alias("seq"), "file", "value")


def _text_points(spark: SparkSession, path: str, sep: str, fields: tuple[int, ...], skip: int) -> DataFrame:
    parts = F.split(F.trim("value"), sep)
    lines = _numbered_lines(spark, path).where(F.col("seq") >= skip)
    xyz = [parts[i].cast("double") for i in fields] + [F.lit(0.0)] * (3 - len(fields))
    return lines.select((F.col("seq") - skip).alias("seq"), *(c.alias(n) for c, n in zip(xyz, "xyz", strict=True)))


def read_csv_3d(spark: SparkSession, path: str) -> DataFrame:
    """Lines of three numbers with commas, without a header."""
    return _text_points(spark, path, ",", (0, 1, 2), 0)


def read_csv_2d(spark: SparkSession, path: str) -> DataFrame:
    """A header, then lines of at least two numbers with commas."""
    return _text_points(spark, path, ",", (0, 1), 1)


def read_spaced_2d(spark: SparkSession, path: str) -> DataFrame:
    """A header, then lines of id, x, y and class with blanks."""
    return _text_points(spark, path, r"\s+", (1, 2), 1)


def read_lines_1d(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    """A line to skip, then one number a line."""
    return _text_points(spark, path, ",", (0,), skip)


def read_binary_3d(spark: SparkSession, path: str) -> DataFrame:
    """Files of little-endian doubles, three a record, in the order of their names.

    Hadoop's reader of records of one length splits a file anywhere between two
    records and says where each starts, so a file of any size is read by many tasks from
    any store. A file that ends within a record is an error.
    """
    sc, before, parts = spark.sparkContext, 0, []
    # a row a file, as a listing has them
    for r in spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect():
        if r["length"]:
            records = sc.newAPIHadoopFile(
                r["path"], "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
                conf={"fixedlengthinputformat.record.length": str(RECORD)},
            )
            parts.append(records.map(_from(before)))
            before += r["length"] // RECORD
    both = spark.createDataFrame(sc.union(parts) if parts else sc.emptyRDD(), "seq long, record binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            xyz = np.frombuffer(b"".join(b.column("record").to_pylist()), "<f8").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("seq"), *(pa.array(xyz[:, j].copy()) for j in range(3))], ["seq", "x", "y", "z"])

    return both.mapInArrow(decode, POINT)


#: Bytes of a binary record.
RECORD = 24


def _from(before: int) -> Callable[[tuple], tuple]:
    return lambda kv: (before + kv[0] // RECORD, bytearray(kv[1]))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tao": read_csv_3d, "geolife": read_binary_3d, "rbf": read_csv_2d, "eds": read_spaced_2d, "stk": read_lines_1d, "stock": read_lines_1d,
}


def read_points(spark: SparkSession, path: str, kind: str | None = None, n: int | None = None) -> DataFrame:
    """The reader for ``kind``, or for the kind that the file's name contains; the first ``n`` rows if asked."""
    name = path.rsplit("/", 1)[-1].lower()
    found = kind or next((k for k in READERS if k in name), None)
    if found not in READERS:
        raise ValueError(f"no reader for {path!r}; kinds are {sorted(READERS)}")
    points = READERS[found](spark, path)
    return points if n is None else points.where(F.col("seq") < n)


def trajectories(spark: SparkSession, paths: str | list[str], skip: int = 6, altitude_unit: float = 300_000.0) -> DataFrame:
    """Trajectory files (lat, lon, _, altitude, day, ...) without the first ``skip`` lines of each, as points in the order of their days.

    Rows of one day go by file and line. Lines that lack one of the four
    numbers are left out.
    """
    parts = F.split("value", ",")
    rows = _numbered_lines(spark, paths, each_file=True).where(F.col("seq") >= skip)
    field = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("double")
    rows = rows.select("file", F.col("seq").alias("line"), *(field(i).alias(n) for i, n in ((0, "x"), (1, "y"), (3, "alt"), (4, "day"))))
    rows = rows.where("x is not null and y is not null and alt is not null and day is not null").withColumn("z", F.col("alt") / altitude_unit)
    return numbered(rows.drop("alt"), "day", "file", "line").select("seq", "x", "y", "z")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place in ``order`` as seq: sorted by ranges, each range starting where those before it end."""
    number = F.monotonically_increasing_id()  # the range's number above 33 bits of the place in it
    # written, so that ranges and places hold
    kept = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", number), "ranges")
    part = F.shiftright("_n", 33).alias("_part")
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = kept.groupBy(part).agg(F.count("*").alias("_k")).select("_part", before.alias("_before"))  # a row a range
    joined = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn("seq", F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_n", "_part", "_before")


def even(seed: int, *names: str) -> Column:
    """A number from 0 to 1, the same for the same values of ``names`` wherever and however often it is made."""
    text = F.concat_ws(":", F.lit(str(seed)), *names)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_points(spark: SparkSession, n: int, dims: int = 3, seed: int = 0) -> DataFrame:
    """``n`` points even in the unit cube of ``dims`` dimensions, by hashes of their numbers."""
    axes = [even(seed + i, "id").alias(a) if i < dims else F.lit(0.0).alias(a) for i, a in enumerate("xyz")]
    return spark.range(n).select(F.col("id").alias("seq"), *axes)


def uniform_vectors(spark: SparkSession, n: int, dims: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("seq"), F.array(*(even(seed + i, "id") for i in range(dims))).alias("v"))


def sample_points(spark: SparkSession) -> DataFrame:
    """The corners of a cube with side 2 around the origin: the smallest input worth a look."""
    rows = [(i, float((i >> 2) * 2 - 1), float((i >> 1 & 1) * 2 - 1), float((i & 1) * 2 - 1)) for i in range(8)]
    return spark.createDataFrame(rows, POINT)


def phase_times(spark: SparkSession, path: str) -> DataFrame:
    """(phase, ms) of the lines ``[Time] phase: number`` of logs."""
    at = r"\[Time\] ([^:]+): *([0-9.]+)"
    found = spark.read.text(path).select(F.regexp_extract("value", at, 1).alias("phase"), F.regexp_extract("value", at, 2).alias("ms"))
    return found.where("phase <> ''").select("phase", F.col("ms").cast("double").alias("ms"))


# ---- adapters ----------------------------------------------------------------


def _adapt(df: DataFrame, seq: Column, *xyz: Column) -> DataFrame:
    full = [*xyz, *[F.lit(0.0)] * (3 - len(xyz))]
    return df.select(seq.cast("long").alias("seq"), *(c.cast("double").alias(n) for c, n in zip(full, "xyz", strict=True)))


def events_points(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    """Events as points: value; with the user's number; with the time of day."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    axes = [F.col("value"), F.col("user_id") / F.lit(10), F.hour("ts") + F.minute("ts") / F.lit(60.0)]
    return _adapt(df, F.col("event_id"), *axes[:dims])


def orders_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapt(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey"), F.col("o_totalprice"))


def checked(points: DataFrame) -> DataFrame:
    """``points``; a null or non-finite coordinate or a null seq fails the query."""
    bad = F.col("seq").isNull()
    for a in "xyz":
        bad = bad | F.col(a).isNull() | F.isnan(a) | (F.abs(a) == float("inf"))
    seq = F.when(bad, F.raise_error(F.lit("a point needs a seq and finite coordinates")).cast("long")).otherwise(F.col("seq"))
    return points.withColumn("seq", seq)
