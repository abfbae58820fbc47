"""All queries of the engine over the driver's tables, each with SQL that says the same in another way where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddystream.functions.geometry import box, cell, cell_centre, dense_side, distance, dot, join_side, length
from eddystream.operators import cluster, neighbors, report, windows
from eddystream.operators.vectors import vector_labels
from eddystream.params import DbscanParams
from eddystream.session import scratch, stored
from eddystream.sources import points as src
from eddystream.sources.sinks import write_binary, write_results
from eddystream.streaming.windows import cluster_stream, event_time_windows

P1 = DbscanParams(2000, 500, 4, 0.055, 1)
P2 = DbscanParams(2000, 500, 4, 1.0, 2)
P3 = DbscanParams(2000, 500, 6, 2.5, 3)
DENSE = DbscanParams(2000, 500, 4, 2.0, 2)
TUMBLE = DbscanParams(1000, 1000, 4, 1.0, 2)
ORDERS = DbscanParams(2000, 500, 4, 300.5, 1)

_PARAMS = {"1": P1, "2": P2, "3": P3, "d": DENSE, "t": TUMBLE, "o": ORDERS}


def _points(spark: SparkSession, sf: str, which: str) -> DataFrame:
    points = src.orders_points(spark, sf) if which == "o" else src.events_points(spark, sf, _PARAMS[which].dims)
    return src.checked(points)


def _on(which: str, f: Callable[[DataFrame, DbscanParams], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(_points(spark, sf, which), _PARAMS[which])


# ---- SQL ---------------------------------------------------------------------


def _sql_points(which: str) -> str:
    if which == "o":
        return "SELECT o_orderkey AS seq, o_totalprice AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM orders"
    dims = _PARAMS[which].dims
    y = "CAST(user_id AS DOUBLE) / 10" if dims > 1 else "0.0::DOUBLE"
    z = "hour(ts) + minute(ts) / 60.0::DOUBLE" if dims > 2 else "0.0::DOUBLE"
    return f"SELECT event_id AS seq, value AS x, {y} AS y, {z} AS z FROM events"


def _near(p: DbscanParams, a: str = "a", b: str = "b") -> str:
    return " + ".join(f"({a}.{x} - {b}.{x}) * ({a}.{x} - {b}.{x})" for x in p.axes) + f" < {p.radius!r}::DOUBLE * {p.radius!r}::DOUBLE"


def _sql(which: str, body: str, *, nn: bool = False, comps: bool = False) -> str:
    """``body`` with pts, win (window_id, seq, pos, x, y, z), and pairs, nn, cores, beside, comps, labels as needed."""
    p = _PARAMS[which]
    text = f"""
WITH RECURSIVE pts AS MATERIALIZED ({_sql_points(which)}),
win AS MATERIALIZED (
  SELECT CAST(k AS INTEGER) AS window_id, seq, CAST(seq % {p.window} AS INTEGER) AS pos, x, y, z
  FROM pts, range(1, CAST(greatest((SELECT (count(*) - {p.window}) // {p.stride} FROM pts), 0) AS BIGINT) + 1) w(k)
  WHERE seq >= k * {p.stride} AND seq < k * {p.stride} + {p.window}
)"""
    if nn or comps:
        text += f""",
near AS MATERIALIZED (
  SELECT a.window_id, a.seq AS seq_a, a.pos AS pa, b.seq AS seq_b, b.pos AS pb FROM win a JOIN win b ON a.window_id = b.window_id AND {_near(p)}
),
nn AS MATERIALIZED (SELECT window_id, seq_a AS seq, pa AS pos, count(*) AS nn FROM near GROUP BY ALL),
cores AS MATERIALIZED (SELECT window_id, seq, pos FROM nn WHERE nn >= {p.min_pts}),
labels AS MATERIALIZED (
  SELECT w.window_id, w.seq, w.pos,
         CAST(CASE WHEN c.pos IS NOT NULL THEN 0
              WHEN EXISTS (SELECT 1 FROM near n JOIN cores k ON k.window_id = n.window_id AND k.pos = n.pb WHERE n.window_id = w.window_id AND n.pa = w.pos) THEN 1 ELSE 2 END AS INTEGER) AS label
  FROM win w LEFT JOIN cores c ON c.window_id = w.window_id AND c.pos = w.pos
)"""
    if comps:
        text += """,
edges AS MATERIALIZED (
  SELECT n.window_id, n.pa, n.pb FROM near n SEMI JOIN cores a ON a.window_id = n.window_id AND a.pos = n.pa SEMI JOIN cores b ON b.window_id = n.window_id AND b.pos = n.pb
),
comps(window_id, pos, root) USING KEY (window_id, pos) AS (
  SELECT window_id, pos, pos AS root FROM cores
  UNION
  SELECT e.window_id, e.pb AS pos, min(c.root) AS root
  FROM comps c JOIN edges e ON e.window_id = c.window_id AND e.pa = c.pos JOIN recurring.comps old ON old.window_id = e.window_id AND old.pos = e.pb
  WHERE c.root < old.root GROUP BY e.window_id, e.pb
),
result AS MATERIALIZED (
  SELECT l.window_id, l.seq, l.pos, l.label, CAST(CASE l.label WHEN 0 THEN c.root WHEN 1 THEN b.root ELSE l.pos END AS BIGINT) AS cluster_id
  FROM labels l LEFT JOIN comps c ON c.window_id = l.window_id AND c.pos = l.pos
  LEFT JOIN (SELECT n.window_id, n.pa AS pos, min(c.root) AS root FROM near n JOIN comps c ON c.window_id = n.window_id AND c.pos = n.pb GROUP BY ALL) b
    ON b.window_id = l.window_id AND b.pos = l.pos
)"""
    return text + "\n" + body


def _cells(p: DbscanParams, side: float) -> str:
    return ", ".join(f"CAST(floor({a} / {side!r}::DOUBLE) AS BIGINT) AS c{a}" for a in p.axes)


def _counted(p: DbscanParams) -> str:
    axes = ", ".join(f"c{a}" for a in p.axes)
    return f"(SELECT window_id, {axes}, count(*) AS n_points, min(pos) AS min_pos FROM (SELECT window_id, pos, {_cells(p, dense_side(p))} FROM win) GROUP BY ALL)"


_RESULT = "SELECT window_id, seq, pos, label, cluster_id FROM result"


def _kth_sql(which: str, k: int, sample: int) -> str:
    p = _PARAMS[which]
    d2 = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in p.axes)
    return f"""
WITH pts AS ({_sql_points(which)}), picked AS MATERIALIZED (SELECT * FROM pts ORDER BY md5(CAST(seq AS VARCHAR)), seq LIMIT {sample}),
far AS (
  SELECT a.seq, sqrt(list_extract(list_sort(min({d2}, {k})), {k})) AS distance FROM picked a JOIN picked b ON a.seq <> b.seq GROUP BY a.seq
)"""


# ---- the catalogue -----------------------------------------------------------


#: Rows of a file of the replayed stream at most, and files at least.
FILE_ROWS, FILES = 100_000, 4


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events replayed in their order as a stream of files through the stateful operator; the sink's table is the result.

    The source goes by time of writing: files written side by side would come
    in any order, and windows would go without the rows of one that comes later
    than the operator waits. So each is written after the one before it.
    """
    points, p = _points(spark, sf, "3").withColumn("stream_id", F.lit("events")), _PARAMS["3"]
    folder = scratch(spark, "stream")
    rows = max(1, min(FILE_ROWS, points.count() // FILES))
    points.withColumn("file", F.floor(F.col("seq") / rows)).repartition("file").write.partitionBy("file").parquet(f"{folder}/parts")
    parts = spark.read.schema("file long").parquet(f"{folder}/parts").select("file").distinct()
    for i in sorted(r["file"] for r in parts.collect()):  # a row a file
        spark.read.schema(points.schema).parquet(f"{folder}/parts/file={i}").coalesce(1).write.parquet(f"{folder}/in/{i:09}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = (
        cluster_stream(stream, p).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).outputMode("append").start()
    )
    query.awaitTermination()
    return spark.read.schema("stream_id string, window_id int, seq long, pos int, label int, cluster_id long").parquet(f"{folder}/out").drop("stream_id")


def _event_time(spark: SparkSession, sf: str) -> DataFrame:
    """Events in files of three days each, some rows a file late, as a stream: every window once, whatever batches it is cut into."""
    folder, p = scratch(spark, "event-time"), _PARAMS["3"]
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), "ts")
    day = F.datediff(F.col("ts"), events.agg(F.min("ts")).scalar())
    timed = _points(spark, sf, "3").join(events, "seq").withColumn("file", F.floor(day / 3) + F.when(F.col("seq") % 11 == 0, 1).otherwise(0))
    timed = stored(timed, "timed")
    for i in range(int(timed.agg(F.max("file")).first()[0]) + 1):  # one after the other, as the source goes by time of writing
        timed.where(F.col("file") == i).drop("file").coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    stream = spark.readStream.schema(timed.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = (
        event_time_windows(stream, p, "2 days", "1 day", LATE).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
    )
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n", "cores", "noise")


# ---- readers -----------------------------------------------------------------

LATE = "6 days"


def _written(spark: SparkSession, sf: str, which: str, name: str, value: Column, header: str | None = None) -> str:
    """A folder ``name`` of text files with a line a point, in order, after a header."""
    path = f"{scratch(spark, 'files')}/{name}"
    lines = _points(spark, sf, which).select("seq", value.alias("value"))
    if header is not None:
        lines = lines.union(spark.createDataFrame([(-1, header)], "seq long, value string"))
    lines.repartitionByRange(3, "seq").sortWithinPartitions("seq").select("value").write.text(path)
    return path


def _read(which: str, kind: str, value: Callable[[], Column], header: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Points of events written as a reader's files, and read again by the reader that the folder's name asks for."""
    return lambda spark, sf: src.read_points(spark, _written(spark, sf, which, f"my-{kind}", value(), header))


def _read_binary(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch(spark, 'files')}/geolife.bin"
    write_binary(_points(spark, sf, "3"), path)
    return src.read_points(spark, path)


def _read_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Events as three trajectory files with the usual six lines before them."""
    path = f"{scratch(spark, 'files')}/plt"
    head = ["Geolife trajectory", "WGS 84", "Altitude is in Feet", "Reserved 3", "0,2,255,My Track,0,0,2,8421376", "0"]
    first = spark.createDataFrame([(i - 6, h) for i, h in enumerate(head)], "seq long, value string")
    alt, day = F.hour("ts") * F.lit(1000.0), F.col("event_id") * F.lit(0.25)
    lines = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.concat_ws(",", "value", F.col("user_id") / 10, F.lit("0"), alt, day, F.lit("2024-01-01"), F.lit("00:00:00")).alias("value"))
    for i in range(3):
        own = lines.where(F.col("event_id") % 3 == i).union(first)
        own.coalesce(1).sortWithinPartitions("event_id").select("value").write.text(f"{path}/{i}")
    return src.trajectories(spark, f"{path}/*")


def _timer_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log's lines of phases and times, among others; the mean of each phase."""
    path = f"{scratch(spark, 'files')}/log"
    line = F.concat(F.lit("[Time] "), "event_type", F.lit(": "), F.round(F.abs("value"), 2).cast("decimal(20,2)").cast("string"), F.lit(" ms"))
    spark.read.parquet(f"{sf}/events.parquet").select(F.explode(F.array(line, F.lit("[Step] 1"))).alias("value")).write.text(path)
    return src.phase_times(spark, path).groupBy("phase").agg(F.round(F.avg("ms"), 6).alias("ms"))


def _copied_out(points: DataFrame, p: DbscanParams) -> DataFrame:
    path = scratch(points.sparkSession, "results")
    result = cluster.dbscan_windows(points, p)
    write_results(result, path)
    return points.sparkSession.read.schema(result.schema).parquet(path).select("window_id", "seq", "pos", "label", "cluster_id")


def _damaged(points: DataFrame, p: DbscanParams) -> DataFrame:
    """Problems that the verifier counts in a result of which rows lack, are doubled or have a wrong label or cluster."""
    good = cluster.dbscan_windows(points, p)
    pos = F.col("pos") % 50
    bad = good.where(pos != 0).withColumn("label", F.when(pos == 1, (F.col("label") + 1) % 3).otherwise(F.col("label")))
    bad = bad.withColumn("cluster_id", F.when(pos == 2, F.col("cluster_id") + 1).otherwise(F.col("cluster_id"))).union(good.where(pos == 3))
    return report.verify(bad, points, p).groupBy("problem").agg(F.count("*").alias("n"))


def _merged(points: DataFrame, p: DbscanParams) -> DataFrame:
    """Rows that the verifier finds wrong if all clusters of a window become one."""
    good = cluster.dbscan_windows(points, p)
    one = good.where("label = 0").groupBy("window_id").agg(F.min("cluster_id").alias("one"))
    bad = good.join(one, "window_id", "left").withColumn("cluster_id", F.when(F.col("label") < 2, F.col("one")).otherwise(F.col("cluster_id"))).drop("one")
    return report.verify(bad, points, p).groupBy("window_id", "problem").agg(F.count("*").alias("n"))


def _scan(which: str) -> Callable[[SparkSession, str], DataFrame]:
    axes = _PARAMS[which].axes
    return lambda spark, sf: _points(spark, sf, which).select("seq", *(F.round(a, 6).alias(a) for a in axes))


def _verified(points: DataFrame, p: DbscanParams) -> DataFrame:
    return report.verify(cluster.dbscan_windows(points, p), points, p).agg(F.count("*").alias("violations"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vector_labels(spark.read.parquet(f"{sf}/embeddings.parquet"), 1.21, 3)


def _aabb(points: DataFrame, p: DbscanParams) -> DataFrame:
    rows = windows.count_windows(points, p).join(cluster.sphere_list(points, p).select("window_id", "pos", "radius_x2"), ["window_id", "pos"])
    width = F.col("radius_x2") * F.lit(p.radius / 2)
    return rows.select("window_id", "pos", *(F.round(c, 6).alias(n) for n, c in box(p, width).items()))


_q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "scan_points_1d": (_scan("1"), f"SELECT seq, round(x, 6) AS x FROM ({_sql_points('1')})"),
    "scan_points_2d": (_scan("2"), f"SELECT seq, round(x, 6) AS x, round(y, 6) AS y FROM ({_sql_points('2')})"),
    "scan_points_3d": (_scan("3"), f"SELECT seq, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ({_sql_points('3')})"),
    "row_limit": (lambda s, d: _points(s, d, "1").where("seq < 1234").select("seq"), "SELECT event_id AS seq FROM events WHERE event_id < 1234"),
    "grid_cell_id": (_on("3", lambda pts, p: pts.withColumns(cell(p, join_side(p))).select("seq", "cx", "cy", "cz")), f"SELECT seq, {_cells(P3, join_side(P3))} FROM ({_sql_points('3')})"),
    "grid_cell_centre": (
        _on("2", lambda pts, p: pts.withColumns(cell(p, dense_side(p))).select("seq", *(F.round(c, 6).alias(n) for n, c in cell_centre(p, dense_side(p)).items()))),
        f"SELECT seq, round((cx + 0.5) * {dense_side(P2)!r}::DOUBLE, 6) AS x_centre, round((cy + 0.5) * {dense_side(P2)!r}::DOUBLE, 6) AS y_centre FROM (SELECT seq, {_cells(P2, dense_side(P2))} FROM ({_sql_points('2')}))",
    ),
    "bounds": (
        lambda s, d: _points(s, d, "3").agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max")))),
        f"SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM ({_sql_points('3')})",
    ),
    "count_window_assign": (_on("1", lambda pts, p: windows.count_windows(pts, p).select("window_id", "seq", "pos")), _sql("1", "SELECT window_id, seq, pos FROM win")),
    "tumbling_windows": (_on("t", lambda pts, p: windows.count_windows(pts, p).select("window_id", "seq", "pos")), _sql("t", "SELECT window_id, seq, pos FROM win")),
    "window_bounds": (_on("1", windows.window_bounds), _sql("1", "SELECT window_id, min(seq) AS first_seq, max(seq) AS last_seq FROM win GROUP BY window_id")),
    "grid_cell_counts": (_on("d", lambda pts, p: windows.cell_counts(windows.count_windows(pts, p), p).drop("min_pos")), _sql("d", f"SELECT window_id, cx, cy, n_points FROM {_counted(DENSE)}")),
    "cell_representatives": (_on("d", lambda pts, p: windows.cell_counts(windows.count_windows(pts, p), p).drop("n_points")), _sql("d", f"SELECT window_id, cx, cy, min_pos FROM {_counted(DENSE)}")),
    "grid_dense_cells": (_on("d", lambda pts, p: windows.dense_cells(windows.count_windows(pts, p), p)), _sql("d", f"SELECT * FROM {_counted(DENSE)} WHERE n_points >= {DENSE.min_pts}")),
    "dense_totals": (
        _on("d", lambda pts, p: windows.dense_totals(windows.count_windows(pts, p), p)),
        _sql("d", f"SELECT window_id, count(*) FILTER (n_points >= 4) AS dense_cells, CAST(coalesce(sum(n_points) FILTER (n_points >= 4), 0) AS BIGINT) AS dense_points, CAST(coalesce(sum(n_points) FILTER (n_points < 4), 0) AS BIGINT) AS sparse_points FROM {_counted(DENSE)} GROUP BY window_id"),
    ),
    "grid_cell_offsets": (
        _on("2", lambda pts, p: windows.cell_offsets(windows.count_windows(pts, p), p)),
        _sql("2", f"SELECT window_id, cx, cy, n_points, CAST(sum(n_points) OVER (PARTITION BY window_id ORDER BY cx, cy) - n_points AS BIGINT) AS first FROM {_counted(P2)}"),
    ),
    "eps_join_pairs": (
        _on("3", neighbors.eps_pairs),
        f"WITH pts AS ({_sql_points('3')}) SELECT a.seq AS seq_a, b.seq AS seq_b FROM pts a JOIN pts b ON a.seq < b.seq AND b.seq - a.seq < {P3.window} AND {_near(P3)}",
    ),
    "neighbor_counts": (_on("3", neighbors.neighbor_counts), _sql("3", "SELECT window_id, seq, pos, nn FROM nn", nn=True)),
    "neighbor_counts_incremental": (_on("2", neighbors.neighbor_counts_incremental), _sql("2", "SELECT window_id, seq, pos, nn FROM nn", nn=True)),
    "delta_outgoing": (
        _on("2", neighbors.delta_outgoing),
        f"WITH pts AS MATERIALIZED ({_sql_points('2')}) SELECT CAST(k AS INTEGER) AS window_id, b.seq, -count(*) AS delta FROM range(1, CAST(greatest((SELECT (count(*) - 2000) // 500 FROM pts), 0) AS BIGINT) + 1) w(k) JOIN pts a ON a.seq >= (k - 1) * 500 AND a.seq < k * 500 JOIN pts b ON b.seq >= k * 500 AND b.seq < (k - 1) * 500 + 2000 AND {_near(P2)} GROUP BY k, b.seq",
    ),
    "delta_incoming": (
        _on("2", neighbors.delta_incoming),
        f"""WITH pts AS MATERIALIZED ({_sql_points('2')}), come AS (
  SELECT CAST(k AS INTEGER) AS window_id, a.seq AS sa, b.seq AS sb FROM range(1, CAST(greatest((SELECT (count(*) - 2000) // 500 FROM pts), 0) AS BIGINT) + 1) w(k)
  JOIN pts b ON b.seq >= (k - 1) * 500 + 2000 AND b.seq < k * 500 + 2000 JOIN pts a ON a.seq >= k * 500 AND a.seq < b.seq AND {_near(P2)}
) SELECT window_id, seq, count(*) AS delta FROM (SELECT window_id, sa AS seq FROM come UNION ALL SELECT window_id, sb FROM come) GROUP BY ALL""",
    ),
    "core_points": (_on("3", cluster.core_points), _sql("3", "SELECT window_id, seq, pos FROM cores", nn=True)),
    "point_labels": (_on("2", cluster.point_labels), _sql("2", "SELECT * FROM labels", nn=True)),
    "border_points": (_on("3", cluster.border_points), _sql("3", "SELECT window_id, seq, pos FROM labels WHERE label = 1", nn=True)),
    "noise_points": (_on("3", cluster.noise_points), _sql("3", "SELECT window_id, seq, pos FROM labels WHERE label = 2", nn=True)),
    "sphere_list": (
        _on("d", cluster.sphere_list),
        _sql("d", f"SELECT window_id, 'dense' AS kind, min_pos AS pos, 3 AS radius_x2 FROM {_counted(DENSE)} WHERE n_points >= 4 UNION ALL SELECT window_id, 'sparse', unnest(poss), 2 FROM (SELECT window_id, list(pos) AS poss FROM (SELECT window_id, pos, {_cells(DENSE, dense_side(DENSE))} FROM win) GROUP BY window_id, cx, cy HAVING count(*) < 4)"),
    ),
    "aabb_boxes": (
        _on("d", _aabb),
        _sql("d", f"SELECT w.window_id, w.pos, round(x - r, 6) AS x_min, round(x + r, 6) AS x_max, round(y - r, 6) AS y_min, round(y + r, 6) AS y_max FROM (SELECT *, count(*) OVER c AS n, min(pos) OVER c AS low, CASE WHEN count(*) OVER c >= 4 THEN 3 ELSE 2 END * 1.0::DOUBLE AS r FROM (SELECT window_id, pos, x, y, {_cells(DENSE, dense_side(DENSE))} FROM win) WINDOW c AS (PARTITION BY window_id, cx, cy)) w WHERE n < 4 OR pos = low"),
    ),
    "dense_neighbor_cells": (
        _on("d", cluster.dense_neighbor_cells),
        _sql("d", f"SELECT d.window_id, d.min_pos AS pos_a, e.min_pos AS pos_b FROM {_counted(DENSE)} d JOIN {_counted(DENSE)} e ON d.window_id = e.window_id AND d.min_pos < e.min_pos AND ((d.cx - e.cx) * (d.cx - e.cx) + (d.cy - e.cy) * (d.cy - e.cy)) * {dense_side(DENSE) ** 2!r}::DOUBLE < {4 * DENSE.radius ** 2!r}::DOUBLE WHERE d.n_points >= 4 AND e.n_points >= 4"),
    ),
    "dense_cell_links": (
        _on("d", cluster.dense_cell_links),
        _sql("d", f"SELECT DISTINCT a.window_id, least(a.low, b.low) AS pos_a, greatest(a.low, b.low) AS pos_b FROM (SELECT *, count(*) OVER c AS n, min(pos) OVER c AS low FROM (SELECT window_id, pos, x, y, {_cells(DENSE, dense_side(DENSE))} FROM win) WINDOW c AS (PARTITION BY window_id, cx, cy)) a JOIN (SELECT *, count(*) OVER c AS n, min(pos) OVER c AS low FROM (SELECT window_id, pos, x, y, {_cells(DENSE, dense_side(DENSE))} FROM win) WINDOW c AS (PARTITION BY window_id, cx, cy)) b ON a.window_id = b.window_id AND a.low < b.low AND {_near(DENSE)} WHERE a.n >= 4 AND b.n >= 4"),
    ),
    "dense_collapse_labels": (_on("d", lambda pts, p: cluster.dbscan_windows(pts, p, collapse=True).select("window_id", "seq", "pos", "label")), _sql("d", "SELECT * FROM labels", nn=True)),
    "dbscan_components": (_on("3", cluster.dbscan_components), _sql("3", "SELECT window_id, pos, root FROM comps", comps=True)),
    "dbscan_windows_1d": (_on("1", cluster.dbscan_windows), _sql("1", _RESULT, comps=True)),
    "dbscan_windows_2d": (_on("2", cluster.dbscan_windows), _sql("2", _RESULT, comps=True)),
    "dbscan_windows_3d": (_on("3", cluster.dbscan_windows), _sql("3", _RESULT, comps=True)),
    "dbscan_windows_dense": (_on("d", cluster.dbscan_windows), _sql("d", _RESULT, comps=True)),
    "dbscan_windows_joined": (_on("3", cluster.dbscan_windows_joined), _sql("3", _RESULT, comps=True)),
    "dbscan_windows_tumbling": (_on("t", cluster.dbscan_windows), _sql("t", _RESULT, comps=True)),
    "dbscan_windows_orders": (_on("o", cluster.dbscan_windows), _sql("o", _RESULT, comps=True)),
    "dbscan_static": (
        _on("2", cluster.dbscan_whole),
        f"""
WITH RECURSIVE pts AS MATERIALIZED (SELECT * FROM ({_sql_points('2')})),
near AS MATERIALIZED (SELECT a.seq AS pa, b.seq AS pb FROM pts a JOIN pts b ON {_near(P2)}),
cores AS MATERIALIZED (SELECT pa AS pos FROM near GROUP BY pa HAVING count(*) >= {P2.min_pts}),
edges AS MATERIALIZED (SELECT pa, pb FROM near SEMI JOIN cores a ON a.pos = pa SEMI JOIN cores b ON b.pos = pb),
comps(pos, root) USING KEY (pos) AS (
  SELECT pos, pos AS root FROM cores
  UNION
  SELECT e.pb, min(c.root) FROM comps c JOIN edges e ON e.pa = c.pos JOIN recurring.comps old ON old.pos = e.pb WHERE c.root < old.root GROUP BY e.pb
)
SELECT p.seq, CAST(CASE WHEN c.pos IS NOT NULL THEN 0 WHEN b.root IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS label, coalesce(c.root, b.root, p.seq) AS cluster_id
FROM pts p LEFT JOIN comps c ON c.pos = p.seq LEFT JOIN (SELECT pa AS pos, min(root) AS root FROM near JOIN comps k ON k.pos = pb GROUP BY pa) b ON b.pos = p.seq""",
    ),
    "cluster_sizes": (_on("2", lambda pts, p: report.cluster_sizes(cluster.dbscan_windows(pts, p))), _sql("2", "SELECT window_id, cluster_id, count(*) AS n_points FROM result GROUP BY ALL", comps=True)),
    "cluster_summary": (
        _on("3", lambda pts, p: report.cluster_summary(cluster.dbscan_windows(pts, p), p.min_pts)),
        _sql("3", "SELECT window_id, count(*) FILTER (n >= 6) AS n_clusters, count(*) FILTER (n < 6) AS n_small, CAST(sum(n) - count(*) FILTER (n < 6) AS BIGINT) AS n_points FROM (SELECT window_id, cluster_id, count(*) AS n FROM result GROUP BY ALL) GROUP BY window_id", comps=True),
    ),
    "kth_distance": (
        lambda s, d: report.kth_distance(_points(s, d, "3"), 5, 3).select("seq", F.round("distance", 6).alias("distance")),
        _kth_sql("3", 5, 10_000) + " SELECT seq, round(distance, 6) AS distance FROM far",
    ),
    "estimate_eps": (
        lambda s, d: report.estimate_eps(_points(s, d, "2"), 3, 2).select(F.round("eps", 6).alias("eps")),
        _kth_sql("2", 3, 10_000) + ", ranked AS (SELECT distance, row_number() OVER (ORDER BY distance DESC) - 1 AS i, count(*) OVER () AS n FROM far) SELECT round(distance, 6) AS eps FROM ranked WHERE i = CAST(floor(n * 0.01) AS BIGINT)",
    ),
    "verify_windows": (_on("3", _verified), "SELECT CAST(0 AS BIGINT) AS violations"),
    "rt_counters": (
        _on("2", report.rt_counters),
        _sql("2", f"""SELECT c.window_id, c.candidates, coalesce(n.pairs, 0) AS pairs, d.dense_cells, d.dense_points
FROM (SELECT a.window_id, count(*) AS candidates FROM (SELECT window_id, {_cells(P2, join_side(P2))} FROM win) a JOIN (SELECT window_id, {_cells(P2, join_side(P2))} FROM win) b
      ON a.window_id = b.window_id AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY a.window_id) c
LEFT JOIN (SELECT window_id, count(*) AS pairs FROM near WHERE seq_a < seq_b GROUP BY window_id) n ON n.window_id = c.window_id
JOIN (SELECT window_id, count(*) FILTER (n_points >= 4) AS dense_cells, CAST(coalesce(sum(n_points) FILTER (n_points >= 4), 0) AS BIGINT) AS dense_points FROM {_counted(P2)} GROUP BY window_id) d ON d.window_id = c.window_id""", nn=True),
    ),
    "stream_dbscan": (_stream, _sql("3", _RESULT, comps=True)),
    "stream_event_time": (
        _event_time,
        f"""
WITH pts AS ({_sql_points('3').replace("SELECT event_id AS seq", "SELECT event_id AS seq, ts")}),
win AS MATERIALIZED (
  SELECT s AS start, seq, x, y, z FROM range((SELECT date_trunc('day', min(ts)) - INTERVAL 1 DAY FROM pts), (SELECT max(ts) - INTERVAL {LATE} - INTERVAL 2 DAY FROM pts), INTERVAL 1 DAY) r(s)
  JOIN pts ON ts >= s AND ts < s + INTERVAL 2 DAY
),
near AS MATERIALIZED (SELECT a.start, a.seq, b.seq AS other FROM win a JOIN win b ON a.start = b.start AND {_near(P3)}),
cores AS MATERIALIZED (SELECT start, seq FROM near GROUP BY ALL HAVING count(*) >= {P3.min_pts}),
touched AS (SELECT DISTINCT n.start, n.seq FROM near n SEMI JOIN cores c ON c.start = n.start AND c.seq = n.other)
SELECT strftime(w.start, '%Y-%m-%d') AS window_start, count(*) AS n, count(c.seq) AS cores, count(*) - count(t.seq) AS noise
FROM win w LEFT JOIN cores c ON c.start = w.start AND c.seq = w.seq LEFT JOIN touched t ON t.start = w.start AND t.seq = w.seq GROUP BY w.start""",
    ),
    "read_csv_3d": (_read("3", "tao", lambda: F.concat_ws(",", "x", "y", "z")), f"SELECT seq, x, y, z FROM ({_sql_points('3')})"),
    "read_csv_2d": (_read("2", "rbf", lambda: F.concat_ws(",", "x", "y", F.lit("a")), "x,y,class"), f"SELECT seq, x, y, z FROM ({_sql_points('2')})"),
    "read_spaced_2d": (_read("2", "eds", lambda: F.concat_ws(" ", "seq", "x", "y", F.lit("1")), "id x y class"), f"SELECT seq, x, y, z FROM ({_sql_points('2')})"),
    "read_lines_1d": (_read("1", "stock", lambda: F.col("x").cast("string"), "9.5"), f"SELECT seq, x, y, z FROM ({_sql_points('1')})"),
    "read_binary_3d": (_read_binary, f"SELECT seq, x, y, z FROM ({_sql_points('3')})"),
    "read_trajectories": (_read_trajectories, "SELECT event_id AS seq, value AS x, CAST(user_id AS DOUBLE) / 10 AS y, hour(ts) * 1000.0::DOUBLE / 300000.0::DOUBLE AS z FROM events"),
    "timer_averages": (_timer_averages, "SELECT event_type AS phase, round(avg(CAST(CAST(round(abs(value), 2) AS DECIMAL(20, 2)) AS DOUBLE)), 6) AS ms FROM events GROUP BY event_type"),
    "sample_points": (
        lambda s, d: src.sample_points(s),
        "SELECT i AS seq, CAST(i // 4 * 2 - 1 AS DOUBLE) AS x, CAST(i // 2 % 2 * 2 - 1 AS DOUBLE) AS y, CAST(i % 2 * 2 - 1 AS DOUBLE) AS z FROM range(8) r(i)",
    ),
    "result_copy_out": (_on("2", _copied_out), _sql("2", _RESULT, comps=True)),
    "neighbor_counts_brute": (_on("2", neighbors.brute_force_counts), _sql("2", "SELECT window_id, seq, pos, nn FROM nn", nn=True)),
    "counts_cross_check": (
        _on("2", lambda pts, p: neighbors.differing_counts(neighbors.neighbor_counts_incremental(pts, p).where("pos % 100 <> 7").withColumn("nn", F.col("nn") + F.when(F.col("pos") % 100 == 8, 1).otherwise(0)), neighbors.neighbor_counts(pts, p))),
        _sql("2", "SELECT window_id, pos, CASE pos % 100 WHEN 8 THEN nn + 1 END AS nn, nn AS nn_other FROM nn WHERE pos % 100 IN (7, 8)", nn=True),
    ),
    "sparse_core_counts": (_on("d", neighbors.sparse_counts), _sql("d", f"SELECT window_id, seq, pos, nn >= {DENSE.min_pts} AS core FROM nn", nn=True)),
    "eps_join_pairs_joined": (
        _on("2", neighbors.eps_pairs_joined),
        f"WITH pts AS ({_sql_points('2')}) SELECT a.seq AS seq_a, b.seq AS seq_b FROM pts a JOIN pts b ON a.seq < b.seq AND b.seq - a.seq < {P2.window} AND {_near(P2)}",
    ),
    "sphere_hits": (
        _on("d", cluster.sphere_hits),
        _sql("d", f"""SELECT w.window_id, w.pos, count(*) AS hits FROM win w JOIN (
  SELECT window_id, (cx + 0.5) * {dense_side(DENSE)!r}::DOUBLE AS x, (cy + 0.5) * {dense_side(DENSE)!r}::DOUBLE AS y, 1.5 * {DENSE.radius!r}::DOUBLE AS r FROM {_counted(DENSE)} WHERE n_points >= {DENSE.min_pts}
  UNION ALL SELECT window_id, x, y, {DENSE.radius!r}::DOUBLE FROM (SELECT *, count(*) OVER (PARTITION BY window_id, cx, cy) AS n FROM (SELECT window_id, x, y, {_cells(DENSE, dense_side(DENSE))} FROM win)) WHERE n < {DENSE.min_pts}
) s ON s.window_id = w.window_id AND (s.x - w.x) * (s.x - w.x) + (s.y - w.y) * (s.y - w.y) < s.r * s.r GROUP BY w.window_id, w.pos"""),
    ),
    "dbscan_brute": (_on("3", cluster.brute_force_windows), _sql("3", _RESULT, comps=True)),
    "verify_damaged": (
        _on("3", _damaged),
        _sql("3", "SELECT CASE pos % 50 WHEN 0 THEN 'missing' WHEN 1 THEN 'label' WHEN 2 THEN 'cluster' ELSE 'extra' END AS problem, count(*) AS n FROM result WHERE pos % 50 < 4 GROUP BY 1", comps=True),
    ),
    "verify_merged": (
        _on("3", _merged),
        _sql("3", "SELECT window_id, 'cluster' AS problem, count(*) AS n FROM (SELECT *, min(cluster_id) FILTER (label = 0) OVER (PARTITION BY window_id) AS one FROM result) WHERE label < 2 AND cluster_id <> one GROUP BY window_id", comps=True),
    ),
    "vector_math": (
        lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select(
            "vec_id", F.round(dot("embedding", F.reverse("embedding")), 6).alias("dot"), F.round(length("embedding"), 6).alias("length"), F.round(distance("embedding", F.reverse("embedding")), 6).alias("distance")
        ),
        "SELECT vec_id, round(list_dot_product(e, list_reverse(e)), 6) AS dot, round(sqrt(list_dot_product(e, e)), 6) AS length, round(list_distance(e, list_reverse(e)), 6) AS distance FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
    ),
    "uniform_points": (
        lambda s, d: src.uniform_points(s, 10_000, 3, 7),
        "SELECT i AS seq, " + ", ".join(f"CAST('0x' || substr(md5('{7 + j}:' || i), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS {a}" for j, a in enumerate("xyz")) + " FROM range(10000) r(i)",
    ),
    "vector_dbscan": (
        _vectors,
        """
WITH near AS MATERIALIZED (SELECT a.vec_id, b.vec_id AS other FROM embeddings a JOIN embeddings b ON list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) < 1.21::DOUBLE),
cores AS (SELECT vec_id FROM near GROUP BY vec_id HAVING count(*) >= 3)
SELECT vec_id, CAST(CASE WHEN vec_id IN (SELECT vec_id FROM cores) THEN 0 WHEN bool_or(other IN (SELECT vec_id FROM cores)) THEN 1 ELSE 2 END AS INTEGER) AS label FROM near GROUP BY vec_id""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _q.items() if s}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of the events stream, with a window that fits the smallest table as well."""
    return cluster.dbscan_windows(_points(spark, sf, "3"), P3.with_(window=200, stride=50))
