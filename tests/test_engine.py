"""Sources, window operators and streams on small inputs."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from eddystream.operators import cluster, neighbors, report, windows
from eddystream.params import DbscanParams
from eddystream.sources import points as src
from eddystream.sources.sinks import config_log, packed, time_report, write_binary, write_results
from eddystream.streaming.windows import cluster_stream, event_time_windows

P = DbscanParams(20, 5, 3, 1.2, 2)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def stream_points(spark):
    rng = random.Random(3)
    r = [(i, rng.randint(0, 12) / 2, rng.randint(0, 12) / 2, 0.0) for i in range(63)]
    return spark.createDataFrame(r, src.POINT).cache()


def test_readers(spark, tmp_path):
    (tmp_path / "tao.txt").write_text("".join(f"{i},{i + 0.5},{-i}\n" for i in range(50)))
    (tmp_path / "RBF4_5.csv").write_text("x,y,class\n1,2,a\n3,4,b\n")
    (tmp_path / "EDS.txt").write_text("id x y class\n7 1.5 2.5 0\n8 3.5 4.5 1\n")
    (tmp_path / "stock.txt").write_text("9.5\n1.25\n2.5\n")
    with open(tmp_path / "geolife.bin", "wb") as f:
        f.write(b"".join(struct.pack("<3d", i, 2 * i, 3 * i) for i in range(7)))
    write_binary(src.read_points(spark, str(tmp_path / "geolife.bin")).where("seq >= 2"), str(tmp_path / "geolife2.bin"))
    assert (tmp_path / "geolife2.bin").read_bytes() == (tmp_path / "geolife.bin").read_bytes()[48:]
    assert rows(src.read_binary_3d(spark, str(tmp_path / "geolife*.bin")), "seq", "x") == [(i, float(x)) for i, x in enumerate([0, 1, 2, 3, 4, 5, 6, 2, 3, 4, 5, 6])]
    read = lambda name, **k: rows(src.read_points(spark, str(tmp_path / name), **k), "seq", "x", "y", "z")
    assert read("tao.txt") == [(i, float(i), i + 0.5, float(-i)) for i in range(50)]
    assert read("tao.txt", n=3) == [(i, float(i), i + 0.5, float(-i)) for i in range(3)]
    assert read("RBF4_5.csv", kind="rbf") == [(0, 1.0, 2.0, 0.0), (1, 3.0, 4.0, 0.0)]
    assert read("EDS.txt") == [(0, 1.5, 2.5, 0.0), (1, 3.5, 4.5, 0.0)]
    assert read("stock.txt") == [(0, 1.25, 0.0, 0.0), (1, 2.5, 0.0, 0.0)]
    assert read("geolife.bin") == [(i, float(i), 2.0 * i, 3.0 * i) for i in range(7)]
    with pytest.raises(ValueError):
        src.read_points(spark, "/nowhere/unknown.dat")


def test_lines_of_large_and_several_files_keep_their_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        for name, lo, hi in (("a", 0, 40), ("b", 40, 3000), ("c", 3000, 3100)):
            (tmp_path / f"{name}.csv").write_text("".join(f"{i},0,0\n" for i in range(lo, hi)))
        got = src.read_points(spark, str(tmp_path), kind="tao")
        assert rows(got, "seq", "x") == [(i, float(i)) for i in range(3100)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_trajectories_generators_and_logs(spark, tmp_path):
    head = "Geolife trajectory\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n"
    (tmp_path / "one.plt").write_text(head + "1,2,0,300000,39000.5,d,t\n3,4,0,600000,38000.5,d,t\nbad,4,0,0,1,d,t\n\n5,6\n")
    (tmp_path / "two.plt").write_text("1,2,0,300000,1,d,t\n" * 6 + "7,8,0,0,38500,d,t\n")
    assert rows(src.trajectories(spark, str(tmp_path / "one.plt")), "seq", "x", "y", "z") == [(0, 3.0, 4.0, 2.0), (1, 1.0, 2.0, 1.0)]
    assert rows(src.trajectories(spark, str(tmp_path / "*.plt")), "seq", "x") == [(0, 3.0), (1, 7.0), (2, 1.0)]
    assert src.trajectories(spark, str(tmp_path / "two.plt"), skip=0).count() == 7
    assert rows(src.uniform_points(spark, 100, 2, 1), "seq", "x") == rows(src.uniform_points(spark, 100, 2, 1).repartition(7), "seq", "x")
    assert config_log(P, file="tao.txt").splitlines()[:2] == ["[Config] dims: 2", "[Config] file: tao.txt"]
    assert src.uniform_points(spark, 100, 2, 1).where("x < 0 or x >= 1 or z <> 0").count() == 0
    assert src.sample_points(spark).count() == 8
    assert len(src.uniform_vectors(spark, 3, 9).first()["v"]) == 9
    (tmp_path / "log.txt").write_text("noise\n[Time] total: 1.5 ms\n[Time] grid: 0.25 ms\n")
    assert rows(src.phase_times(spark, str(tmp_path / "log.txt")), "phase", "ms") == [("grid", 0.25), ("total", 1.5)]
    assert time_report([{"durationMs": {"a": 2}}, {"durationMs": {"a": 4}}]) == {"a": 3.0}


def test_windows_leave_out_the_first_and_a_part_of_a_stride(spark, stream_points):
    w = windows.count_windows(stream_points, P)
    assert rows(windows.window_bounds(stream_points, P), "window_id", "first_seq", "last_seq") == [(k, 5 * k, 5 * k + 19) for k in range(1, 9)]
    assert rows(w.groupBy("window_id").agg(F.count("*").alias("n"), F.min("seq").alias("a")), "window_id", "n", "a") == [(k, 20, 5 * k) for k in range(1, 9)]
    few = stream_points.where("seq < 24")
    assert windows.count_windows(few, P).count() == 0 and cluster.dbscan_windows(few, P).count() == 0
    assert windows.window_bounds(few, P).count() == 0


def test_all_ways_to_count_agree(spark, stream_points):
    want = rows(neighbors.brute_force_counts(stream_points, P), "window_id", "seq", "pos", "nn")
    assert rows(neighbors.neighbor_counts(stream_points, P), "window_id", "seq", "pos", "nn") == want
    assert rows(neighbors.neighbor_counts_incremental(stream_points, P), "window_id", "seq", "pos", "nn") == want
    assert neighbors.differing_counts(neighbors.neighbor_counts(stream_points, P), neighbors.brute_force_counts(stream_points, P)).count() == 0
    cores = {(w, s) for w, s, _, n in want if n >= P.min_pts}
    assert {tuple(r) for r in cluster.core_points(stream_points, P).select("window_id", "seq").collect()} == cores
    pairs = rows(neighbors.eps_pairs(stream_points, P), "seq_a", "seq_b")
    assert pairs == rows(neighbors.eps_pairs_joined(stream_points, P), "seq_a", "seq_b") and len(pairs) == len(set(pairs)) > 0
    assert rows(cluster.joined_labels(stream_points, P), "window_id", "pos", "label") == rows(cluster.point_labels(stream_points, P), "window_id", "pos", "label")
    moved = stream_points.select("seq", (F.col("x") - 1000).alias("x"), (F.col("y") + 77).alias("y"), "z")
    assert rows(neighbors.neighbor_counts(moved, P), "window_id", "seq", "pos", "nn") == want


def test_deltas_lead_from_one_window_to_the_next(spark, stream_points):
    counts = {(w, s): n for w, s, n in rows(neighbors.brute_force_counts(stream_points, P), "window_id", "seq", "nn")}
    out = {(w, s): d for w, s, d in rows(neighbors.delta_outgoing(stream_points, P), "window_id", "seq", "delta")}
    come = {(w, s): d for w, s, d in rows(neighbors.delta_incoming(stream_points, P), "window_id", "seq", "delta")}
    for k in range(2, 9):
        for s in range(5 * k, 5 * k + 20):
            before = counts[k - 1, s] if s < 5 * (k - 1) + 20 else 1
            assert before + out.get((k, s), 0) + come.get((k, s), 0) == counts[k, s]


def test_joined_and_grouped_clusters_agree_and_verify(spark, stream_points):
    cols = ("window_id", "seq", "pos", "label", "cluster_id")
    got = cluster.dbscan_windows(stream_points, P).cache()
    assert rows(got, *cols) == rows(cluster.dbscan_windows_joined(stream_points, P), *cols)
    assert rows(got, *cols) == rows(cluster.dbscan_windows(stream_points.orderBy(F.desc("seq")), P, collapse=False), *cols)
    assert {r["label"] for r in got.collect()} == {0, 1, 2}
    assert rows(got, *cols) == rows(cluster.brute_force_windows(stream_points, P), *cols)
    assert report.verify(got, stream_points, P).count() == 0
    assert report.verify(got.where("pos < 0"), stream_points, P).groupBy("problem").count().collect() == [("missing", 160)]
    one = got.where("label = 0").groupBy("window_id").agg(F.min("cluster_id").alias("one"))
    merged = got.join(one, "window_id").withColumn("cluster_id", F.when(F.col("label") < 2, F.col("one")).otherwise(F.col("cluster_id"))).drop("one")
    assert {r["problem"] for r in report.verify(merged, stream_points, P).collect()} == {"cluster"}
    assert {r["problem"] for r in report.verify(got.union(got.where("pos = 3")), stream_points, P).collect()} == {"extra"}
    wrong = got.withColumn("cluster_id", F.when(F.col("label") == 0, F.col("cluster_id") + F.col("pos") % 2).otherwise(F.col("cluster_id")))
    assert report.verify(wrong, stream_points, P).count() > 0
    s = report.cluster_summary(got, 3).orderBy("window_id").first()
    sizes = [r["n_points"] for r in report.cluster_sizes(got).where("window_id = 1").collect()]
    assert (s["n_clusters"], s["n_small"]) == (sum(n >= 3 for n in sizes), sum(n < 3 for n in sizes))


@pytest.mark.parametrize("p", [P, DbscanParams(20, 5, 1, 0.4, 2), DbscanParams(20, 5, 5, 0.6, 1), DbscanParams(20, 5, 4, 1.5, 3)])
def test_all_rows_are_clustered_at_once(spark, p):
    rng = random.Random(5)
    at = {i: tuple(rng.choice((-0.0, 0.0, 0.25)) if a == 2 else rng.randint(-40, 40) / 4 for a in range(3)) for i in range(400)}
    points = spark.createDataFrame([(i, *x) for i, x in at.items()], src.POINT)
    near = {i: [j for j in at if sum((a - b) ** 2 for a, b in zip(at[i][: p.dims], at[j][: p.dims])) < p.radius**2] for i in at}
    root = {i: i for i in at if len(near[i]) >= p.min_pts}
    while any((low := min(root[j] for j in near[i] if j in root)) < root[i] and not root.update({i: low}) for i in list(root)):
        pass
    want = []
    for i in at:
        beside = [root[j] for j in near[i] if j in root]
        want.append((i, 0, root[i]) if i in root else (i, 1, min(beside)) if beside else (i, 2, i))
    assert rows(cluster.dbscan_whole(points.repartition(3), p), "seq", "label", "cluster_id") == want
    assert rows(cluster.dbscan_static(points, p, 400), "seq", "label", "cluster_id") == want
    assert cluster.dbscan_whole(points.where("seq < 0"), p).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_the_whole_static_query_has_every_event(spark):
    from eddystream.plans import catalog

    sf, cols = "/root/testdata/sf0.01", ("seq", "label", "cluster_id")
    points = src.events_points(spark, sf, 2)
    got = rows(catalog.queries()["dbscan_static"](spark, sf), *cols)
    assert len(got) == points.count()
    assert got == rows(cluster.dbscan_static(points, catalog.P2, len(got)), *cols)


def test_tumbling_and_minimal_points(spark, stream_points):
    for p in (DbscanParams(20, 20, 3, 1.2, 2), DbscanParams(20, 5, 1, 1.2, 2), DbscanParams(20, 4, 2, 50.0, 1)):
        cols = ("window_id", "seq", "label", "cluster_id")
        assert rows(cluster.dbscan_windows(stream_points, p), *cols) == rows(cluster.dbscan_windows_joined(stream_points, p), *cols)


@pytest.mark.parametrize("p", [DbscanParams(20, 5, 3, 1.0, 1), DbscanParams(20, 5, 1, 0.3, 1), DbscanParams(20, 5, 4, 0.7, 1, "float"), DbscanParams(20, 5, 2, 0.07, 1)])
def test_points_on_a_line(spark, p):
    rng = random.Random(8)
    pts = spark.createDataFrame([(i, rng.choice((rng.randint(0, 40) / 10, rng.randint(0, 300) / 100, -1e6)), 0.0, 0.0) for i in range(83)], src.POINT)
    cols = ("window_id", "seq", "pos", "label", "cluster_id")
    assert rows(cluster.dbscan_windows(pts, p), *cols) == rows(cluster.brute_force_windows(pts, p), *cols)
    assert rows(neighbors.neighbor_counts_incremental(pts, p), "window_id", "pos", "nn") == rows(neighbors.brute_force_counts(pts, p), "window_id", "pos", "nn")


def test_bad_points_fail(spark):
    for bad in ((1, None, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (None, 1.0, 0.0, 0.0), (1, float("inf"), 0.0, 0.0)):
        with pytest.raises(Exception, match="finite"):
            src.checked(spark.createDataFrame([bad], src.POINT)).collect()


def test_eps_of_a_line(spark):
    pts = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(100)], src.POINT)
    far = {s: d for s, d in rows(report.kth_distance(pts, 2, 1), "seq", "distance")}
    assert far[0] == 2.0 and far[50] == 1.0
    assert report.estimate_eps(pts, 2, 1).first()["eps"] == 2.0
    assert report.kth_distance(pts.limit(2), 5, 1).where("distance is null").count() == 2


def test_results_and_records_are_written(spark, stream_points, tmp_path):
    write_results(cluster.dbscan_windows(stream_points, P), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("window_id = 3").count() == 20
    r = packed(stream_points).join(stream_points, "seq").where("seq = 1").first()
    assert struct.unpack("<3d", bytes(r["record"])) == (r["x"], r["y"], r["z"])


def test_stream_gives_the_batch_result_in_any_order(spark, stream_points, tmp_path):
    pts = stream_points.withColumn("stream_id", F.lit("a"))
    other = stream_points.withColumn("stream_id", F.lit("b")).withColumn("x", F.col("x") * 3)
    parts = [pts.where("seq >= 40"), pts.where("seq < 11"), other.where("seq < 30"), pts.where("seq >= 5 and seq < 40"), other.where("seq >= 30")]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = (
        cluster_stream(stream, P).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    cols = ("window_id", "seq", "pos", "label", "cluster_id")
    for name, batch in (("a", pts), ("b", other)):
        assert rows(got.where(F.col("stream_id") == name), *cols) == rows(cluster.dbscan_windows(batch.drop("stream_id"), P), *cols)


def test_a_stream_that_lacks_rows_goes_on_without_them(spark, stream_points, tmp_path):
    pts = stream_points.withColumn("stream_id", F.lit("a"))
    for i, part in enumerate((pts.where("seq < 11"), pts.where("seq > 12 and seq < 50"), pts.where("seq >= 50"), pts.where("seq in (11, 12)"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = (
        cluster_stream(stream, P, patience=10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    held = {k: n for k, n in got.groupBy("window_id").count().collect()}
    # windows 1 and 2 lack rows 11 and 12; all have come out once, the late rows are dropped
    assert held == {k: 18 if k < 3 else 20 for k in range(1, 9)}
    want = cluster.dbscan_windows(stream_points, P).where("window_id > 2")
    cols = ("window_id", "seq", "pos", "label", "cluster_id")
    assert rows(got.where("window_id > 2"), *cols) == rows(want, *cols)


def test_a_replay_longer_than_the_stream_waits_equals_its_sql(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    from eddystream.plans import catalog

    small = catalog.P3.with_(window=20, stride=5, min_pts=4)
    monkeypatch.setattr(catalog, "P3", small)
    monkeypatch.setitem(catalog._PARAMS, "3", small)
    monkeypatch.setattr(catalog, "FILE_ROWS", 700, raising=False)  # a window waits for 200 rows
    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 7 MINUTE AS ts, i * 37 % 50 AS user_id, (i * 7919 % 50) / 10.0::DOUBLE AS value FROM range(3999, -1, -1) r(i)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    cols = ("window_id", "seq", "pos", "label", "cluster_id")
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({catalog._sql('3', catalog._RESULT, comps=True)})").fetchall())
    assert {r[3] for r in want} == {0, 1, 2} and len(want) == 20 * 796
    assert rows(catalog.queries()["stream_dbscan"](spark, str(tmp_path)), *cols) == want


def test_event_time_windows_come_out_once(spark, tmp_path):
    rng = random.Random(2)
    made = [(i, i * 60 + rng.randint(0, 1800), rng.randint(0, 9) / 2, rng.randint(0, 9) / 2) for i in range(300)]
    all_ = spark.createDataFrame(made, "i long, at long, x double, y double").select("i", F.timestamp_seconds(F.col("at") + 1704067200).alias("ts"), "x", "y", F.lit(0.0).alias("z"))
    for i in range(10):  # windows are cut by every batch
        all_.where(F.col("i") % 300 >= 30 * i).where(F.col("i") < 30 * (i + 1)).drop("i").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(all_.drop("i").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = (
        event_time_windows(stream, P, "30 minutes", "15 minutes", "40 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("append").start()
    )
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(F.unix_timestamp("window_start"), "n", "cores", "noise").collect()]
    newest, want = max(at for _, at, _, _ in made), []
    for start in range(-900, newest, 900):
        held = [(x, y) for _, at, x, y in made if start <= at < start + 1800]
        if held and start + 1800 <= newest - 2400:
            near = [[(a - c) ** 2 + (b - d) ** 2 < P.radius**2 for c, d in held] for a, b in held]
            core = [sum(n) >= P.min_pts for n in near]
            want.append((start + 1704067200, len(held), sum(core), sum(not any(n and c for n, c in zip(row, core, strict=True)) for row in near)))
    assert sorted(got) == want and len(want) > 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["dbscan_windows_2d", "neighbor_counts_incremental", "sphere_list", "window_bounds", "verify_damaged", "read_binary_3d", "read_trajectories", "stream_event_time"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from eddystream.plans import catalog

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, *sorted(got.columns)) == sorted(con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_the_entry_module_has_sql_only_for_its_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
