"""Times the headline queries, and clustering at published settings, and prints one JSON line.

Each query runs once to warm up, as the published numbers were taken after
warm-up passes, and is then timed into Spark's "noop" sink, which computes every
row. ``ms_per_slide`` divides a clustering query's time by its windows.
``published`` has the windows, strides, radii and MinPts of published runs over
generated streams (the data sets aren't to be had), beside what was published.
BENCH_SWEEP=1 adds those runs with other windows, strides, radii and MinPts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "dbscan_windows_1d", "dbscan_windows_2d", "dbscan_windows_3d", "dbscan_windows_dense", "dbscan_windows_orders",
    "neighbor_counts_incremental", "eps_join_pairs", "core_points", "grid_dense_cells", "cluster_summary",
)


#: key: settings, rows, widths of the box that points fill evenly, published milliseconds a slide.
PUBLISHED = {
    "stk": ("stk", 900_000, (100.0,), 0.849248),
    "rbf": ("rbf", 40_000, (1.0, 1.0), 0.449634),
    "tao": ("tao", 575_468, (20.0, 20.0, 20.0), 0.627923),
    "geo": ("geolife", 1_800_000, (1.0, 1.0, 0.1), 2.3125),
}
#: key, what is changed, its values, published milliseconds a slide for each.
SWEEPS = (
    ("stk", "window", (50_000, 100_000, 200_000), (0.554731, 0.82438, 1.31843)),
    ("rbf", "window", (2_500, 5_000, 10_000, 20_000), (0.392743, 0.412964, 0.461149, 0.481494)),
    ("tao", "window", (5_000, 10_000, 20_000, 40_000), (0.466426, 0.621629, 0.893692, 1.16426)),
    ("tao", "stride", (100, 500, 1_000, 2_500), (0.622362, 0.62325, 0.625237, 0.635083)),
    ("rbf", "stride", (100, 500, 1_000, 2_500), (0.434283, 0.442253, 0.447933, 0.454834)),
    ("tao", "radius", (1.15, 1.25, 1.35, 1.45, 1.55), (0.655035, 0.641256, 0.650129, 0.627236, 0.645862)),
    ("tao", "min_pts", (2, 4, 6, 8, 10, 12, 14), (0.61176, 0.612657, 0.621792, 0.638873, 0.65647, 0.66728, 0.678002)),
)


def timed(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def slide_ms(spark, key: str, **other) -> float:
    """Milliseconds a slide of one run, its data in memory as where the published ones were taken."""
    from pyspark.sql import functions as F

    from eddystream.operators.cluster import dbscan_windows
    from eddystream.params import PRESETS
    from eddystream.sources.points import uniform_points

    preset, rows, widths, _ = PUBLISHED[key]
    p = PRESETS[preset]
    if "window" in other:  # the stride goes with the window
        other["stride"] = other["window"] * p.stride // p.window
    p = p.with_(**other)
    made = uniform_points(spark, rows, len(widths), 1)
    points = made.select("seq", *((F.col(a) * (widths[i] if i < len(widths) else 0.0)).alias(a) for i, a in enumerate("xyz"))).cache()
    points.count()
    timed(dbscan_windows(points, p))
    took = timed(dbscan_windows(points, p))
    points.unpersist()
    return round(1000 * took / ((rows - p.window) // p.stride), 4)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from eddystream.plans import catalog

    run, took, slides = catalog.queries(), {}, {}
    for name in HEADLINE:
        for _ in range(2):
            took[name] = round(timed(run[name](spark, sf)), 3)
        if name.startswith("dbscan_windows"):
            windows = run[name](spark, sf).select("window_id").distinct().count()
            slides[name] = round(1000 * took[name] / max(1, windows), 3)
    published = {k: {"ms_per_slide": slide_ms(spark, k), "published": v[3]} for k, v in PUBLISHED.items()}
    more = {}
    if os.environ.get("BENCH_SWEEP"):
        for key, what, values, known in SWEEPS:
            more[f"{key}_{what}"] = {str(v): {"ms_per_slide": slide_ms(spark, key, **{what: v}), "published": k} for v, k in zip(values, known, strict=True)}
    print(json.dumps({"metric": "headline queries, warm, seconds in all", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "ms_per_slide": slides, "published": published, **({"sweeps": more} if more else {}), "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
