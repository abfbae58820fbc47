"""Connected components by alternating large and small stars, all in DataFrames.

Each round replaces a node's edges by edges to its smallest neighbour: the
minimum of each node is a partial aggregate, and what is joined back is only as
large as the edges, so a hub of any degree is split by Spark's skew join. Rounds
are written to the shared folder; the number of rounds is logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddystream.session import dropped, stored


def _done(edges: DataFrame) -> bool:
    """Whether all edges are stars: no node has two centres, and no centre has one."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("hub")).union(edges.select("b", F.lit(0), F.lit(1)))
    tangled = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("hub").alias("hub")).where("up > 1 or (up = 1 and hub = 1)")
    return not tangled.limit(1).count()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    # stored: Spark splits the rows of a hub only where nothing but shuffles lies under the join
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    return (
        both.join(least, "a").where("b > a")
        .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    return (
        down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b"))).distinct()
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """``edges`` (two columns of one orderable type) to rows (node, component): the smallest node reachable.

    Loops and repeated edges do no harm; nulls link nothing. Only nodes that
    have an edge to another node appear.
    """
    a, b = edges.columns
    # the larger end first, so that stars are seen as such from the start
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a) != F.col(b)).alias("ok")).where("ok").drop("ok").distinct()
    now = stored(now, f"{label}-edges")
    while not _done(now):
        large = stored(_large(now), f"{label}-stars")
        new = stored(_small(large), f"{label}-stars")
        dropped(large)
        dropped(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
