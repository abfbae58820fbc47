"""Density clustering of vectors of any length: an extension, by blocks of comparisons, for which a grid is no help."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddystream.session import ship, stored

#: Vectors of a block: a task compares two blocks, as a product of matrices.
BLOCK = 4096


def _met(vectors: DataFrame, n: int, schema: str, answer: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], radius: float) -> DataFrame:
    """What ``answer`` gives for the rows of every two blocks of ``vectors`` and the matrix of who is near whom, pairs of one block only in its own task."""
    blocks = max(1, math.ceil(n / BLOCK))
    each = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = each.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, block = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["block"].to_numpy()
        square = (x * x).sum(1)
        near = np.zeros((len(x), len(x)), bool)
        for i in range(0, len(x), 512):
            d2 = square[i : i + 512, None] + square - 2 * (x[i : i + 512] @ x.T)
            near[i : i + 512] = d2 < radius * radius
            for a, b in np.argwhere(np.abs(d2 - radius * radius) < 1e-9 * (1 + square.max())):  # too close to call by products
                near[i + a, b] = np.sqrt(((x[i + a] - x[b]) ** 2).sum()) < radius
        if pdf["low"].iloc[0] != pdf["high"].iloc[0]:
            near &= block[:, None] != block
        return answer(pdf, near)

    ship(vectors.sparkSession)
    return each.groupBy("low", "high").applyInPandas(run, schema)


def vector_core_counts(vectors: DataFrame, radius: float) -> DataFrame:
    """(vec_id, nn) of ``vectors`` (vec_id, embedding): vectors nearer than ``radius``, itself included."""
    some = vectors.select("vec_id", "embedding")
    counts = _met(some, some.count(), "vec_id long, nn long", lambda pdf, near: pd.DataFrame({"vec_id": pdf["vec_id"], "nn": near.sum(1)}), radius)
    return counts.groupBy("vec_id").agg(F.sum("nn").alias("nn"))


def vector_labels(vectors: DataFrame, radius: float, min_pts: int) -> DataFrame:
    """(vec_id, label): 0 core, 1 border, 2 noise. Counts and then touches are found block by block; no pair leaves a task."""
    counts = stored(vector_core_counts(vectors, radius), "vector-counts")
    marked = vectors.select("vec_id", "embedding").join(counts.select("vec_id", (F.col("nn") >= min_pts).alias("core")), "vec_id")
    touch = lambda pdf, near: pd.DataFrame({"vec_id": pdf["vec_id"], "touches": near[:, pdf["core"].to_numpy(bool)].any(1)})
    touched = _met(marked, counts.count(), "vec_id long, touches boolean", touch, radius).groupBy("vec_id").agg(F.max("touches").alias("touches"))
    out = counts.join(touched, "vec_id")
    return out.select("vec_id", F.when(F.col("nn") >= min_pts, 0).when(F.col("touches"), 1).otherwise(2).alias("label"))
