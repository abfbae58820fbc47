"""Vectors of Arrow list columns, and groups of rows that stream through a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddystream.llm.common import plain, tidy


def valid_vectors(table: DataFrame, id_: str = "vec_id", column: str = "embedding", once: bool = True) -> DataFrame:
    """(id, v) of the rows that hold a usable vector, repeated ones ``once``: v has its numbers, four or eight bytes each as in the table (:func:`kind_of`).

    Vectors that are null, empty or zero, or hold null or non-finite numbers, are left out, as are rows without an id.
    """

    kind = kind_of(table, column)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary())], ["id", "v"])

    slim = plain(table, id_, column).select(F.col(id_).cast("long"), F.col(column))
    rows = slim.mapInArrow(tidy(parse), "id long, v binary")
    return rows.distinct() if once else rows


def kind_of(table: DataFrame, column: str = "embedding") -> str:
    return "<f4" if dict(table.dtypes)[column] == "array<float>" else "<f8"


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long vectors, as doubles."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64) if values else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, also where squares would overflow or vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_group(keys: tuple[str, ...], answer: Callable[[pa.Table], pa.RecordBatch], at_least: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function for rows sorted by ``keys``: calls ``answer`` with whole groups, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            t = t if waiting is None else pa.concat_tables([waiting, t])
            code = np.zeros(len(t) - 1, bool)
            for k in keys:
                x = t.column(k).to_numpy()
                code |= x[1:] != x[:-1]
            edges = [0, *(np.flatnonzero(code) + 1).tolist()]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                yield answer(t.slice(i, j - i).combine_chunks())
            waiting = t.slice(edges[-1])
        if waiting is not None:
            yield answer(waiting.combine_chunks())

    return run
