"""Column expressions over points and vectors; all stay in the JVM."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from eddystream.params import DbscanParams

#: Guards a cell side against rounding at a cell's edge: join cells a bit larger, dense cells a bit smaller.
SLACK = 1e-9


def join_side(p: DbscanParams) -> float:
    """Side of the cells whose direct neighbours hold all points within the radius."""
    return p.radius * (1 + SLACK)


def dense_side(p: DbscanParams) -> float:
    """Side of the cells in which any two points are within the radius."""
    return p.radius / math.sqrt(p.dims) * (1 - SLACK)


def cell(p: DbscanParams, side: float, prefix: str = "c") -> dict[str, Column]:
    return {f"{prefix}{a}": F.floor(F.col(a) / F.lit(side)).cast("long") for a in p.axes}


def cell_centre(p: DbscanParams, side: float, prefix: str = "c") -> dict[str, Column]:
    return {f"{a}_centre": (F.col(f"{prefix}{a}") + 0.5) * F.lit(side) for a in p.axes}


def stencil(dims: int, half: bool = False) -> list[tuple[int, ...]]:
    """Offsets of a cell and its neighbours; with ``half`` only the positive ones, so that each pair of cells comes once."""
    every = list(itertools.product((-1, 0, 1), repeat=dims))
    return [o for o in every if not half or o > (0,) * dims]


def squared_distance(p: DbscanParams, a: str = "a", b: str = "b") -> Column:
    kind = p.precision
    terms = [(F.col(f"{a}.{x}").cast(kind) - F.col(f"{b}.{x}").cast(kind)) * (F.col(f"{a}.{x}").cast(kind) - F.col(f"{b}.{x}").cast(kind)) for x in p.axes]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def near(p: DbscanParams, a: str = "a", b: str = "b") -> Column:
    """Strictly nearer than the radius."""
    r = F.lit(p.radius).cast(p.precision)
    return squared_distance(p, a, b) < r * r


def box(p: DbscanParams, width: Column) -> dict[str, Column]:
    """Bounds of a box of half width ``width`` around a point."""
    return {f"{a}_{s}": F.col(a) + F.lit(d) * width for a in p.axes for s, d in (("min", -1), ("max", 1))}


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))
