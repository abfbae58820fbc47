"""One window in numpy: for grouped maps over windows and for streaming state, where a window is a task's unit of work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from eddystream.functions.geometry import dense_side, join_side, stencil
from eddystream.params import BORDER, CORE, NOISE, DbscanParams


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches along edges: minima over edges, then jumps, until nothing moves."""
    up = np.arange(n)
    while len(a):
        ra, rb = up[a], up[b]
        low = np.minimum(ra, rb)
        differ = ra != rb
        if not differ.any():
            break
        np.minimum.at(up, ra[differ], low[differ])
        np.minimum.at(up, rb[differ], low[differ])
        while True:
            jump = up[up]
            if (jump == up).all():
                break
            up = jump
        a, b = a[differ], b[differ]
    return up


def near_pairs(xyz: np.ndarray, p: DbscanParams, group: np.ndarray | None = None, sink: Callable[[np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows nearer than the radius, each once; rows of one ``group`` (not -1) are not compared with each other.

    With a ``sink``, pairs are given to it some millions at a time instead of being returned.
    """
    n, dims = len(xyz), p.dims
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    cells = np.floor(xyz / join_side(p)).astype(np.int64)
    cells -= cells.min(0) - 1
    span = cells.max(0) + 2
    if float(np.prod(span.astype(float))) < 2**62:
        weight = np.array([int(np.prod(span[i + 1 :])) for i in range(dims)], np.int64)
        code = cells @ weight
        moves = [int(np.dot(o, weight)) for o in stencil(dims, half=True)]
    else:  # far apart: number the cells that occur and look moved ones up
        known, code = np.unique(cells, axis=0, return_inverse=True)
        return _pairs_sparse(xyz, p, known, code.reshape(-1), group, sink)
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    out_a, out_b, keep = _kept()
    for move in [0, *moves]:
        low = np.searchsorted(sorted_, sorted_ + move, "left") if move else np.arange(1, n + 1)
        high = np.searchsorted(sorted_, sorted_ + move, "right")
        _expand(order, low, high, xyz, p, group, sink or keep)
    return np.concatenate(out_a) if out_a else none, np.concatenate(out_b) if out_b else none


def _pairs_sparse(xyz, p, known, code, group, sink):
    place = {tuple(c): i for i, c in enumerate(known.tolist())}
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], np.arange(len(known) + 1))
    out_a, out_b, keep = _kept()
    for o in [(0,) * p.dims, *stencil(p.dims, half=True)]:
        to = np.array([place.get(tuple(c), -1) for c in (known + np.array(o)).tolist()])
        target = to[code[order]]
        low = np.where(target >= 0, first[target], 0)
        high = np.where(target >= 0, first[target + 1], 0)
        if not any(o):
            low = np.arange(1, len(order) + 1)
        _expand(order, low, high, xyz, p, group, sink or keep)
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a) if out_a else none, np.concatenate(out_b) if out_b else none


def _kept() -> tuple[list, list, Callable[[np.ndarray, np.ndarray], None]]:
    """Two lists, and a sink that adds to them."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    return a, b, lambda x, y: (a.append(x), b.append(y)) and None


def _expand(order, low, high, xyz, p, group, sink, most: int = 500_000) -> None:
    """Tests the rows ``order[i]`` against ``order[low[i]:high[i]]``, some millions of pairs at a time."""
    width = np.maximum(high - low, 0)
    ends = np.cumsum(width)
    kind = np.float32 if p.precision == "float" else np.float64
    # in the order of the cells, so that what is compared lies together
    data, r = [np.ascontiguousarray(xyz[order, axis], kind) for axis in range(p.dims)], kind(p.radius)
    group = None if group is None else group[order]
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        w = width[i:j]
        total = int(w.sum())
        if total:
            a = np.repeat(np.arange(i, j), w)
            b = np.arange(total) - np.repeat(np.cumsum(w) - w, w) + np.repeat(low[i:j], w)
            if group is not None:
                apart = (group[a] != group[b]) | (group[a] < 0)
                a, b = a[apart], b[apart]
            d2 = np.zeros(len(a), kind)
            for x in data:
                d = x[a] - x[b]
                d2 += d * d
            ok = d2 < r * r
            sink(order[a[ok]], order[b[ok]])
        i = j


def _label(pos: np.ndarray, a: np.ndarray, b: np.ndarray, head: np.ndarray, p: DbscanParams) -> tuple[np.ndarray, np.ndarray]:
    """Labels and cluster ids of rows from their near pairs; ``head`` is the first row of a row's dense cell, or -1."""
    n = len(pos)
    rank = np.empty(n, np.int64)
    order = np.argsort(pos, kind="stable")
    rank[order] = np.arange(n)
    core = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1 >= p.min_pts
    dense = np.flatnonzero(head >= 0)
    core[dense] = True
    both = core[a] & core[b]
    up = roots(n, rank[np.concatenate([a[both], dense])], rank[np.concatenate([b[both], head[dense]])])[rank]
    least = np.full(n, n)
    for x, y in ((a, b), (b, a)):
        touch = core[x] & ~core[y]
        np.minimum.at(least, y[touch], up[x[touch]])
    border = ~core & (least < n)
    cid = np.where(core, up, np.where(border, least, rank))
    return np.where(core, CORE, np.where(border, BORDER, NOISE)).astype(np.int32), pos[order][cid] if n else pos


def _heads(cell: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """The first row with each row's cell where ``alike``, else -1."""
    head = np.full(len(cell), -1)
    rows = np.flatnonzero(alike)
    if len(rows):
        first = np.empty(int(cell.max()) + 1, np.int64)
        first[cell[rows[::-1]]] = rows[::-1]  # the last that is put there, the first row, stays
        head[rows] = first[cell[rows]]
    return head


def _reach(x: np.ndarray, p: DbscanParams) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """On a line: each row's place among the distinct values, how many rows are near each value, and the test of two values.

    Differences grow along the line, so what is near is a run of values, whose ends are found by search and then by the very test.
    """
    kind = np.float32 if p.precision == "float" else np.float64
    value, place, many = np.unique(x.astype(kind), return_inverse=True, return_counts=True)
    r, n = kind(p.radius), len(value)
    near = lambda i, j: (value[i] - value[j]) * (value[i] - value[j]) < r * r
    own = np.arange(n)
    low, high = np.searchsorted(value, value - r), np.searchsorted(value, value + r) - 1
    low, high = np.minimum(low, own), np.maximum(high, own)
    for ends, step in ((low, -1), (high, 1)):
        while True:
            beyond = np.clip(ends + step, 0, n - 1)
            out = (beyond != ends) & near(own, beyond)
            back = ~near(own, ends)
            if not (out | back).any():
                break
            ends += step * out.astype(np.int64) - step * back.astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(many)])
    return place.reshape(-1), upto[high + 1] - upto[low], near


def _label_line(pos: np.ndarray, x: np.ndarray, p: DbscanParams) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_label` for points on a line: a cluster is a run of core values of which each is near the next."""
    place, counts, near = _reach(x, p)
    n = len(counts)
    core = counts >= p.min_pts
    cores = np.flatnonzero(core)
    cid = pos.astype(np.int64).copy()
    label = np.full(len(pos), NOISE, np.int32)
    if not len(cores):
        return label, cid
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, place, pos)
    start = np.concatenate([[True], ~near(cores[1:], cores[:-1])])
    first = np.minimum.reduceat(least[cores], np.flatnonzero(start))[np.cumsum(start) - 1]  # of each core value's cluster
    before = np.searchsorted(cores, np.arange(n), "right") - 1
    after = np.minimum(before + 1, len(cores) - 1)
    sides = [np.where((b >= 0) & near(np.arange(n), cores[b]), first[b], np.iinfo(np.int64).max) for b in (before, after)]
    beside = np.minimum(*sides)
    own = np.zeros(n, np.int64)
    own[cores] = first
    touched = beside < np.iinfo(np.int64).max
    label[touched[place]], label[core[place]] = BORDER, CORE
    return label, np.where(core[place], own[place], np.where(touched[place], beside[place], cid))


def _numbers(cells: np.ndarray) -> np.ndarray:
    """A number from 0 on for each row of ``cells``, the same for equal rows."""
    low = cells.min(0)
    span = cells.max(0) - low + 1
    if float(np.prod(span)) < 2**62:  # one number a cell sorts faster than rows of them
        code = np.zeros(len(cells), np.int64)
        for axis in range(cells.shape[1]):
            code = code * np.int64(span[axis]) + (cells[:, axis] - low[axis]).astype(np.int64)
        return np.unique(code, return_inverse=True)[1].reshape(-1)
    return np.unique(cells, axis=0, return_inverse=True)[1].reshape(-1)


def _always_dense(seq: np.ndarray, xyz: np.ndarray, p: DbscanParams, first: int, last: int) -> np.ndarray:
    """Each row's cell if that holds min_pts in every one of the windows, else -1."""
    cell = _numbers(np.floor(xyz / dense_side(p)))
    fewest = np.full(cell.max() + 1, len(seq))
    for k in range(first, last + 1):
        low, high = np.searchsorted(seq, [k * p.stride, k * p.stride + p.window])
        fewest = np.minimum(fewest, np.bincount(cell[low:high], minlength=len(fewest)))
    return np.where(fewest[cell] >= p.min_pts, cell, -1)


def cluster_chunk(seq: np.ndarray, xyz: np.ndarray, p: DbscanParams, first: int, last: int, collapse: bool = True) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(window, rows, labels, cluster ids) of windows ``first`` to ``last`` of rows sorted by ``seq``.

    Near pairs are found once for all these windows and are taken by each
    window that holds both rows. With ``collapse``, points of a cell that holds
    min_pts in every one of the windows are cores without being compared, and
    hang together by their cell: a hot cell costs no more than its points.
    """
    xyz = np.ascontiguousarray(xyz[:, : p.dims])
    bounds = [np.searchsorted(seq, [k * p.stride, k * p.stride + p.window]) for k in range(first, last + 1)]
    if p.dims == 1:  # no pairs are needed
        for k, (low, high) in zip(range(first, last + 1), bounds, strict=True):
            yield k, slice(low, high), *_label_line(seq[low:high] % p.window, xyz[low:high, 0], p)
        return
    group = _always_dense(seq, xyz, p, first, last) if collapse and len(seq) else np.full(len(seq), -1)
    a, b = near_pairs(xyz, p, group if collapse else None)
    a, b = np.minimum(a, b), np.maximum(a, b)
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    for k, (low, high) in zip(range(first, last + 1), bounds, strict=True):
        i, j = np.searchsorted(a, [low, high])
        alive = b[i:j] < high
        head = _heads(group[low:high], group[low:high] >= 0)
        yield k, slice(low, high), *_label(seq[low:high] % p.window, a[i:j][alive] - low, b[i:j][alive] - low, head, p)


def count_chunk(seq: np.ndarray, xyz: np.ndarray, p: DbscanParams, first: int, last: int, collapse: bool = False) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(window, rows, near rows of each, itself included, and whether it is a core) of windows ``first`` to ``last`` of rows sorted by ``seq``.

    By differences: a pair adds one to both its rows in the window in which it
    comes alive and takes one off after the last that holds both; pairs are
    counted in blocks as they are found and never kept. With ``collapse``, rows
    of cells that hold min_pts in all windows are cores without being compared
    with one another, and counts are those of the pairs that are compared.
    """
    xyz = np.ascontiguousarray(xyz[:, : p.dims])
    if p.dims == 1:
        for k in range(first, last + 1):
            low, high = np.searchsorted(seq, [k * p.stride, k * p.stride + p.window])
            place, counts, _ = _reach(xyz[low:high, 0], p)
            yield k, slice(low, high), counts[place], counts[place] >= p.min_pts
        return
    n, wide = len(seq), last - first + 2
    steps = np.zeros(n * wide, np.int64)
    group = _always_dense(seq, xyz, p, first, last) if collapse and n else None
    come = np.maximum(first, (seq - p.window) // p.stride + 1) - first
    go = np.minimum(last, seq // p.stride) - first + 1

    def tally(a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.minimum(a, b), np.maximum(a, b)
        some = come[b] < go[a]
        a, b = a[some], b[some]
        for x in (a, b):
            np.add.at(steps, x * wide + come[b], 1)
            np.add.at(steps, x * wide + go[a], -1)

    near_pairs(xyz, p, group, tally)
    counts = np.cumsum(steps.reshape(n, wide), axis=1) + 1
    for k in range(first, last + 1):
        low, high = np.searchsorted(seq, [k * p.stride, k * p.stride + p.window])
        nn = counts[low:high, k - first]
        yield k, slice(low, high), nn, (nn >= p.min_pts) | (group[low:high] >= 0 if group is not None else False)


def cluster_window(pos: np.ndarray, xyz: np.ndarray, p: DbscanParams, collapse: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Labels and cluster ids of one window's rows.

    A cluster's id is the smallest pos of its cores, a border row joins the
    smallest cluster next to it, noise keeps its pos.
    """
    xyz = np.ascontiguousarray(xyz[:, : p.dims])
    if p.dims == 1:
        return _label_line(pos, xyz[:, 0], p)
    head = np.full(len(pos), -1)
    if collapse and len(pos):
        cell = _numbers(np.floor(xyz / dense_side(p)))
        head = _heads(cell, np.bincount(cell)[cell] >= p.min_pts)
    a, b = near_pairs(xyz, p, head if collapse else None)
    return _label(pos, a, b, head, p)
