"""The window kernel against a brute-force reading of the rules."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eddystream.operators.kernel import cluster_chunk, cluster_window, near_pairs, roots
from eddystream.params import DbscanParams


def brute(pos, xyz, p):
    xyz = xyz[:, : p.dims]
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    near = d2 < p.radius * p.radius
    core = near.sum(1) >= p.min_pts
    label = np.where(core, 0, 2)
    cid = pos.copy()
    order = np.argsort(pos)
    seen = set()
    for i in order:
        if not core[i] or i in seen:
            continue
        todo, members = [i], {i}
        while todo:
            for k in np.flatnonzero(near[todo.pop()] & core):
                if k not in members:
                    members.add(k)
                    todo.append(k)
        seen |= members
        for m in members:
            cid[m] = pos[i]
    for i in np.flatnonzero(~core):
        beside = np.flatnonzero(near[i] & core)
        if len(beside):
            label[i], cid[i] = 1, cid[beside].min()
    return label, cid


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.integers(1, 5), st.integers(0, 60), st.integers(0, 10**6), st.booleans())
def test_window_is_as_the_rules_say(dims, k, n, seed, collapse):
    rng = np.random.default_rng(seed)
    xyz = rng.integers(-8, 8, (n, 3)).astype(float) * rng.choice([0.25, 1.0])
    pos = rng.permutation(n)
    p = DbscanParams(100, 100, k, 1.1, dims)
    label, cid = cluster_window(pos, xyz, p, collapse)
    want = brute(pos, xyz, p)
    assert (label == want[0]).all() and (cid == want[1]).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3), st.integers(2, 5), st.integers(0, 10**6), st.booleans())
def test_chunk_is_its_windows_one_by_one(dims, k, seed, collapse):
    rng = np.random.default_rng(seed)
    seq, xyz = np.arange(4, 44), rng.integers(0, 6, (40, 3)).astype(float)
    p = DbscanParams(16, 4, k, 1.5, dims)
    got = list(cluster_chunk(seq, xyz, p, 1, 7, collapse))
    assert [g[0] for g in got] == list(range(1, 8))
    for w, rows, label, cid in got:
        assert list(seq[rows]) == list(range(w * 4, w * 4 + 16))
        want = brute(seq[rows] % 16, xyz[rows], p)
        assert (label == want[0]).all() and (cid == want[1]).all()


def test_radius_is_strict_and_far_points_are_handled():
    p = DbscanParams(2, 2, 2, 1.0, 1)
    label, _ = cluster_window(np.arange(2), np.array([[0.0, 0, 0], [1.0, 0, 0]]), p)
    assert list(label) == [2, 2]
    far = np.array([[1e15, -1e15, 1e15], [1e15, -1e15, 1e15], [-1e15, 1e15, 0.0]])
    a, b = near_pairs(far, DbscanParams(3, 3, 2, 0.5, 3))
    assert sorted((int(min(x, y)), int(max(x, y))) for x, y in zip(a, b, strict=True)) == [(0, 1)]


def test_border_joins_the_smallest_cluster_and_coincident_points_are_dense():
    p = DbscanParams(10, 10, 3, 1.1, 1)
    x = np.array([0.0, 0.1, 0.2, 1.2, 2.2, 2.3, 2.4])
    xyz = np.stack([x, 0 * x, 0 * x], 1)
    label, cid = cluster_window(np.array([6, 5, 4, 3, 2, 1, 0]), xyz, p)
    want = brute(np.array([6, 5, 4, 3, 2, 1, 0]), xyz, p)
    assert (label == want[0]).all() and (cid == want[1]).all()
    label, cid = cluster_window(np.arange(4), np.zeros((4, 3)), DbscanParams(4, 4, 4, 0.5, 3))
    assert list(label) == [0] * 4 and list(cid) == [0] * 4


def test_roots_of_a_long_chain():
    n = 1000
    order = np.random.default_rng(0).permutation(n)
    assert (roots(n, order[:-1], order[1:]) == 0).all()


@pytest.mark.parametrize("bad", [(10, 3, 2, 1.0), (10, 0, 2, 1.0), (10, 5, 0, 1.0), (10, 5, 2, 0.0), (5, 10, 2, 1.0)])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        DbscanParams(*bad)
