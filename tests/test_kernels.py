"""Kernels against definitions: exhaustive search, closed forms and invariants."""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pytest

from faciesforge.kernels import align, greedy, solve


def slow_dtw(x, y, alpha, free):
    d = np.full((len(x) + 1, len(y) + 1), 1e30)
    d[0, 0] = 0
    if free:
        d[0, :] = 0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i, j] = abs(x[i - 1] - y[j - 1]) ** alpha + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    return d[1:, 1:]


@pytest.mark.parametrize("seed", range(5))
def test_alignment_cost_and_path(seed):
    rnd = np.random.default_rng(seed)
    x, y = rnd.normal(size=rnd.integers(8, 40)), rnd.normal(size=rnd.integers(8, 40))
    cost, path = align.dtw(x, y, 0.15)
    assert np.isclose(cost, slow_dtw(x, y, 0.15, False)[-1, -1])
    assert tuple(path[0]) == (0, 0) and tuple(path[-1]) == (len(x) - 1, len(y) - 1)
    assert all((b - a).tolist() in ([1, 1], [0, 1], [1, 0]) for a, b in pairwise(path))
    assert np.isclose(cost, (np.abs(x[path[:, 0]] - y[path[:, 1]]) ** 0.15).sum())


@pytest.mark.parametrize("seed", range(5))
def test_subsequence_alignment(seed):
    rnd = np.random.default_rng(seed)
    x, y = rnd.normal(size=12), rnd.normal(size=50)
    cost, cps, path, first, last = align.subsequence_dtw(x, y)
    end = slow_dtw(x, y, 0.15, True)[-1]
    assert np.isclose(cost, end.min()) and last == int(np.argmin(end)) and np.isclose(cps, cost / len(path))
    assert path[0].tolist() == [0, first] and path[-1].tolist() == [11, last]
    with pytest.raises(ValueError):
        align.subsequence_dtw(x[:7], y)


def test_identical_series_align_on_the_diagonal():
    cost, path = align.dtw(np.arange(8.0), np.arange(8.0))
    assert cost == 0 and path.tolist() == [[k, k] for k in range(8)]


def test_edge_status_and_steps():
    x = np.arange(20.0)
    assert align.align_edge(None, x, 0.15, 4)[0] == "SKIP:missing_arrays"
    assert align.align_edge(x[:5], x, 0.15, 4)[0] == "SKIP:too_short"
    status, cost, n, cps, ties = align.align_edge(x, x, 0.15, 4)
    assert (status, cost, n, cps) == ("OK", 0, 4, 0) and ties[:, 0].tolist() == [0, 6, 12, 19]
    assert align.align_edge(x, x, 0.15, 4, "full")[2] == 20
    assert align.path_sample(np.c_[np.arange(10), np.arange(10)], 4)[:, 0].tolist() == [0, 3, 6, 9]


def test_gaps_are_filled_and_ends_held():
    assert align.filled(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3]


def test_slopes_and_medians():
    straight = np.c_[np.arange(40), np.arange(40)]
    assert align.end_slopes_ok(straight)
    assert not align.end_slopes_ok(np.c_[np.arange(40), np.r_[np.arange(20), np.full(20, 19)]])
    i, j = align.median_j(np.array([[0, 0], [0, 1], [1, 2], [1, 3], [1, 5]]))
    assert i.tolist() == [0, 1] and j.tolist() == [0, 3]


def edges(rows, columns):
    return pd.DataFrame(rows, columns=columns)


def test_forest_keeps_the_best():
    e = edges([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7)], ["src", "dst", "sim"])
    assert greedy.kruskal(e)["sim"].tolist() == [0.9, 0.8]
    assert len(greedy.forest_and_extras(e, 1, 0.75)) == 2 and len(greedy.forest_and_extras(e, 1, 0.1)) == 3


def test_pruning_spares_delaunay_edges():
    e = edges([(0, k, float(k), "knn" if k > 2 else "delaunay") for k in range(1, 8)], ["src", "dst", "dist_km", "edge_type"])
    assert greedy.prune_degrees(e, 4)["dst"].tolist() == [1, 2, 3, 4]
    assert greedy.prune_degrees(e, 1)["dst"].tolist() == [1, 2]


def test_paths_and_shifts():
    e = edges([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], ["src", "dst", "dist_km"])
    assert greedy.shortest_path(e, 0, 2) == (2.0, [0, 1, 2])
    assert greedy.shortest_path(e, 0, 9) == (float("inf"), [])
    assert greedy.breadth_first_shifts(edges([(0, 1, 2.0), (1, 2, -1.0)], ["src", "dst", "offset"]), 0) == {0: 0.0, 1: 2.0, 2: 1.0}


def test_farthest_points_spread():
    lat, lon = np.array([37.0, 37.01, 38.0, 37.5]), np.array([-100.0, -100.0, -99.0, -99.5])
    assert greedy.farthest_points(lat, lon, 2).tolist() == [2, 0]
    assert len(greedy.farthest_points(lat, lon, 9)) == 4


def test_medoid_is_in_the_middle():
    shapes = np.array([[0.0, 0], [1, 1], [10, 10]])
    assert greedy.medoid(shapes, shapes, np.ones(3)) == 1


@pytest.mark.parametrize("seed", range(3))
def test_triangulation_has_empty_circles(seed):
    rnd = np.random.default_rng(seed)
    x, y = rnd.random(25), rnd.random(25)
    found = greedy.delaunay(x, y)
    want = set()
    for t in combinations(range(25), 3):
        cx, cy, r2 = greedy._circle(x, y, np.array(t))
        if not (((x - cx) ** 2 + (y - cy) ** 2) < r2 * (1 - 1e-9)).any():
            want |= set(combinations(t, 2))
    assert found == want
    assert greedy.delaunay(x[:2], y[:2]) == set()


def test_shifts_solve_the_equations():
    u, v, dz = np.array([0, 1, 2]), np.array([1, 2, 0]), np.array([1.0, 2.0, -3.0])
    s = solve.shifts(3, u, v, dz, anchors={0: 0.0}, damping=1e-9, tol=1e-12)
    assert np.allclose(s[u] - s[v], dz, atol=1e-5) and abs(s[0]) < 1e-5
    with pytest.raises(ArithmeticError):
        solve.shifts(50, np.arange(49), np.arange(1, 50), np.ones(49), damping=1e-9, tol=1e-14, most=2)


def test_stitching_recovers_an_affine_map():
    pairs = [("a", "b", x, 2 * x - 1, 1.0) for x in np.linspace(0, 10, 50)]
    a, b = solve.stitch(["a", "b"], pairs, "a", 1e-9, 1e-9)["b"]
    assert np.isclose(a, 0.5, atol=1e-4) and np.isclose(b, 0.5, atol=1e-3)


def test_triangulation_query_takes_all_wells_at_once(spark):
    from faciesforge.operators import grid
    from faciesforge.plans import kernel_queries, views

    w = grid.assign(views.wells(spark, "/root/testdata/sf0.001"), 20.0, 38.5).select("well_id", "x", "y").toPandas().sort_values("well_id", ignore_index=True)
    x, y, ids = w.x.to_numpy(), w.y.to_numpy(), w.well_id.to_numpy()
    found = {(r["src"], r["dst"]) for r in kernel_queries.delaunay_edges(spark, "/root/testdata/sf0.001").collect()}
    assert found == {(ids[a], ids[b]) for a, b in greedy.delaunay(x, y)}
    empty = lambda a, b: not ((x - (x[a] + x[b]) / 2) ** 2 + (y - (y[a] + y[b]) / 2) ** 2 < ((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2) / 4 * (1 - 1e-9)).any()
    gabriel = {(ids[a], ids[b]) for a, b in combinations(range(len(ids)), 2) if empty(a, b)}
    assert len(gabriel) >= len(ids) - 1 and gabriel <= found  # edges whose own circle is empty are in every triangulation
