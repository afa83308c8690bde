"""Triangulation in tiles, sector search, distance joins around the Earth, and graph rules without one task for all, against plain ways."""

from __future__ import annotations

from glob import glob
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faciesforge.kernels import greedy, triangulation
from faciesforge.operators import kernels, spatial
from faciesforge.operators.triangulation import delaunay_edges
from faciesforge.plans import views
from faciesforge.scratch import shared_dir

# ---- triangulation ----------------------------------------------------------------------------------


def square(n, seed=1):
    return np.random.default_rng(seed).random((2, n))


def lattice(n, turn=0.0):
    x, y = (a.ravel().astype(float) for a in np.meshgrid(np.arange(n), np.arange(n)))
    return np.stack([x * np.cos(turn) - y * np.sin(turn), x * np.sin(turn) + y * np.cos(turn)])


def clusters(n):
    rnd = np.random.default_rng(2)
    return np.concatenate([rnd.random((2, n)) * s + at for s, at in ((1, 0), (0.001, 5), (0.1, -9), (1e-6, 0.5))], axis=1)


SHAPES = {
    "square": square(400),
    "strip": square(400, 3) * [[100], [0.001]],
    "upright": square(400, 3) * [[0.001], [100]],
    "lattice": lattice(20),
    "turned": lattice(20, 0.3),
    "clusters": clusters(150),
    "wheel": np.concatenate([np.stack([np.cos(t := np.linspace(0, 2 * np.pi, 61)[:-1]), np.sin(t)]), np.zeros((2, 1))], axis=1),
    "parabola": np.stack([np.arange(60.0), np.arange(60.0) ** 2]),
    "row and one": np.stack([np.r_[np.arange(40.0), 11], np.r_[np.zeros(40), 3]]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_kernel_has_empty_circles_and_all_edges(name):
    x, y = SHAPES[name]
    at = triangulation.ordered(x, y)
    x, y = x[at], y[at]
    tri, hull = triangulation.triangulate(x, y)
    points = triangulation.Points(x, y)
    assert len(triangulation.edges_of(tri)) == 3 * len(x) - 3 - len(hull) and len(tri) == 2 * len(x) - 2 - len(hull)
    for a, b in hull[::7].tolist():
        assert all(points.orient(a, b, i) >= 0 for i in range(0, len(x), 3))
    for t in tri[:: max(1, len(tri) // 60)].tolist():
        assert points.orient(*t) > 0 and all(points.in_circle(*t, i) <= 0 for i in range(0, len(x), 3) if i not in t)


def test_parts_agree_on_points_on_circles():
    x, y = lattice(9)
    at = triangulation.ordered(x, y)
    whole = {tuple(e) for e in at[triangulation.edges_of(triangulation.triangulate(x[at], y[at])[0])].tolist()}
    part = at[(x[at] >= 2) & (x[at] <= 6) & (y[at] >= 2) & (y[at] <= 6)]
    some = {tuple(e) for e in part[triangulation.edges_of(triangulation.triangulate(x[part], y[part])[0])].tolist()}
    inner = lambda edges: {e for e in edges if all(3 <= x[i] <= 5 and 3 <= y[i] <= 5 for i in e)}
    assert inner(whole) == inner(some) and inner(some)


def table_of(spark, x, y):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)) * 7 % (10 * len(x)), "x": x, "y": y}))


@pytest.mark.parametrize("name", SHAPES)
def test_tiles_give_the_edges_of_all(spark, name):
    x, y = SHAPES[name]
    ids = np.arange(len(x)) * 7 % (10 * len(x))
    want = {tuple(sorted((int(ids[a]), int(ids[b])))) for a, b in greedy.delaunay(x, y)}
    got = [(r["src"], r["dst"]) for r in delaunay_edges(table_of(spark, x, y), 40).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_points_that_take_no_part(spark):
    nan = float("nan")
    rows = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (9, 0.0, 0.0), (4, None, 1.0), (5, nan, 1.0), (6, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert {(r["src"], r["dst"]) for r in delaunay_edges(df).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert delaunay_edges(df.filter("id < 3")).count() == 0 and delaunay_edges(df.limit(0)).count() == 0
    line = spark.range(50).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    assert delaunay_edges(line, 10).count() == 0


def test_wells_have_all_edges_and_many_tiles(spark):
    wells = views.wells(spark, "/root/testdata/sf0.1").select(F.col("well_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    p = wells.orderBy("x", "y").toPandas()
    hull = triangulation.triangulate(p.x.to_numpy(), p.y.to_numpy())[1]
    found = delaunay_edges(wells)
    assert found.count() == 3 * len(p) - 3 - len(hull) == found.distinct().count()


@pytest.mark.parametrize("name", SHAPES)
def test_corners_of_the_hull(name):
    x, y = SHAPES[name]
    at = triangulation.ordered(x, y)
    points = triangulation.Points(x[at], y[at])
    way = triangulation.triangulate(x[at], y[at])[1].tolist()
    after = dict(way)
    assert set(triangulation.hull_corners(points).tolist()) == {b for a, b in way if points.orient(a, b, after[b]) > 0}


def test_rim_tiles_hold_few_points(spark):
    """Tiles along a straight rim need the points at the rim, not each other whole."""
    x, y = square(4000, 6)
    before = set(glob(f"{held_tables(spark)}/held-*"))
    found = delaunay_edges(table_of(spark, x, y), 40)
    assert found.count() == 3 * len(x) - 3 - len(triangulation.triangulate(*np.stack([x, y])[:, triangulation.ordered(x, y)])[1])
    held = [spark.read.parquet(f) for f in sorted(set(glob(f"{held_tables(spark)}/held-*")) - before)]
    told = [h.filter("kind = 0 and b = -1").groupBy("tile").agg(F.count_distinct("a").alias("n")).agg(F.max("n")).first()[0] or 0 for h in held]  # besides halos
    assert told and 0 < max(told) < len(x) / 16  # the 36 tiles of the rim have 1,440


def held_tables(spark):
    return f"{shared_dir(spark).removeprefix('file://')}/faciesforge/{spark.sparkContext.applicationId}"


# ---- distances around the Earth -----------------------------------------------------------------------


def places(seed=4):
    rnd = np.random.default_rng(seed)
    lat = np.r_[10, 10, 89.95, 89.95, 89.99, -89.97, -89.97, 90, -90, rnd.uniform(-90, 90, 60), 38 + rnd.random(60), np.degrees(np.arcsin(rnd.uniform(0.99, 1, 40)))]
    lon = np.r_[179.99, -179.99, 0, 180, -90, 20, -160, 7, 0, rnd.uniform(-180, 180, 60), -98 + rnd.random(60), rnd.uniform(-180, 180, 40)]
    return lat, lon


def points_of(spark, lat, lon):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "id long, lat double, lon double")


@pytest.mark.parametrize("radius", [20.0, 300.0, 4000.0, 15000.0])
def test_pairs_across_the_date_line_and_the_poles(spark, radius):
    lat, lon = places()
    d = greedy.haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    want = {(i, j) for i, j in combinations(range(len(lat)), 2) if d[i, j] <= radius}
    got = [(r["src"], r["dst"]) for r in spatial.radius_pairs(points_of(spark, lat, lon), radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ((0, 1) in want and (2, 3) in want)


@pytest.mark.parametrize("join", [lambda p: spatial.radius_pairs(p, 20.0), lambda p: spatial.within(p, p, 20.0)])
def test_pairs_of_a_small_table_are_dealt_to_many_tasks(spark, join):
    """One file of points is one task if its other side is sent to it, however many pairs it makes."""
    found = join(points_of(spark, *places()).coalesce(1))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_nearest_across_the_date_line(spark):
    lat, lon = places()
    d = greedy.haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    np.fill_diagonal(d, np.inf)
    got = {(r["src"], r["rank"]): r["dist_km"] for r in spatial.knn(points_of(spark, lat, lon), 4, 16.0).collect()}
    assert len(got) == 4 * len(lat)
    assert np.allclose([[got[i, k + 1] for k in range(4)] for i in range(len(lat))], np.sort(d, axis=1)[:, :4])


# ---- sectors --------------------------------------------------------------------------------------------


def plain_sectors(lat, lon):
    f, g = np.radians(lat), np.radians(lon)
    d = greedy.haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    dg = g[None] - g[:, None]
    east, north = np.sin(dg) * np.cos(f)[None], np.cos(f)[:, None] * np.sin(f)[None] - np.sin(f)[:, None] * np.cos(f)[None] * np.cos(dg)
    a = np.degrees(np.arctan2(east, north)) % 360
    sector = np.where((a >= 315) | (a < 45), 0, np.where(a < 135, 1, np.where(a < 225, 2, 3)))
    out = {}
    for i in range(len(lat)):
        for s in range(4):
            j = [int(j) for j in np.flatnonzero(sector[i] == s) if d[i, j] > 0]
            if j:
                out[i, s] = min(d[i, k] for k in j)
    return out, sector


@pytest.mark.parametrize("start", [0.5, 16.0, 2000.0])
@pytest.mark.parametrize("where", ["region", "earth"])
def test_nearest_in_each_sector(spark, monkeypatch, where, start):
    monkeypatch.setattr(spatial, "SECTOR_TILE", 8)
    rnd = np.random.default_rng(8)
    lat, lon = places(9) if where == "earth" else (np.r_[37 + 3 * rnd.random(150), 38, 38, 50], np.r_[-102 + 7 * rnd.random(150), -99, -99, -60])
    keep = np.abs(lat) < 90  # at a pole every way is south
    lat, lon = lat[keep], lon[keep]
    want, sector = plain_sectors(lat, lon)
    got = {}
    for r in spatial.directed_sectors(points_of(spark, lat, lon), start).collect():
        key = r["src"], int(sector[r["src"], r["dst"]])
        assert key not in got
        got[key] = r["dist_km"]
    assert set(got) == set(want) and np.allclose([got[k] for k in want], list(want.values()))


def test_sectors_of_few_points(spark):
    assert spatial.directed_sectors(points_of(spark, [], []), 5.0).count() == 0
    assert spatial.directed_sectors(points_of(spark, [38.0, 38.0], [-98.0, -98.0]), 5.0).count() == 0


# ---- graph rules in turns ---------------------------------------------------------------------------------


def random_graph(n, m, seed):
    rnd = np.random.default_rng(seed)
    ends = {tuple(sorted(rnd.choice(n, 2, False).tolist())) for _ in range(m)} | {tuple(sorted((0, i))) for i in range(1, n // 2)}  # a hub
    rows = [(s, d, float(rnd.integers(1, 9)), str(rnd.choice(["knn", "knn", "both", "delaunay"])), float(rnd.integers(0, 9)) / 8) for s, d in sorted(ends)]
    return pd.DataFrame(rows, columns=["src", "dst", "dist_km", "edge_type", "sim"])


@pytest.mark.parametrize("k_max", [0, 3, 6])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pruning_by_turns_is_the_rule(spark, seed, k_max):
    e = random_graph(60, 500, seed)
    want = greedy.prune_degrees(e, k_max)
    got = kernels.prune_degrees(spark.createDataFrame(e), k_max).toPandas().sort_values(["src", "dst"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want[["src", "dst", "dist_km", "edge_type"]].sort_values(["src", "dst"], ignore_index=True))
    assert len(want) < len(e)


def test_pruning_a_component_in_many_batches(spark):
    e = random_graph(400, 6000, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["src"], r["dst"]) for r in kernels.prune_degrees(spark.createDataFrame(e), 8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == set(greedy.prune_degrees(e, 8)[["src", "dst"]].itertuples(index=False, name=None))


@pytest.mark.parametrize("extra,least", [(0, 0.0), (2, 0.0), (3, 0.5)])
@pytest.mark.parametrize("seed", [1, 2])
def test_extras_by_turns_are_the_rule(spark, seed, extra, least):
    e = random_graph(60, 500, seed)
    want = set(greedy.forest_and_extras(e, extra, least)[["src", "dst"]].itertuples(index=False, name=None))
    got = [(r["src"], r["dst"]) for r in kernels.forest_and_extras(spark.createDataFrame(e), extra, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rules_on_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, dist_km double, edge_type string, sim double")
    assert kernels.prune_degrees(none, 3).count() == 0 and kernels.forest_and_extras(none, 3, 0.0).count() == 0
