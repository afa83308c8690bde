"""Graphs, windowed alignment, relative time, type wells and the pipeline on small tables, against plain definitions."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from faciesforge.kernels import align, greedy, traces
from faciesforge.operators import chronostrat, framework, graph, grid, kernels, spatial, typewells, windowed
from faciesforge.scratch import cut


def wells_at(spark, n=60, seed=0):
    rnd = np.random.default_rng(seed)
    lat, lon = 38 + rnd.random(n), -98 + rnd.random(n)
    return cut(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "id long, lat double, lon double"), "wells"), lat, lon


def empty_circle_edges(x, y):
    """Edges of all triangles whose circle holds no other point."""
    out = set()
    for t in combinations(range(len(x)), 3):
        cx, cy, r2 = greedy._circle(x, y, t)
        if np.isfinite(r2) and not (((x - cx) ** 2 + (y - cy) ** 2) < r2 * (1 - 1e-9)).any():
            out |= {tuple(sorted(e)) for e in combinations(t, 2)}
    return out


def test_spatial_graph_is_delaunay_and_nearest(spark):
    wells, lat, lon = wells_at(spark, 40)
    edges, counts = framework.spatial_graph(wells, 4, 6, 40.0)
    x, y = np.radians(lon) * 6371.0088 * np.cos(np.radians(np.median(lat))), np.radians(lat) * 6371.0088
    want = empty_circle_edges(x, y)
    d = greedy.haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    near = {tuple(sorted((i, int(j)))) for i in range(40) for j in np.argsort(d[i], kind="stable")[1:9]}
    every = {e: ("both" if e in want and e in near else "delaunay" if e in want else "knn") for e in want | near}
    kept = {e: k for e, k in every.items() if d[e] <= 40}
    got = {(r["src"], r["dst"]): r["edge_type"] for r in edges.collect()}
    assert {e for e, k in kept.items() if k != "knn"} <= set(got) <= set(kept) and all(kept[e] == k for e, k in got.items())
    degree = Counter(i for e in got for i in e)
    assert all(degree[i] <= 4 or all(got[e] != "knn" for e in got if i in e) for i in degree)
    c = counts.first().asDict()
    assert c == {"n_nodes": 40, "n_edges": len(got), "n_delaunay": sum(k != "knn" for k in got.values()), "n_knn": sum(k != "delaunay" for k in got.values()), "n_both": sum(k == "both" for k in got.values()), "n_cut_dist": len(every) - len(kept), "n_pruned_k": len(kept) - len(got)}


@pytest.mark.parametrize("start", [0.5, 16.0, 3000.0])
def test_nearest_with_radii_of_their_own(spark, start):
    rnd = np.random.default_rng(4)
    lat = np.r_[38 + rnd.random(40) * 0.001, 38 + rnd.random(20), rnd.uniform(-80, 80, 6), [38.0, 38.0]]
    lon = np.r_[-98 + rnd.random(40) * 0.001, -98 + rnd.random(20), rnd.uniform(-170, 170, 6), [-98.0, -98.0]]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "id long, lat double, lon double")
    d = greedy.haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    want = {(i, int(j)) for i in range(len(lat)) for j in sorted((j for j in range(len(lat)) if j != i), key=lambda j, i=i: (round(d[i, j], 9), j))[:3]}
    got = spatial.knn(points, 3, start).collect()
    assert len(got) == 3 * len(lat) and len(want ^ {(r["src"], r["dst"]) for r in got}) <= 2  # two points at one place may swap at the last digit


def test_distance_rows_and_bridges(spark):
    wells, lat, lon = wells_at(spark, 12)
    d = greedy.haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    rows = spatial.distance_rows(wells.withColumn("cell", F.lit("a")), "cell").orderBy("id").collect()
    assert np.allclose([r["dist_km"] for r in rows], d) and rows[0]["dist_km"][0] == 0
    tri = kernels.delaunay_edges(wells.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")))
    got = {(r["src"], r["dst"]): r["source"] for r in spatial.with_bridges(wells, 20.0, 1, 45.0, tri).collect()}
    want = {(r["src"], r["dst"]) for r in tri.collect()}
    assert got == {(i, j): "max_dist" if d[i, j] <= 20 else "delaunay" for i, j in combinations(range(12), 2) if d[i, j] <= 20 or ((i, j) in want and d[i, j] <= 45)}


def test_framework_tables(spark, tmp_path):
    (tmp_path / "n.csv").write_text("rep_id,lat\na,1\nb,2\n")
    (tmp_path / "e.csv").write_text("src_rep_id,dst_rep_id,sim\nb,a,0.1\na,b,0.2\na,a,0.3\nb,c,0.4\n")
    nodes, edges = framework.read_framework(spark, f"file://{tmp_path}/n.csv", f"file://{tmp_path}/e.csv")
    assert sorted((r["src"], r["dst"], r["sim"]) for r in edges.collect()) == [("a", "b", "0.2"), ("b", "c", "0.4")]
    known, _ = framework.graph_tables(nodes.withColumnRenamed("rep_id", "id"), edges)
    assert {r["id"]: r["known"] for r in known.collect()} == {"a": True, "b": True, "c": False}
    arrays = spark.createDataFrame([("a", [1.0])], "well_id string, x array<double>")
    assert framework.attach_arrays(nodes.select(F.col("rep_id").alias("id")), arrays)[1] == 1
    wells = spark.createDataFrame([("a", "x/a.las"), ("b", "/abs/b.las")], "well_id string, las_path string")
    found = framework.resolved_paths(nodes.select(F.col("rep_id").alias("well_id")), wells, "/root/")
    assert sorted(r["las_path"] for r in found.collect()) == ["/abs/b.las", "/root/x/a.las"]
    assert framework.resolved_paths(wells.select(F.col("las_path").alias("path")), wells, "/r").filter("las_path = '/r/x/a.las'").count() == 1
    kinds = spark.createDataFrame([(i, i + 1, "knn" if i % 2 else "both") for i in range(10)], "src long, dst long, edge_type string")
    assert framework.composite_edges(kinds, 2).groupBy("layer").count().orderBy("layer").collect() == [(0, 2), (1, 5)]
    assert framework.sampled_edges(kinds, 3).collect() == framework.sampled_edges(kinds.repartition(3), 3).collect()


def test_fence_stations(spark):
    points = spark.createDataFrame([(i, 38 + 0.1 * (i // 8), -98 + 0.1 * (i % 8)) for i in range(64)], "id long, lat double, lon double")
    grid_edges = [(i, i + 1, 1.0) for i in range(64) if i % 8 < 7] + [(i, i + 8, 1.0) for i in range(56)]
    edges = spark.createDataFrame(grid_edges, "src long, dst long, dist_km double")
    way = framework.fence_stations(points, edges, wells=(6, 7))
    assert 6 <= len(way) <= 7 and all((min(a, b), max(a, b), 1.0) in grid_edges for a, b in zip(way, way[1:]))  # noqa: B905
    assert way == framework.fence_stations(points, edges, edges, wells=(6, 7))
    with pytest.raises(ValueError):
        framework.fence_stations(points, edges, edges.limit(0), wells=(6, 7), tries=5)


def test_large_components_by_joins(spark):
    """What joins do for components too large for a task is what the kernels do."""
    rnd = np.random.default_rng(3)
    pairs = sorted({tuple(sorted(map(int, rnd.choice(30, 2, replace=False)))) for _ in range(45)} | {(100, 101), (101, 102)})
    rows = [(a, b, float(rnd.normal()), float(rnd.uniform(0.5, 2)), float(rnd.integers(1, 9))) for a, b in pairs]
    edges = cut(spark.createDataFrame(rows, "src long, dst long, offset double, weight double, dist_km double"), "edges")
    for f, columns in ((kernels.breadth_first_shifts, ("id", "shift", "anchor")), (kernels.solve_shifts, ("id", "shift"))):
        want, got = (sorted(tuple(r[c] for c in columns) for r in f(edges, small=n).collect()) for n in (1000, 0))
        assert [w[0] for w in want] == [g[0] for g in got] and np.allclose(np.array(want, float), np.array(got, float), atol=1e-4)
    want, got = ({r["start"]: r for r in kernels.shortest_paths(edges, small=n).collect()} for n in (1000, 0))
    assert want.keys() == got.keys() and all(np.isclose(want[k]["dist_km"], got[k]["dist_km"]) and got[k]["way"][0] == k and got[k]["way"][-1] == want[k]["goal"] for k in want)
    far = {(a, b): d for a, b, _, _, d in rows}
    assert all(np.isclose(sum(far[min(a, b), max(a, b)] for a, b in zip(r["way"], r["way"][1:])), r["dist_km"]) for r in got.values())  # noqa: B905


# ---- alignment over common depths ---------------------------------------------------------------


def test_windowed_alignment(spark):
    rnd = np.random.default_rng(2)
    raw = {w: (np.arange(120) * 2.0 + start, np.cumsum(rnd.normal(size=120))) for w, start in ((1, 1000.0), (2, 1040.0), (3, 1190.0), (4, 5000.0), (5, 1020.0))}
    samples = spark.createDataFrame([(w, k, float(d), float(v)) for w, (z, x) in raw.items() for k, (d, v) in enumerate(zip(z, x, strict=True))], "well_id long, row long, depth double, value double")
    stored = cut(windowed.vectors(samples, 64), "stored")
    assert {r["status"] for r in stored.collect()} == {"OK"}
    nodes = samples.groupBy("well_id").agg(F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max")).union(spark.createDataFrame([(6, None, 2.0)], "well_id long, depth_min double, depth_max double"))
    edges = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0), (1, 4, 1.0), (1, 6, 1.0), (1, 9, 1.0), (2, 5, None)], "src long, dst long, dist_km double")
    s = windowed.Windowing(n=48, pad_per_km=2.0, min_overlap=60.0, stored_only=True)
    got = {(r["src"], r["dst"]): r for r in windowed.aligned(edges, nodes, stored.filter("well_id <> 5"), s).collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert status[1, 3] == "overlap_too_small" and status[1, 4] == "no_overlap" and status[1, 6] == "no_depth" and status[1, 9] == "missing_node" and status[2, 5] == "cache_miss"
    r, v = got[1, 2], {x["well_id"]: x for x in stored.collect()}
    assert (r["pad"], r["overlap"]) == (16.0, 198.0) and np.isclose(r["overlap_frac"], 198 / 238)
    cost, path = align.dtw(*[traces.windowed(np.array(v[w]["x"]), v[w]["top"], v[w]["base"], 1040 - 16, 1238 + 16, 48) for w in (1, 2)])
    assert np.isclose(r["cost"], cost) and np.isclose(r["cps"], cost / len(path)) and list(zip(r["ii"], r["jj"], strict=True)) == [tuple(p) for p in path]
    assert r["status"] == ("ok" if align.end_slopes_ok(path, 0.1, 16, 0.5, 2.0, 48) else "end_mismatch")
    read = {(r["src"], r["dst"]): r for r in windowed.aligned(edges, nodes, stored.filter("well_id <> 5"), windowed.Windowing(n=48, min_overlap=60.0), samples).collect()}[2, 5]
    want = align.dtw(*[traces.resampled(*raw[w], 48, window=(1040 - 10, 1258 + 10)).x for w in (2, 5)])[0]
    assert read["status"] in ("ok", "end_mismatch") and np.isclose(read["cost"], want)
    missing = windowed.aligned(edges, nodes, stored.filter("well_id <> 5"), windowed.Windowing(n=48, min_overlap=60.0))
    assert missing.filter("src = 2").first()["status"] == "read_fail" and sum(r["n"] for r in windowed.diagnostics(missing).collect()) == 6
    assert windowed.as_text(missing).filter("src = 1 and dst = 2").first()["dist_km"] == "3.000"


# ---- relative time --------------------------------------------------------------------------------


def dense_shifts(rows, anchors, damping, pull):
    """(well, k) -> shift, by a dense solve of the normal equations."""
    keys = sorted({(r[0], r[1]) for r in rows} | {(r[2], r[3]) for r in rows})
    at = {k: i for i, k in enumerate(keys)}
    b = np.zeros((len(rows), len(keys)))
    for i, (s, p, d, q, _) in enumerate(rows):
        b[i, at[s, p]] += 1
        b[i, at[d, q]] -= 1
    a, y = b.T @ b + damping * np.eye(len(keys)), b.T @ np.array([r[4] for r in rows])
    for w, k, target, weight in anchors:
        if (w, k) in at:
            a[at[w, k], at[w, k]] += pull * weight**2
            y[at[w, k]] += pull * weight**2 * target
    return dict(zip(keys, np.linalg.solve(a, y), strict=True))


@pytest.mark.parametrize(("precise", "small"), [(False, 5_000_000), (True, 5_000_000), (False, 3)])
def test_relative_time(spark, precise, small):
    paths = [(1, 2, [0, 0, 1, 2, 3], [0, 1, 1, 1, 3]), (2, 3, [0, 1, 2, 3], [0, 2, 3, 3]), (7, 8, [0, 3], [0, 9])]
    depths = {1: [10.0, 11.0, 12.0, 13.0], 2: [20.0, 22.0, 24.0, 26.0], 3: [5.0, 6.0, 8.0, 9.0], 7: [1.0, 2.0, 3.0, 4.0], 8: [2.0, 3.0, 4.0, 5.0]}
    p = spark.createDataFrame(paths, "src long, dst long, ii array<int>, jj array<int>")
    a = spark.createDataFrame(list(depths.items()), "well_id long, depths array<double>")
    rows = []
    for s, d, ii, jj in paths:
        groups = {}
        for i, j in zip(ii, jj, strict=True):
            groups.setdefault((i, j) if precise else i, []).append(j)
        for key, js in groups.items():
            i, j = (key[0], key[1]) if precise else (key, int(np.median(js)))
            if j < 4:
                rows.append((s, i, d, j if precise else i, depths[d][j] - depths[s][i]))
    got = sorted(tuple(r) for r in chronostrat.equations(p, a, precise).collect())
    assert got == sorted(rows)
    anchors = [(2, 0, 1.5, 2.0), (1, 3, 0.0, 1.0), (99, 0, 1.0, 1.0)]
    solved = chronostrat.solved(chronostrat.equations(p, a, precise), spark.createDataFrame(anchors, "well_id long, k int, target double, weight double"), 0.05, 0.5, 1e-12, small=small)
    want = dense_shifts(rows, anchors, 0.05, 0.5)
    found = {(r["well_id"], r["k"]): r["shift"] for r in solved.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)


def plain_diagram(wells, n, pad):
    """Well -> (values, depths) on the common grid, with NumPy alone."""
    used, back = {}, {}
    for w, (z, x, s) in wells.items():
        ok = np.isfinite(z) & np.isfinite(s)
        if not np.isfinite(s).any() or (ok & np.isfinite(x)).sum() < 5:
            continue
        rgt = (z + s)[ok]
        mono = np.maximum.accumulate(rgt)
        back[w] = (mono > rgt + 1e-10 + 1e-8 * np.abs(rgt)).mean()
        fin = np.isfinite(x[ok])
        m, v, d = mono[fin], x[ok][fin], z[ok][fin]
        last = np.r_[m[1:] != m[:-1], True]
        used[w] = m[last], v[last], d[last], mono
    lo, hi = min(u[3].min() for u in used.values()), max(u[3].max() for u in used.values())
    t = np.linspace(lo - pad * (hi - lo), hi + pad * (hi - lo), n)
    inside = {w: (t >= m[0] - 1e-9) & (t <= m[-1] + 1e-9) for w, (m, *_) in used.items()}
    return t, {w: (np.where(inside[w], np.interp(t, m, v), np.nan), np.where(inside[w], np.interp(t, m, d), np.nan)) for w, (m, v, d, _) in used.items()}, back


def test_diagram_tops_and_tables(spark):
    rnd = np.random.default_rng(8)
    wells = {w: (np.arange(40) * 1.5 + 10 * w, np.where(rnd.random(40) < 0.1, np.nan, rnd.random(40)), rnd.normal(0, 1.5, 40)) for w in range(1, 5)}
    wells[5] = (np.arange(40.0), rnd.random(40), np.full(40, np.nan))
    wells[6] = (np.arange(40.0), np.r_[np.full(37, np.nan), 1, 2, 3], np.zeros(40))
    rows = [(w, k, float(z[k]), float(x[k]), float(s[k])) for w, (z, x, s) in wells.items() for k in range(40)]
    samples = spark.createDataFrame(rows, "well_id long, k int, depth double, value double, shift double")
    places, status = chronostrat.diagram(samples, [], 60, 0.05)
    places = cut(places, "places")
    t, want, back = plain_diagram(wells, 60, 0.05)
    got = {(r["well_id"], r["place"]): r for r in places.collect()}
    assert got.keys() == {(w, k) for w, (v, _) in want.items() for k in np.flatnonzero(np.isfinite(v)).tolist()}
    assert all(np.isclose(r["value"], want[w][0][k]) and np.isclose(r["depth"], want[w][1][k]) and np.isclose(r["rgt"], t[k]) for (w, k), r in got.items())
    states = {r["well_id"]: (r["status"], r["reversal_frac"]) for r in status.collect()}
    assert states[5][0] == "missing_shift" and states[6][0] == "too_few_finite_samples" and all(states[w][0] == "used" and np.isclose(states[w][1], back[w]) for w in back)
    log = cut(chronostrat.type_log(places, []), "log")
    mean = np.nanmean(np.stack([v for v, _ in want.values()]), axis=0)
    assert all(np.isclose(r["value"], mean[r["place"]]) for r in log.collect())
    tops = cut(chronostrat.multiscale_tops(log, [], (2, 6), 5), "tops")
    assert {r["level"] for r in tops.collect()} == {0, 1}
    table = chronostrat.tops_table(places, tops, log, 1)
    n = tops.filter("level = 1").count()
    assert len(table.columns) == 1 + 2 * n and table.count() == 4
    first = table.filter("well_id = 1").first()
    for r in tops.filter("level = 1").join(log, "place").collect():
        depth = want[1][1][r["place"]]
        assert first[f"TOP{r['top']:03d}_RGT"] == f"{r['rgt']:.3f}" and first[f"TOP{r['top']:03d}_DEPTH"] == ("" if np.isnan(depth) else f"{depth:.3f}")
    by_cell = samples.withColumn("cell_id", F.when(F.col("well_id") <= 2, "a").otherwise("b"))
    logs = chronostrat.type_log(chronostrat.diagram(by_cell, ["cell_id"], 50)[0], ["cell_id"])
    stats = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 2, 9.0)], "cell_id string, level int, mean double")
    scalar = {r["cell_id"]: r["value"] for r in chronostrat.cell_scalar(stats, logs, "mean", 0).collect()}
    assert scalar["a"] == 2 and np.isclose(scalar["b"], logs.filter("cell_id = 'b'").agg(F.avg("value")).first()[0])


def test_fence_section(spark):
    z = [float(k) for k in range(20)]
    arrays = spark.createDataFrame([(1, z, z, None), (2, z, z, [1.0]), (3, z, z, None)], "well_id long, depths array<double>, values array<double>, shift array<double>")
    stations = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "station long, well_id long")
    paths = spark.createDataFrame([(2, 1, list(range(20)), list(range(20)))], "src long, dst long, ii array<int>, jj array<int>")
    got = chronostrat.fence(stations, arrays, paths, (0.0, 20.0, 21), 4).orderBy("station").collect()
    assert got[0]["track"][:20] == z and got[0]["track"][20] is None and got[1]["track"][0] is None and got[1]["track"][1:] == z
    assert len(got[0]["gap"]) == 84 and got[1]["gap"] is None and got[2]["gap"] is None


# ---- type wells -----------------------------------------------------------------------------------


def test_kernel_members(spark):
    cells = cut(grid.assign(wells_at(spark, 80, 3)[0].withColumnRenamed("id", "well_id"), 10.0, 38.5), "cells")
    w = cells.collect()
    middle = {c: (np.mean([r["lat"] for r in w if r["cell_id"] == c]), np.mean([r["lon"] for r in w if r["cell_id"] == c])) for c in {r["cell_id"] for r in w}}
    for nearest in (0, 6):
        got: dict = {}
        for r in typewells.kernel_members(cells, 1, 2, 12, 9, nearest, 40.0).collect():
            got.setdefault(r["cell_id"], set()).add((r["well_id"], r["radius"]))
        for c, (lat, lon) in middle.items():
            ix, iy = next((r["ix"], r["iy"]) for r in w if r["cell_id"] == c)
            far = {r["well_id"]: float(greedy.haversine(lat, lon, r["lat"], r["lon"])) for r in w}
            for radius in (1, 2):
                mine = [r["well_id"] for r in w if max(abs(r["ix"] - ix), abs(r["iy"] - iy)) <= radius]
                if len(mine) >= 12:
                    break
            else:
                if nearest:
                    mine, radius = sorted((i for i in far if far[i] <= 40), key=far.get)[:nearest], -1
            assert got[c] == {(i, radius) for i in sorted(mine, key=far.get)[:9]}


def test_type_wells_and_placement(spark):
    rnd = np.random.default_rng(5)
    base = np.convolve(rnd.normal(size=260), np.ones(5), "valid")
    rows, n = [], 14
    base[60:150:30], base[75:150:30] = 12, -12  # the part between them varies as much as the whole
    base[[10, 200]], base[[30, 240]] = 12, -12
    for w in range(n):
        part = base if w < 12 else base[60:150]
        z = 1000 + np.arange(len(part)) * 1.0 + w
        rows += [(w, float(d), float(v)) for d, v in zip(z, part + rnd.normal(0, 0.05, len(part)), strict=True)]
    samples = cut(spark.createDataFrame(rows, "well_id long, depth double, value double"), "samples")
    members = spark.createDataFrame([("c", w, 38.0, -98.0, float(w), 1) for w in range(n)] + [("none", 99, 0.0, 0.0, 0.0, 1)], "cell_id string, well_id long, lat double, lon double, dist_km double, radius int")
    features = cut(typewells.template_features(samples), "features")
    types = {r["cell_id"]: r for r in typewells.local_type_wells(members, features).collect()}
    assert types["none"]["error"] == "no_readable_gr" and types["c"]["n_kernel"] == n and types["c"]["n_read"] == n and types["c"]["n_used"] <= 12 and types["c"]["thickness_median"] == 255 and types["c"]["well_id"] < 12
    quality = cut(typewells.curve_quality(samples), "quality")
    chosen = {r["cell_id"]: r for r in typewells.grid_type_wells(members, quality).collect()}
    assert chosen["c"]["status"] == "OK" and chosen["c"]["n_pass"] == n and chosen["none"]["reason"] == "too_few_candidates_postqc"
    gated = typewells.gated(features.withColumn("cell_id", F.lit("c")), F.col("thickness") > 1e6, ["cell_id"])
    assert gated.count() == n and typewells.gated(features.withColumn("cell_id", F.lit("c")), F.col("thickness") > 100, ["cell_id"]).count() == 12
    reps = samples.groupBy("well_id").agg(F.array_sort(F.collect_list(F.struct("depth", "value"))).alias("p")).select(F.col("well_id").alias("rep_id"), F.when(F.col("well_id") == 3, "none").otherwise("c").alias("cell_id"), F.transform("p", lambda q: q["depth"]).alias("depths"), F.transform("p", lambda q: q["value"]).alias("values"))
    reps = reps.union(spark.createDataFrame([(77, "c", None, None)], "rep_id long, cell_id string, depths array<double>, values array<double>"))
    placed = {r["rep_id"]: r for r in typewells.placed(reps, typewells.local_type_wells(members, features)).collect()}
    assert placed[77]["status"] == "read_fail" and placed[3]["status"] == "missing_template" and not placed[0]["short"] and placed[0]["placed_top"] == 1000
    short = placed[13]
    assert short["short"] and abs(short["j_start"] - 60) <= 6 and abs(short["j_end"] - 149) <= 6 and short["missing_top"] and short["missing_base"] and not short["condensed"]
    assert np.isclose(short["placed_top"], 1013 - short["s_start"] * 255) and np.isclose(short["placed_base"], 1102 + (1 - short["s_end"]) * 255)
    assert typewells.farthest_candidates(members, 1).filter("cell_id = 'c'").count() == 1


def test_grid_spec(spark):
    wells = wells_at(spark, 200, 9)[0]
    spec = grid.grid_spec(wells, target=20, min_size=2)
    assert spec["n_cols"] >= 1 and spec["n_rows"] * spec["cell_km"] >= 100 and grid.grid_spec(wells, cell_km=7.0)["cell_km"] == 7.0
    with pytest.raises(ValueError):
        grid.grid_spec(wells.limit(1), cell_km=1.0)
    assert graph.canonical(spark.createDataFrame([(2, 1, 3.0), (1, 2, 2.0), (1, 1, 0.0)], "src long, dst long, dist_km double")).collect() == [(1, 2, 2.0)]
