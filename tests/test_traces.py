"""Series kernels, LAS reading and the tables around them, against plain definitions."""

from __future__ import annotations

import io
import json
import math
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from faciesforge.functions import headers as H
from faciesforge.kernels import tops, traces, typewell
from faciesforge.sources import delimited, las, npz, state, tables
from faciesforge.viz import colours, svg

TEXT = """~Version
 VERS. 2.0 :
 WRAP. NO :
~Well
 NULL. -999.25 :
 UWI. 15-001 : id
 API. 42 :
~Curve
 DEPT.FT : depth
 GAMMA.GAPI : gamma
 GR:1.GAPI : gamma again
 RHOB.G/CC : density
~Ascii
"""


def file(rows, head=TEXT):
    return head + "\n".join(" ".join(map(str, r)) for r in rows) + "\n"


def slow_resample(d, v, n, window=None):
    """Row by row, as a reader that holds one segment would do it."""
    rows = [(a, b) for a, b in zip(d, v, strict=True) if math.isfinite(a) and (window is None or window[0] <= a <= window[1])]
    z = np.linspace(min(a for a, _ in rows), max(a for a, _ in rows), n)
    points = []
    for a, b in rows:
        if math.isfinite(b):
            if points and points[-1][0] == a:
                points[-1][1].append(b)
            else:
                points.append((a, [b]))
    points = [(a, sum(b) / len(b)) for a, b in points]
    x, i = [], 0
    while i < n and z[i] < points[0][0]:
        x.append(points[0][1])
        i += 1
    for (a, p), (b, q) in zip(points, points[1:]):  # noqa: B905
        while b > a and i < n and z[i] <= b:
            x.append(p + (z[i] - a) / (b - a) * (q - p))
            i += 1
    return z, np.array(x + [points[-1][1]] * (n - i))


@pytest.mark.parametrize("seed", range(12))
def test_resampling_in_file_order(seed):
    rnd = np.random.default_rng(seed)
    d = np.cumsum(rnd.choice([0.0, 0.5, 0.5, 1.0, -0.7], 80)) + 100
    v = np.where(rnd.random(80) < 0.2, np.nan, rnd.normal(size=80))
    d[rnd.random(80) < 0.05] = np.nan
    window = None if seed % 2 else (101.0, 112.0)
    got = traces.resampled(d, v, 40, min_finite=2, window=window)
    z, x = slow_resample(d, v, 40, window)
    assert np.allclose(got.x, traces.scaled(x)) and (got.top, got.base) == (z[0], z[-1])
    inside = np.isfinite(d) & ((d >= window[0]) & (d <= window[1]) if window else True)
    steps = np.diff(d[inside])
    assert got.step == np.median(steps[steps != 0]) and got.n_finite == (inside & np.isfinite(v)).sum()


def test_resampling_refuses():
    with pytest.raises(traces.TraceError):
        traces.resampled([1.0, 1.0], [1.0, 2.0], 8, min_finite=1)
    with pytest.raises(traces.TraceError):
        traces.resampled([1.0, 2.0], [np.nan, 2.0], 8, min_finite=2)
    with pytest.raises(ValueError):
        traces.resampled([1.0, 2.0], [1.0, 2.0], 4)
    assert (traces.scaled(np.full(5, 3.0)) == 0).all() and np.isnan(traces.scaled(np.array([np.nan, 0.0, 1.0]))[0])


def test_window_of_a_stored_vector():
    x = np.linspace(0, 1, 101)
    got = traces.windowed(x, 0.0, 100.0, -10.0, 110.0, 13, 0.0, 100.0)
    assert np.allclose(got, np.clip(np.linspace(-0.1, 1.1, 13), 0, 1))
    with pytest.raises(traces.TraceError):
        traces.windowed(x[:1], 0, 1, 0, 1, 8)


def test_reservoir():
    v = np.arange(100.0)
    sample = list(v[:7])
    for seen in range(8, 101):
        at = (1103515245 * seen + 12345 & 0x7FFFFFFF) % seen
        if at < 7:
            sample[at] = v[seen - 1]
    assert traces.reservoir(v, 7).tolist() == sample and traces.reservoir(v[:3], 7).tolist() == [0, 1, 2] and not len(traces.reservoir(v, 0))


def test_quality():
    rnd = np.random.default_rng(1)
    d, v = rnd.permutation(np.arange(200.0)), rnd.normal(60, 20, 200)
    q = traces.quality(d, v)
    assert q.status == "OK" and (q.top, q.base, q.n) == (0, 199, 200) and np.isclose(q.iqr, np.subtract(*np.percentile(v, [75, 25]))) and len(q.shape) == 128
    assert np.isclose(q.sand_frac, (q.shape < 0.35).mean()) and q.thickness == 199
    assert traces.quality(d, np.full(200, 5.0)).status == "WARN" and traces.quality(d[:20], v[:20]).error == "too_few_finite:20" and traces.quality([1.0], [1.0]).error == "too_short"


def test_shifts_and_knots():
    assert traces.shift_vector(None, 3).tolist() == [0, 0, 0] and traces.shift_vector([2.0], 3).tolist() == [2, 2, 2]
    assert traces.shift_vector([1.0, np.nan, 3.0], 5).tolist() == [1, 2, 3, 3, 3] and traces.shift_vector([1.0, 2, 3], 2).tolist() == [1, 2]
    assert traces.shift_resized([0.0, 2.0], 3).tolist() == [0, 1, 2]
    z, x = traces.rising([3, 1, 1, np.nan], [9, 5, 6, 7])
    assert z.tolist() == [1, 3] and x.tolist() == [5, 9]
    path = np.array([[0, 0], [1, 1], [1, 2], [1, 3], [2, 4], [9, 9]])
    a, b = traces.knots(path, np.arange(5.0), 10 * np.arange(5.0), [1.0], None, 1.0)
    assert a.tolist() == [0, 1, 2] and b.tolist() == [-1, 19, 39]
    assert traces.knots(path[:3], np.arange(5.0), np.arange(5.0)) is None
    j, groups = traces.template_positions(np.array([[0, 3], [1, 3], [2, 5]]))
    assert j.tolist() == [3, 5] and [g.tolist() for g in groups] == [[0, 1], [2]]
    grid = np.linspace(0, 4, 5)
    gap = traces.warped_between(grid, grid, grid, (grid, grid), 3)
    assert np.allclose(gap, grid[:, None])


def test_tops_by_level():
    x = np.sin(np.arange(300) / 9) + 0.3 * np.sin(np.arange(300) / 2.5)
    levels = tops.by_level(x)
    assert all(z[0] == 0 and z[-1] == 299 and (np.diff(z) > 0).all() for z in levels) and len(levels) == 8
    finest = set(tops.crossings(tops.ricker_response(x, 2)).tolist())
    for k, w in enumerate(tops.WIDTHS):
        for z in levels[k][1:-1].tolist():  # every top of a coarse scale has come down to the finest, or found nothing near
            assert z in finest or min(abs(z - f) for f in finest) > 25
        half = max(5, 10 * w) // 2
        wave = np.array([(1 - (i / w) ** 2) * math.exp(-((i / w) ** 2) / 2) for i in range(-half, half + 1)])
        at = min(150, 299 - half)
        if at >= half:
            assert np.isclose(tops.ricker_response(x, w)[at], (x[at - half : at + half + 1] * wave).sum() / np.abs(wave).sum())
    assert tops.crossings(np.array([0.0, 0, 1, 0, -1, 0, 2])).tolist() == [4, 6]
    assert tops.snapped(np.array([10, 50]), np.array([8, 12, 90]), 5).tolist() == [8, 50] and [len(z) for z in tops.by_level(np.empty(0))] == [0] * 8


def test_medoids():
    rnd = np.random.default_rng(3)
    f, x = rnd.normal(size=(30, 4)), rnd.random((30, 16))
    f[4] = 100  # an outlier
    at, use = typewell.local(f, x, np.ones(30, bool), z_max=3.5, shape_z_max=99.0)
    assert 4 not in use
    mad = lambda c: max(np.median(np.abs(c - np.median(c))), 1e-6)
    cost = [sum(np.abs(x[i] - x[j]).mean() + sum(w * abs(f[i, k] - f[j, k]) / mad(f[use, k]) for k, w in enumerate(typewell.WEIGHTS[1:])) for j in use) for i in use]
    assert at == use[int(np.argmin(cost))]
    assert len(typewell.local(f, x, np.arange(30) < 3)[1]) >= 20  # too few pass, so all do
    g, d = rnd.normal(size=(20, 7)), rnd.random(20) * 30
    at, use = typewell.on_grid(g, x[:20], d)
    w = np.clip(np.exp(-((d / 20) ** 2)), 1e-6, 1)
    cost = [sum(w[j] * (np.abs(g[i] - g[j]).sum() + 2 * np.abs(x[i] - x[j]).sum()) for j in use) for i in use]
    assert at == use[int(np.argmin(cost))] and typewell.on_grid(g[:5], x[:5], d[:5]) is None


# ---- files ----------------------------------------------------------------------------------


def test_reading_files_whole():
    rows = [(100 + k / 2, k, 2 * k if k > 3 else -999.25, 2.5) for k in range(20)]
    text = file(rows)
    fast, slow = las.read_whole(text), las.read_whole(text, prefer_fast=False)
    assert fast.engine == "fast" and slow.engine == "normal" and np.array_equal(fast.columns, slow.columns, equal_nan=True) and np.isnan(fast.columns[2, 0])
    assert las.best_curve(fast, ("GR",)) == 1 and las.best_curve(fast, ("RH",)) == 3 and las.best_curve(fast, ("ZZZ",)) == -1
    odd = las.read_whole(text.replace("2.5", "bad", 1))
    assert odd.engine == "normal" and np.isnan(odd.columns[3, 0]) and odd.columns.shape == (4, 20)
    wrapped = TEXT.replace("WRAP. NO", "WRAP. YES") + "100\n1 2\n3\n100.5 4 5 6 101\n"
    assert las.read_whole(wrapped).columns.tolist() == [[100, 100.5], [1, 4], [2, 5], [3, 6]]
    with pytest.raises(ValueError):
        las.read_whole("~A\n1 2\n")
    with pytest.raises(ValueError):
        las.read_whole(TEXT)
    assert las.read_whole(TEXT, ignore_data=True).engine == "header"
    z, x = las.well_arrays(fast, 16)
    assert len(z) == len(x) == 16 and np.allclose(x, las.well_arrays(fast, 16, normalise_first=False)[1], atol=0.05)
    logs = las.canonical_logs({"GAMMA": np.array([1.0, np.nan]), "GR:1": np.array([1.0, 2.0]), "GR": np.array([3.0, 4.0]), "": np.zeros(2)})
    assert list(logs) == ["GR"] and logs["GR"].tolist() == [1, 2]


def test_meta_and_columns():
    text = file([(1, 2, 3, 4), (2, 3), (3, -999.25, "x", 6)])
    meta = las.parse_meta(text.replace("GR:1", "gr : 1"))
    assert not meta.wrap and [c[0] for c in meta.curves][0] == "DEPT" and meta.null_value == -999.25
    got = list(las.column_values(text, 1, 4, False, -999.25))
    assert got[0] == 2 and math.isnan(got[1]) and len(got) == 2
    assert list(las.column_values(text + "~P\n9 9 9 9\n~A more\n7 8 9 1\n", 3, 4, False, None)) == [4, 6, 1]
    assert list(las.column_values("~A\n1 2 3\n4 5 6 7\n", 0, 2, True, None)) == [1, 3, 5]
    assert las.well_fields(text) == {"UWI": "15-001", "API": "42"}
    assert las.parse_meta("~V\nWRAP. YES :\n~W\nWRAP. NO :\n~A\n").wrap


def test_resampled_files_and_profiles(spark):
    rows = [(100 + k / 2, k % 7, 1, 2.5) for k in range(40)]
    files = spark.createDataFrame([("a", file(rows)), ("b", "nothing"), ("c", file(rows[:4])), ("d", None)], "path string, text string")
    got = {r["path"]: r for r in las.resampled_curves(files, 32).collect()}
    assert got["a"]["status"] == "OK" and len(got["a"]["x"]) == 32 and (got["a"]["top"], got["a"]["base"], got["a"]["step"], got["a"]["n_finite"]) == (100, 119.5, 0.5, 40)
    assert got["b"]["status"] == got["d"]["status"] == "FAIL: no curves" and got["c"]["status"] == "FAIL: too few finite samples"
    assert las.resampled_curves(files, 32, max_rows=10).filter("path = 'a'").first()["status"] == "FAIL: too many rows"
    p = {r["path"]: r for r in state.profiles(files).collect()}
    assert p["a"]["n_rows"] == 40 and p["a"]["depth_step_median"] == 0.5 and json.loads(p["a"]["well"])["API"] == "42" and p["b"]["status"].startswith("REJECT")
    assert state.profiles(files, 2).count() == 2


def test_archives_states_fingerprints(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("deep/one.LAS", "x")
        z.writestr("two.txt", "y")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    got = sorted((r["name"] or "", r["text"] or "") for r in state.unzipped(spark, f"file://{tmp_path}/*.zip").collect())
    assert got == [("", ""), ("one.LAS", "x")]
    assert state.unzip_beside(tmp_path / "a.zip") == 1 and state.unzip_beside(tmp_path / "a.zip") == 0 and state.unzip_beside(tmp_path / "broken.zip") == 0
    state.heartbeat(tmp_path / "s" / "state.json", step=3)
    beat = state.read_json(tmp_path / "s" / "state.json")
    assert beat["step"] == 3 and {"ts", "pid", "rss_mb", "open_fds"} <= set(beat) and state.read_json(tmp_path / "none", 7) == 7
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abcdef")
    r = state.fingerprints(spark, f"file://{tmp_path}/f.bin", 4).first()
    assert r["size"] == 6 and r["sha1"] == hashlib.sha1(b"6|abcd|6").hexdigest()


def test_isolated_work():
    assert state.isolated(sum, [1, 2]) == ("OK", 3)
    assert state.isolated(bytes, 1_000_000)[1] == bytes(1_000_000)
    assert state.isolated(int, "x")[0].startswith("FAIL: ValueError")
    assert state.isolated(time.sleep, 20, timeout=0.3)[0] == "TIMEOUT"


def test_numpy_archives(spark, tmp_path):
    path = f"file://{tmp_path}/a.npz"
    rows = spark.createDataFrame([(2, [1.0, 2.0], 0.5), (1, [3.0, None], 1.5)], "rep long, x array<double>, top double")
    npz.write_stacked(rows, path, "rep", ("x", "top"))
    back = npz.read_stacked(spark, path, "rep", ("x", "top")).orderBy("rep").collect()
    assert back[0]["rep"] == 1 and back[0]["x"][0] == 3 and math.isnan(back[0]["x"][1]) and back[1]["top"] == 0.5
    with pytest.raises(ValueError):
        npz.read_stacked(spark, path, "rep", ("y",))
    paths = spark.createDataFrame([(1, 2, [0, 1], [0, 2]), (0, 2, [5], [6]), (0, 3, [], [])], "src long, dst long, ii array<int>, jj array<int>")
    npz.write_ragged(paths, path)
    assert [tuple(r) for r in npz.read_ragged(spark, path).orderBy("src").collect()] == [(0, 2, [5], [6]), (1, 2, [0, 1], [0, 2])]
    npz.write_named(rows, path, "rep", "x")
    assert npz.read_named(spark, path).filter("id = '2'").first()["values"] == [1, 2]
    assert npz.rows_by_place(np.zeros((3, 5)), np.zeros(5)).shape == npz.rows_by_place(np.zeros((5, 3)), np.zeros(5)).shape == (3, 5)


def test_filters_and_indexes(spark):
    rows = spark.createDataFrame([(1, "http://x/a.las?q=1"), (2, "http://x/b.las"), (3, "http://x/c.las#f"), (4, ""), (5, "http://x/e.las"), (6, "http://x/f.las")], "id long, url string")
    files = spark.createDataFrame([("/d/a.las", 100, 3), ("/d/b.las", 5 << 20, 3), ("/d/c.las", 10, 0), ("/d/f.las", 10, 99)], "path string, size long, n_curves int")
    kept, counts = tables.prefiltered(rows, files, "/d/", 1, 50)
    assert [(r["id"], r["las_path"]) for r in kept.collect()] == [(1, "/d/a.las")] and kept.columns == ["las_path", "id", "url"]
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"kept": 1, "too_large": 1, "bad_header": 1, "missing": 2, "too_many_curves": 1}
    allowed = spark.createDataFrame([("b.las",)], "name string")
    assert {r["reason"]: r["n"] for r in tables.prefiltered(rows, files, "/d", 9, 0, allowed)[1].collect()} == {"kept": 1, "not_allowed": 5}
    heads = spark.createDataFrame([("/d/a.las", ["GR", "GR"], ["GAPI", "IN"], ["", ""]), ("/d/b.las", [], [], [])], "path string, mnemonics array<string>, units array<string>, descriptions array<string>")
    wells, curves, hits = tables.curve_index(rows, heads, "/d")
    assert {r["id"]: (r["status"], r["n_curves"]) for r in wells.collect()} == {1: ("OK", 2), 2: ("EMPTY", 0)} | {k: ("MISSING", 0) for k in (3, 4, 5, 6)}
    assert curves.count() == 2 and {r["severity"] for r in hits.collect()} == {"ERROR", "WARN"}
    stats = spark.createDataFrame([("/d/a.las", "GR", 5.0)], "las_path string, mnemonic string, mean double")
    assert tables.with_curve_stats(curves.select("las_path", "mnemonic"), stats).filter("mean = 5").count() == 2
    logs = spark.createDataFrame([(1, "GAMMA", 0, [1.0, None]), (1, "GR", 1, [1.0, 2.0]), (1, "GR:2", 2, [5.0, 6.0])], "well_id long, name string, place int, values array<double>")
    assert [tuple(r) for r in tables.canonical_logs(logs).collect()] == [(1, "GR", "GR", [1.0, 2.0])]


def test_tables_on_disk(spark, tmp_path):
    wells = spark.createDataFrame([(1, 38.0, -98.0, "/x/a.las"), (2, 38.1, -98.1, None)], "well_id long, lat double, lon double, las_path string")
    wells.write.parquet(f"file://{tmp_path}/w")
    assert [r[0] for r in tables.las_basenames(spark, f"file://{tmp_path}/w").collect()] == ["a.las"] and tables.las_basenames(spark, f"file://{tmp_path}/none") is None
    first = tables.well_to_cell(spark, f"file://{tmp_path}/cells", wells, 20.0, 38.0)
    assert first.count() == 2 and tables.well_to_cell(spark, f"file://{tmp_path}/cells", wells.limit(0), 20.0, 38.0).count() == 2
    long = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 5.0), (1, 0.0, 0.0, 1.0, 6.0)], "well_id long, x double, y double, md double, GAMMA double")
    assert [tuple(r)[3:] for r in tables.wells_with_logs(long, ["GAMMA"], ["GR"]).collect()] == [("GR", "GAMMA", [1.0, 2.0], [6.0, 5.0])]
    sink = delimited.CsvSink(f"file://{tmp_path}/csv", ["well_id", "more"], overwrite=True)
    for batch in (0, 1, 1):
        sink(wells, batch)
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 4
    edges = spark.createDataFrame([(1, 2, "OK", [0, 1], [0, 1]), (1, 3, "SKIP", [], [])], "src long, dst long, status string, ii array<int>, jj array<int>")
    delimited.write_alignment(edges, f"file://{tmp_path}/out")
    assert spark.read.csv(f"file://{tmp_path}/out/dtw_edges", header=True).count() == 2 and spark.read.parquet(f"file://{tmp_path}/out/dtw_paths/points").count() == 2


def test_raw_mnemonics(spark):
    m = spark.createDataFrame([(["DEPT", "GR:1", "GAMMA", "GR"],), (["GAMMA_RAY", "GR:22", "GRX"],), (["GRX", "NPHI"],), ([],)], "m array<string>")
    c = F.col("m")
    got = m.select(H.raw_for(c, "GR"), H.raw_preferred(c, ["RHOB", "gamma"]), H.raw_in_family(c, "GR"), H.all_in_family(c, "GAMMA"), H.column_for(c, "GR"), H.cache_key(F.lit("/a/b.las"), 128)).collect()
    assert [r[0] for r in got] == ["GR", "GAMMA_RAY", None, None] and [r[1] for r in got] == ["GR", "GAMMA_RAY", None, None]
    assert got[0][2] == "GR:1" and [r[3] for r in got] == [["GR:1", "GAMMA", "GR"], ["GAMMA_RAY", "GR:22"], [], []]
    assert [r[4] for r in got] == [3, 1, 0, None] and got[0][5].startswith("b_128_")


def test_pictures():
    import pandas as pd

    ramp = colours.ramp(n=5)
    assert svg.hex_of(ramp[0]) == "#f6e8a5" and svg.hex_of(ramp[-1]) == "#4b2e13" and (np.diff(colours.lab(ramp)[:, 0]) < 0).all()
    rnd = np.random.default_rng(0)
    rgb = rnd.random((50, 3))
    assert np.allclose(colours.srgb(colours.lab(rgb)), rgb, atol=1e-6)
    a = np.zeros((4, 6, 3))
    b = np.zeros((6, 4, 3))
    b[2, 1] = 1
    assert colours.difference(a, b).shape == (4, 4) and colours.difference(a, b, percentile=100).max() == 1 and colours.difference(a, a, True).mean() == 0.5
    points = pd.DataFrame({"id": [1, 2], "lat": [38.0, 39.0], "lon": [-98.0, -97.0], "v": [1.0, np.nan]})
    edges = pd.DataFrame({"src": [1, 1], "dst": [2, 9], "w": [2.0, 1.0]})
    import xml.dom.minidom

    rings = pd.DataFrame({"cell_id": ["c"] * 4, "corner": range(4), "lat": [0, 0, 1, 1], "lon": [0, 1, 1, 0]})
    z = np.arange(5.0)
    for picture in (svg.point_map(points, "a < b", "v", edges, "w"), svg.point_map(points[:0]), svg.cell_map(rings, {"c": 1.0}), svg.panel({"w": (z, z)}, {"w": [2.0]}), svg.panel({}), svg.heat(np.array([[1.0, np.nan], [0.0, 2.0]]))):
        assert xml.dom.minidom.parse(io.BytesIO(picture.encode())).documentElement.tagName == "svg"
    assert svg.point_map(points, edges=edges).count("<line") == 1
