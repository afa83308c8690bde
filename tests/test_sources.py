"""LAS text, delimited text, well and pick tables, paths and streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from faciesforge.functions import geo, headers, scoring
from faciesforge.operators import curves, grid, series
from faciesforge.sources import delimited, las, paths, tables
from faciesforge.streaming import ingest

HEAD = "~Version\nVERS. 2.0 : v\nWRAP. {wrap} : w\n~Well\nNULL. -999.25 : null\nSTRT.M 1000 : s\n~Curve\nDEPT.M : depth\nGR.GAPI 45 310 : gamma ray\nRHOB.G/CC : density\n~A\n"
PLAIN = HEAD.format(wrap="NO") + "1000 50 2.1\n# note\n1000.5,60,2.2\n\n1001 -999.25 bad\n1002 70\n"
WRAPPED = HEAD.format(wrap="YES") + "1000 50\n2.1 1001 60\n2.2\n1001.5 65 2.3 1002 70\n"


def test_header():
    h = las.parse_header(PLAIN)
    assert not h.wrap and h.null_value == -999.25 and [c[:2] for c in h.curves] == [("DEPT", "M"), ("GR", "GAPI"), ("RHOB", "G/CC")]
    assert las.parse_header(WRAPPED).wrap
    assert las.parse_header("").curves == []


def test_rows():
    assert list(las.rows(PLAIN, 3, False)) == [["1000", "50", "2.1"], ["1000.5", "60", "2.2"], ["1001", "-999.25", "bad"], ["1002", "70"]]
    assert list(las.rows(WRAPPED, 3, True)) == [["1000", "50", "2.1"], ["1001", "60", "2.2"], ["1001.5", "65", "2.3"]]


def test_curve_choice():
    h = las.Header(curves=[("DT", "", ""), ("SGR", "", ""), ("NPHI", "", "")])
    assert las.find_curve(h, ("GR",)) == 1 and las.find_curve(h, ("PE",), ("NPHI",)) == 2 and las.find_curve(h, ("PE",)) == -1


def test_samples_as_tables(spark, tmp_path):
    (tmp_path / "a.las").write_text(PLAIN)
    (tmp_path / "b.las").write_text(WRAPPED)
    files = las.read_text(spark, str(tmp_path))
    head = {r["path"][-5:]: r for r in las.headers(files).collect()}
    assert head["b.las"]["wrap"] and head["a.las"]["mnemonics"] == ["DEPT", "GR", "RHOB"]
    got = sorted((r["path"][-5:], r["row"], r["mnemonic"], r["depth"], r["value"]) for r in las.curve_samples(files, ("GR",)).collect())
    assert got == [("a.las", 0, "GR", 1000.0, 50.0), ("a.las", 1, "GR", 1000.5, 60.0), ("a.las", 2, "GR", 1001.0, None), ("b.las", 0, "GR", 1000.0, 50.0), ("b.las", 1, "GR", 1001.0, 60.0), ("b.las", 2, "GR", 1001.5, 65.0)]
    spark.dataSource.register(las.LasDataSource)
    assert spark.read.format("las").option("curves", "GR").load(str(tmp_path)).count() == 6


def test_streaming_ingest_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.las").write_text(PLAIN)
    run = lambda: ingest.ingest_samples(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), ("GR",)).awaitTermination(60)
    assert run() and spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "in" / "b.las").write_text(WRAPPED)
    assert run() and spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_windowed_counts(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert ingest.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()
    assert ingest.latest_by_key(e.select("user_id", "ts", "value"), "user_id", "ts").count() == e.select("user_id").distinct().count()


@pytest.mark.parametrize(("lines", "want"), [(["a,b", "1,2"], ","), (["a\tb"], "\t"), (["a;b,c", "1;2,3", "4;5"], ";"), (["a"], ","), ([], ",")])
def test_separator(lines, want):
    assert delimited.detect_separator(lines) == want


def test_delimited_round_trip(spark, tmp_path):
    (tmp_path / "m.txt").write_text('URL;API;Lat\n"x;y";;37.5\nz;12;\n')
    df = delimited.read_delimited(spark, str(tmp_path / "m.txt"))
    assert [tuple(r) for r in df.collect()] == [("x;y", "", "37.5"), ("z", "12", "")]
    delimited.write_csv(df, str(tmp_path / "out"), ["API", "more", "URL"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["API", "more", "URL"]
    delimited.write_parts(spark.range(2500), str(tmp_path / "parts"), 1000)
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2500


def test_tables(spark, tmp_path):
    spark.createDataFrame([("1", "37.5", "-100"), ("2", "x", "-99"), ("3", None, "1")], "well_id string, LAT string, Longitude string").write.parquet(str(tmp_path / "w"))
    assert [tuple(r) for r in tables.read_wells(spark, str(tmp_path / "w")).collect()] == [("1", 37.5, -100.0)]
    picks = spark.createDataFrame([("w", "T", "10.5", 2.0), ("w", "U", "x", 1.0), (" ", "T", "1", 1.0), ("w", "V", "7", float("nan"))], "well_id string, top_name string, depth string, sigma_m double")
    assert sorted(tuple(r) for r in tables.clean_picks(picks).collect()) == [("w", "T", 10.5, 2.0), ("w", "V", 7.0, 5.0)]
    wide = spark.createDataFrame([(1, 1.0, None, 5.0), (1, 2.0, 2.0, 6.0), (2, 1.0, 3.0, None)], "well_id int, md double, GR double, SGR double")
    long = tables.long_wells(wide, ["GR", "SGR"])
    assert {(r["well_id"], r["raw"]) for r in long.collect()} == {(1, "SGR"), (2, "GR")}
    wanted = spark.createDataFrame([("2",)], "well_id string")
    assert [r["well_id"] for r in tables.subset(wide, wanted).collect()] == [2]


def test_paths_pack_and_turn(spark):
    p = spark.createDataFrame([(5, 2, [0, 1, 2], [7, 8, 9]), (1, 3, [0, 1], [4, 5])], "src long, dst long, ii array<int>, jj array<int>")
    turned = paths.oriented(p)
    index, points = paths.pack(turned)
    back = sorted((r["src"], r["dst"], r["ii"], r["jj"]) for r in paths.unpack(index, points).collect())
    assert back == [(1, 3, [0, 1], [4, 5]), (2, 5, [7, 8, 9], [0, 1, 2])]
    edges = spark.createDataFrame([(2, 5), (8, 9)], "src long, dst long")
    assert {(r["src"], r["ii"] and tuple(r["ii"])) for r in paths.inject(edges, p).collect()} == {(2, (7, 8, 9)), (8, None)}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_micro_fixtures(spark):
    m = [headers.norm_mnemonic(F.lit(x)) for x in ("GR:1", " gamma ray ", "RHOZ", "Gamma-Ray", "XYZ")] + [headers.norm_mnemonic(F.lit(None).cast("string"))]
    u = [headers.norm_unit(F.lit(x)) for x in ("usec/ft", "gm/cc", "%", "ohm.m", "NONE")]
    f = [headers.to_float(F.lit(x)) for x in ("1,234.5", "N/A", "", "nan")]
    r = one(spark, m=F.array(*m), u=F.array(*u), f=F.array(*f), h=headers.stable_hash32(F.lit("g0_1")), c=geo.cell_id(F.lit(3), F.lit(-12)), d=geo.haversine_km(F.lit(37.0), F.lit(-100.0), F.lit(38.0), F.lit(-100.0)))
    assert r["m"] == ["GR", "GR", "RHOB", "GR", "XYZ", ""] and r["u"] == ["US/FT", "G/CC", "PU", "OHM-M", ""] and r["f"] == [1234.5, None, None, None]
    assert r["h"] == 1553811102 and r["c"] == "g+000003_-000012" and abs(r["d"] - 111.1951) < 1e-4
    s = one(spark, s=F.array(*[geo.sector(F.lit(a)) for a in (44.999, 45.0, 135.0, 225.0, 315.0)]), sim=scoring.similarity(F.lit(0.25), 0.25), bad=scoring.similarity(F.lit(0.25), 0.25, F.lit("FAIL")))
    assert s["s"] == ["N", "E", "S", "W", "N"] and abs(s["sim"] - 0.367879) < 1e-6 and s["bad"] == 0
    low, high, shared, frac = scoring.overlap(F.lit(1000.0), F.lit(2000.0), F.lit(1500.0), F.lit(2600.0), 10.0)
    assert tuple(one(spark, a=low, b=high, c=shared, d=frac)) == (1490.0, 2010.0, 500.0, 0.5)
    score = scoring.log_suite_score(F.array(*[F.lit(x) for x in ("GR", "RHOB", "NPHI", "DT")]))
    assert abs(one(spark, s=score)["s"] - 17.04) < 1e-9
    hits = one(spark, h=headers.quarantine_hits(F.lit("GR"), F.lit("IN"), F.lit("")))["h"]
    assert sorted(h["severity"] for h in hits) == ["ERROR", "ERROR", "WARN"]
    ids = one(spark, a=F.array(*geo.parse_cell_id(F.lit("g+000003_-000012"))), b=F.array(*geo.parse_cell_id(F.lit("r00004_c00007"))), c=F.array(*geo.parse_cell_id(F.lit("GRID_1_2"))))
    assert (ids["a"], ids["b"], ids["c"]) == ([3, -12], [7, 4], [1, 2])


def test_albers_meets_the_recorded_pair(spark):
    x, y = geo.albers_xy(F.lit(36.299218049983544), F.lit(-102.45248029680477))
    r = one(spark, x=x, y=y)
    assert abs(r["x"] + 573743.71) < 0.01 and abs(r["y"] - 1491733.646) < 0.01
    lat, lon = geo.albers_inverse(np.array([r["x"]]), np.array([r["y"]]))
    assert abs(lat[0] - 36.299218049983544) < 1e-9 and abs(lon[0] + 102.45248029680477) < 1e-9


def test_grid_decisions():
    assert grid.quotas({"a": 2, "b": 10, "c": 10}, 10) == {"a": 2, "b": 4, "c": 4}
    assert sum(grid.quotas({"a": 2, "b": 30, "c": 9}, 20, "proportional", 1).values()) == 20
    merged = grid.merge_small_bins([("a", 1, 37.0, -100.0), ("b", 20, 37.1, -100.0), ("c", 20, 39.0, -100.0)], 10)
    assert merged == {"a": "b", "b": "b", "c": "c"}


def test_series_fixtures(spark):
    s = spark.createDataFrame([(1, float(k), float(k)) for k in range(101)], "well_id long, depth double, value double")
    got = {r["depth"]: r["value"] for r in series.percentile_normalised(s).collect()}
    assert abs(got[50.0] - 0.5) < 1e-12 and got[0.0] == 0 and got[100.0] == 1
    m = spark.createDataFrame([(1, float(k), v) for k, v in enumerate((1.0, 3.0, 2.0, 4.0))], "well_id long, depth double, value double")
    assert [(r["mono"], r["reversed"]) for r in series.monotone(m).orderBy("depth").collect()] == [(1, False), (3, False), (3, True), (4, False)]
    z = spark.createDataFrame([(1, float(k), v) for k, v in enumerate((-1.0, 0.0, 1.0, 1.0, -1.0))], "well_id long, depth double, value double")
    assert [r["depth"] for r in series.zero_crossings(z).orderBy("depth").collect()] == [2.0, 4.0]
    idx = lambda *v: spark.createDataFrame([(1, x) for x in v], "well_id long, idx long")
    assert series.snap(idx(10), idx(7, 13), 5).first()["snapped"] == 7


def test_identity_decisions(spark):
    rows = spark.createDataFrame([("f", "GR", "GAPI", float(40 + k % 60)) for k in range(200)] + [("f", "CALI", "GAPI", 1.0)] * 5, "file string, mnemonic_n string, unit_n string, value double")
    got = {r["mnemonic_n"]: r for r in curves.identity(curves.statistics(rows, ["file", "mnemonic_n", "unit_n"])).collect()}
    assert got["GR"]["inferred_mnemonic"] == "GR" and got["GR"]["decision"] in ("AUTO_FIX", "SUGGEST") and got["CALI"]["decision"] == "NO_ACTION"
