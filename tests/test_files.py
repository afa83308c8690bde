"""The index of a manifest's files, runs that know their inputs, sinks that start again, relative time place by place, batches of alignments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faciesforge.kernels import align
from faciesforge.operators import chronostrat, kernels
from faciesforge.plans import kernel_queries, scan
from faciesforge.plans.steps import Run, Settings, rows_mark
from faciesforge.sources import las
from faciesforge.sources.delimited import CsvSink, read_delimited

HEAD = "~V\nWRAP. {wrap} :\n~W\nNULL. -999.25 :\n~C\n{curves}\n~A\n"


def las_text(curves, rows, wrap="NO"):
    return HEAD.format(wrap=wrap, curves="\n".join(f"{c} :" for c in curves)) + "\n".join(" ".join(map(str, r)) for r in rows) + "\n"


@pytest.fixture
def folder(tmp_path):
    rows = [(1000 + k, -999.25 if k == 3 else k) for k in range(30)]
    files = {
        "good.las": las_text(["DEPT.FT", "GR.GAPI"], [*rows, (-999.25, 7), ("x", "y"), (5,)]),
        "wrapped.las": las_text(["MD.M", "NPHI.", "GAMMA.GAPI"], [(1, 2), (3, 4, 5), (6,), (7, 8, 9, 10)], "YES"),
        "short.las": las_text(["DEPT.FT", "GR.GAPI"], rows[:5]),
        "nogr.las": las_text(["DEPT.FT", "DT.US/FT"], rows),
        "nodepth.las": las_text(["GR.GAPI", "DT.US/FT"], rows),
        "large.las": "x" * 30_000,
        "empty.las": "",
    }
    (tmp_path / "las").mkdir()
    for name, text in files.items():
        (tmp_path / "las" / name).write_text(text)
    lines = ["URL,KGS_ID,API,API_NUM_NODASH,Latitude,Longitude"]
    lines += [f'"http://a/b/{name}",{i},,,38.{i},-98' for i, name in enumerate(files)]
    lines += ["http://a/gone.las,20,,,38,-98", ",21,15-001-2,,38,-98", "http://a/good.las,,15-001-20000,,,-98", "http://a/good.las,22,15-001-1,99,bad,-98"]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_index_of_a_manifest(spark, folder):
    rows = scan.indexed(read_delimited(spark, f"{folder}/m.csv"), f"{folder}/las", scan.Scan(min_finite=3, most_mb=20_000 / 2**20)).collect()
    got = {r["well_id"]: r for r in rows}
    assert len(rows) == 11 and {k: r["status"] for k, r in got.items()} == {
        "0": "OK", "1": "OK", "2": "OK", "3": "NO_GR", "4": "NO_DEPTH", "5": "SKIP_TOO_LARGE", "6": "MISSING_LAS", "20": "MISSING_LAS", "150012": "MISSING_LAS", "1500120000": "OK", "99": "OK",
    }
    good = got["0"]
    assert (good["n_total"], good["n_finite"], good["depth_min"], good["depth_max"]) == (32, 30, 1000.0, 1029.0) and good["finite_frac"] == 30 / 32
    assert good["p50"] == np.median([*(k for k in range(30) if k != 3), 7]) and good["gr_mnemonic_used"] == "GR" and not good["wrapped"]
    wrapped = got["1"]
    assert wrapped["wrapped"] and (wrapped["n_total"], wrapped["n_finite"], wrapped["depth_max"]) == (3, 3, 7.0) and wrapped["gr_mnemonic_used"] == "GAMMA"
    assert got["5"]["reason"].startswith("LAS size 0.03 MB") and got["99"]["lat"] is None and good["reason"] == ""
    short = scan.indexed(read_delimited(spark, f"{folder}/m.csv"), f"{folder}/las", scan.Scan(min_finite=5)).filter("well_id = '2'").first()
    assert short["status"] == "INSUFFICIENT_GR" and short["reason"] == "GR finite samples 4 < min_finite 5"


def test_index_of_nothing(spark, folder):
    none = read_delimited(spark, f"{folder}/m.csv").limit(0)
    assert scan.indexed(none, f"{folder}/las").count() == 0
    (folder / "void").mkdir()
    assert {r[0] for r in scan.indexed(read_delimited(spark, f"{folder}/m.csv"), f"{folder}/void").select("status").collect()} == {"MISSING_LAS"}


def test_run_from_files(spark, folder):
    manifest = read_delimited(spark, f"{folder}/m.csv")
    run = Run(spark, f"file://{folder}/run", Settings(min_finite=3))
    out, wells, samples = run.from_files(manifest, f"{folder}/las", scan.Scan(min_finite=3))
    assert {r["status"]: r["n"] for r in out["counts"].collect()}["OK"] == 5 and sorted(r[0] for r in wells.select("well_id").collect()) == ["0", "1", "2"]
    assert samples.filter("well_id = '0'").count() == 32 and samples.filter("well_id = '1'").select("row", "depth", "value").orderBy("row").first()[:] == (0, 1.0, 3.0)
    again = Run(spark, run.out, Settings(min_finite=3))
    again.from_files(manifest, f"{folder}/las", scan.Scan(min_finite=3))
    assert again.inputs == run.inputs and again.step("00_files", lambda: 1 / 0, ("files",))["files"].count() == 11
    (folder / "las" / "gone.las").write_text(las_text(["DEPT.FT", "GR.GAPI"], [(k, k) for k in range(9)]))
    assert again.from_files(manifest, f"{folder}/las", scan.Scan(min_finite=3))[0]["files"].filter("well_id = '20' and status = 'OK'").count() == 1


def test_runs_tell_their_inputs_apart(spark, tmp_path):
    wells = spark.createDataFrame([(i, 38.0 + i / 10, -98.0) for i in range(6)], "well_id long, lat double, lon double")
    samples = spark.range(6).select(F.col("id").alias("well_id"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k")).select("well_id", F.col("k").cast("double").alias("depth"), (F.col("k") % 7).cast("double").alias("value"))
    kept = lambda w: Run(spark, f"file://{tmp_path}/r", Settings(min_finite=5)).run(w, samples, (0,))["kept"].count()
    assert kept(wells.filter("well_id < 3")) == 3 and kept(wells) == 6 and kept(wells.filter("well_id < 3")) == 3
    assert Run(spark, f"file://{tmp_path}/r", Settings(min_finite=5)).step("00_index", lambda: 1 / 0, ("kept",))["kept"].count() == 3  # the last inputs
    assert rows_mark(wells) == rows_mark(wells.repartition(3)) != rows_mark(wells.union(wells)) and rows_mark(wells) != rows_mark(wells.union(wells).union(wells))


def test_sink_starts_again(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    rows = lambda: spark.read.csv(path, header=True).count()
    table = spark.range(10).repartition(3).withColumn("x", F.lit("a"))
    CsvSink(path, ["id", "x"])(table)
    sink = CsvSink(path, ["id", "x"], overwrite=True)
    for batch in (0, 1):
        sink(table, batch)
    assert rows() == 20
    again = CsvSink(path, ["id", "x"], overwrite=True)
    for batch in (0, 1, 2):
        again(table, batch)
    assert rows() == 30
    (tmp_path / "sink" / "_batches" / f"{2:012d}").unlink()  # as if it had broken off before it was noted
    CsvSink(path, ["id", "x"], overwrite=True)(table, 2)
    assert rows() == 30


def test_stream_into_the_sink_starts_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = f"file://{tmp_path}/out"

    def stream(sink):
        found = spark.readStream.schema("a string").option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/in")
        return found.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()

    def broken(df, batch):
        CsvSink(path, ["a"], overwrite=True)(df, batch)
        raise RuntimeError("lost before the stream could note the batch")

    (tmp_path / "in" / "1.csv").write_text("x\ny\n")
    with pytest.raises(Exception, match="lost before"):
        stream(broken).awaitTermination(60)
    (tmp_path / "in" / "2.csv").write_text("z\n")
    assert stream(CsvSink(path, ["a"], overwrite=True)).awaitTermination(60)
    assert sorted(r[0] for r in spark.read.csv(path, header=True).collect()) == ["x", "y", "z"]


def test_small_files_share_a_task(spark, folder):
    spark.dataSource.register(las.LasDataSource)
    source = lambda path, **options: spark.read.format("las").options(**options).load(f"{folder}/{path}")
    every = source("las", curves="GR")
    assert every.rdd.getNumPartitions() == 1 and source("las", partitionBytes=9_000).rdd.getNumPartitions() > 1
    got = sorted((r["path"].rsplit("/", 1)[-1], r["row"], r["depth"], r["value"]) for r in every.collect())
    want = sorted((r["path"].rsplit("/", 1)[-1], r["row"], r["depth"], r["value"]) for r in las.curve_samples(las.read_text(spark, f"{folder}/las"), ("GR",)).collect())
    assert repr(got) == repr(want) and len(got) == 30 + 2 + 3 + 5
    assert source("las/s*.las").select("path").distinct().count() == 1 == source("las/nogr.las").select("path").distinct().count() and source("none").count() == 0


# ---- relative time -----------------------------------------------------------------------------------


@pytest.mark.parametrize("crossing", [False, True])
@pytest.mark.parametrize("small", [1_000_000, 0])
def test_relative_time_against_a_dense_system(spark, crossing, small):
    rnd = np.random.default_rng(3)
    wells, n = 6, 5
    edges = [(0, 1), (1, 2), (0, 2), (4, 5)]
    rows = [(a, int(i), b, int((i + crossing * rnd.integers(0, 2)) % n), float(rnd.normal())) for a, b in edges for i in range(n)]
    anchors = [(0, k, 1.5 + k, 0.7) for k in range(n)] + [(5, 2, -1.0, 2.0), (77, 0, 9.0, 1.0)]
    known = sorted({(a, i) for a, i, *_ in rows} | {(b, j) for _, _, b, j, _ in rows})
    at = {u: k for k, u in enumerate(known)}
    m, rhs = np.eye(len(at)) * 0.05, np.zeros(len(at))
    for a, i, b, j, dz in rows:
        row = np.zeros(len(at))
        row[at[a, i]], row[at[b, j]] = 1, -1
        m, rhs = m + np.outer(row, row), rhs + dz * row
    for w, k, target, weight in anchors:
        if (w, k) in at:
            m[at[w, k], at[w, k]] += 0.5 * weight**2
            rhs[at[w, k]] += 0.5 * weight**2 * target
    want = np.linalg.solve(m, rhs)
    found = chronostrat.solved(spark.createDataFrame(rows, "src long, i int, dst long, j int, dz double"), spark.createDataFrame(anchors, "well_id long, k int, target double, weight double"), 0.05, 0.5, 1e-10, 200, small)
    got = {(r["well_id"], r["k"]): r["shift"] for r in found.collect()}
    assert set(got) == set(at) and np.allclose([got[u] for u in known], want, atol=1e-6) and wells == 6


# ---- alignment ---------------------------------------------------------------------------------------


def slow(x, y, alpha, free):
    d = np.full((len(x) + 1, len(y) + 1), 1e30)
    d[0, 0] = 0
    if free:
        d[0, :] = 0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i, j] = abs(x[i - 1] - y[j - 1]) ** alpha + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    return d[1:, 1:]


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (8, 21), (21, 8), (17, 17)])
def test_many_alignments_at_once(monkeypatch, shape):
    monkeypatch.setattr(align, "CELLS", 3000)
    rnd = np.random.default_rng(1)
    x, y = rnd.integers(0, 4, (40, shape[0])) / 2, rnd.integers(0, 4, (40, shape[1])) / 2
    for k, (cost, path) in enumerate(align.dtw_many(x, y, 0.5)):
        assert np.isclose(cost, slow(x[k], y[k], 0.5, False)[-1, -1]) and np.isclose(cost, (np.abs(x[k][path[:, 0]] - y[k][path[:, 1]]) ** 0.5).sum())
        assert path[0].tolist() == [0, 0] and path[-1].tolist() == [shape[0] - 1, shape[1] - 1] and (np.diff(path, axis=0) >= 0).all() and (np.diff(path, axis=0).sum(axis=1) >= 1).all()
    if min(shape) >= 8:
        for k, (cost, path) in enumerate(align.subsequence_many(x, y, 0.5)):
            end = slow(x[k], y[k], 0.5, True)[-1]
            assert np.isclose(cost, end.min()) and path[-1, 1] == end.argmin() and path[0, 0] == 0


def test_alignment_inside_a_band():
    x, y = np.random.default_rng(2).random((2, 5, 30))
    for (_, path), a, b in zip(align.dtw_many(x, y, 0.5, 3), x, y, strict=True):
        assert (np.abs(path[:, 0] - path[:, 1]) <= 3).all() and (align.dtw(a, b, 0.5, 3)[1] == path).all()


def test_edges_of_all_kinds_in_a_table(spark):
    nan = float("nan")
    rnd = np.random.default_rng(3)
    rows = [(i, i + 1, rnd.random(n).tolist(), rnd.random(m).tolist()) for i, (n, m) in enumerate([(12, 12), (9, 15), (12, 12), (15, 9)] * 5)]
    rows += [(90, 91, None, [1.0] * 9), (92, 93, [1.0] * 3, [1.0] * 9), (94, 95, [nan, 1.0, None, *[2.0] * 8], [1.0] * 9), (96, 97, [], [])]
    got = {r["src"]: r for r in kernels.align_edges(spark.createDataFrame(rows, "src long, dst long, x array<double>, y array<double>"), points=6).collect()}
    assert [got[k]["status"] for k in (90, 92, 94, 96)] == ["SKIP:missing_arrays", "SKIP:too_short", "OK", "SKIP:too_short"] and got[90]["ii"] == [] and got[90]["cost"] is None
    for i, _, x, y in rows[:20]:
        cost, path = align.dtw(np.array(x), np.array(y))
        ties = align.path_sample(path, 6)
        assert np.isclose(got[i]["cost"], cost) and got[i]["ii"] == ties[:, 0].tolist() and got[i]["jj"] == ties[:, 1].tolist() and got[i]["steps"] == len(ties)
    assert pd.isna(got[92]["cps"])


@pytest.mark.parametrize("name", sorted(kernel_queries.SQL))
def test_kernel_queries_that_sql_can_say(spark, duck, name):
    df, want = kernel_queries.QUERIES[name](spark, "/root/testdata/sf0.01"), duck.sql(kernel_queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in df.select(*want.columns).collect()) == sorted(want.fetchall())
