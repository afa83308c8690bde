"""The pipeline's steps chain, and a finished step is not run again."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from faciesforge import __main__ as command
from faciesforge.plans import artifacts, config, views
from faciesforge.plans.steps import Run, Settings, merged
from faciesforge.sources import npz

SF = "/root/testdata/sf0.01"
SETTINGS = Settings(n_samples=48, reps_per_cell=4, n_reps=60, cell_km=60.0, min_finite=50, type_samples=80, radius_km=80.0, wavelets=(2, 4, 8), levels=(0, 1), interval_finite=3, kernel_wells=8, template_samples=64, grid_type_km=100.0, grid_type_least=3, vector_samples=96, window_samples=64, damping=0.05, max_edges=40)


@pytest.fixture(scope="module")
def tables(spark):
    samples = views.series(spark, SF).select("well_id", "depth", F.col("value").cast("double").alias("value"))
    return views.wells(spark, SF).join(samples.select("well_id").distinct(), "well_id", "left_semi"), samples


@pytest.fixture(scope="module")
def run(spark, tables, tmp_path_factory):
    return Run(spark, f"file://{tmp_path_factory.mktemp('run')}/run", SETTINGS)


def test_run(spark, tables, run):
    wells, samples = tables
    scores = wells.select("well_id", (F.col("well_id") % 7).cast("double").alias("score"))
    out = run.run(wells, samples, scores=scores)
    assert out["kept"].count() == wells.count() == out["cells"].count() == 100
    counts = out["graph_counts"].first()
    assert counts["n_nodes"] == 100 and counts["n_edges"] == out["graph"].count() and counts["n_both"] > 0
    reps = out["reps"].collect()
    assert 0 < len(reps) <= 60 and sorted(r["rep_id"] for r in reps) == list(range(1, len(reps) + 1))
    for cell in {r["cell_id"] for r in reps}:
        ranked = [r["score"] for r in sorted(reps, key=lambda r: r["rank"]) if r["cell_id"] == cell]
        assert ranked == sorted(ranked, reverse=True)
    assert out["arrays"].count() == out["arrays_meta"].filter("status = 'OK'").count() == len(reps)
    assert out["types"].filter("error is null").count() > 0 and out["placements"].filter("status = 'ok'").count() > 0
    edges = out["edges"].collect()
    assert edges and all(e["status"] == "OK" and 0 < e["sim"] <= 1 for e in edges)
    assert 0 < out["framework"].count() <= len(edges) and out["shifts"].select("well_id").distinct().count() > 1
    assert out["framework_log"].count() > 40 and out["tops_level0"].count() == out["diagram_wells"].filter("status = 'used'").count() > 0
    assert out["type_log"].count() > 0 and out["tops"].count() > 0 and out["intervals"].filter("level = 1").count() > 0
    again = Run(spark, run.out, SETTINGS).step("00_index", lambda: 1 / 0, ("wells", "kept"))
    assert again["kept"].count() == 100 and Run(spark, "x", Settings(alpha=0.2)).key != run.key


def test_other_ways(tables, run):
    out = run.pairwise(*tables)
    assert out["vectors"].filter("status = 'OK'").count() == 100 and out["pairs"].count() == 40
    assert sum(r["n"] for r in out["pair_counts"].collect()) == 40 and out["pairs"].filter("status in ('ok', 'end_mismatch') and size(ii) > 0").count() > 0
    assert run.grid_type_wells(*tables).filter("status = 'OK'").count() > 0


def test_framework_from_files(spark, tmp_path):
    rnd = np.random.default_rng(1)
    base = np.cumsum(rnd.normal(size=60))
    reps, lines = ["rep_id,lat,lon,las_path,score"], ["src_rep_id,dst_rep_id,dist_km,dtw_cost,dtw_cost_per_step,dtw_steps"]
    for r in range(1, 5):
        rows = "\n".join(f"{1000 + 10 * r + k} {v}" for k, v in enumerate(base))
        (tmp_path / f"{r}.las").write_text(f"~V\nWRAP. NO :\n~W\nNULL. -999 :\n~C\nDEPT.FT :\nGR.GAPI :\n~A\n{rows}\n")
        reps.append(f"{r},38.{r},-98,{tmp_path}/{r}.las,1")
    ties = []
    for a, b in ((1, 2), (2, 3), (1, 3), (3, 4)):
        lines.append(f"{a},{b},1.5,2.0,{0.1 * a + 0.01 * b},80")
        ties.append(json.dumps({"src": a, "dst": b, "ij": [[k, k] for k in range(0, 32, 4)]}))
    lines.append("3,4,1,9,9,9")
    (tmp_path / "r.csv").write_text("\n".join(reps))
    (tmp_path / "e.csv").write_text("\n".join(lines))
    (tmp_path / "p.jsonl").write_text("\n".join(ties))
    out = f"file://{tmp_path}/out"
    facts = artifacts.framework(spark, f"{tmp_path}/r.csv", f"{tmp_path}/e.csv", out, f"{tmp_path}/p.jsonl", n=32, damping=1e-6)
    assert (facts["nodes"], facts["edges_in"], facts["edges_out"], facts["rgt"]["ok"]) == (4, 4, 3, True)
    shifts = {r["id"]: r["values"] for r in npz.read_named(spark, f"{out}/rgt_shifts.npz").collect()}
    assert abs((shifts["1"][0] - shifts["2"][0]) - 10) < 0.1 and json.loads((tmp_path / "out" / "framework_diagnostics.json").read_text())["mode"] == "mst"
    assert artifacts.framework(spark, f"{tmp_path}/r.csv", f"{tmp_path}/e.csv", out, mode="threshold", least=0.6)["rgt"]["reason"] == "no tie points"
    kept = spark.read.csv(f"{out}/framework_edges", header=True).collect()
    assert all(float(r["sim"]) >= 0.6 and r["dist_km"] == "1.500" for r in kept) and 0 < len(kept) < 4


def test_forest_by_rounds_and_at_once(spark):
    from faciesforge.kernels import greedy
    from faciesforge.operators import graph
    from faciesforge.plans.queries import _edges

    edges = _edges(spark, SF).select("src", "dst", "sim")
    want = sorted(greedy.kruskal(edges.toPandas())[["src", "dst"]].itertuples(index=False, name=None))
    for small in (0, 300, 200_000):
        assert sorted((r["src"], r["dst"]) for r in graph.spanning_forest(edges, small).collect()) == want


def test_settings(tmp_path):
    assert Settings.of({"alpha": 0.3, "nothing": 1, "levels": [1]}).levels == (1,)
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    (tmp_path / "c.yaml").write_text('{"step": {"one": {"n": 3}}}')
    values = config.load(tmp_path / "c.yaml")
    assert config.value_at(values, "step.one.n") == 3 and config.value_at(values, "step.two.n", 7) == 7
    assert config.resolved("README.md").exists() and config.plain(Settings())["alpha"] == 0.15
    args = command.arguments().parse_args(["framework", "--reps", "r", "--edges", "e", "--out", "o", "--framework", "topk"])
    assert args.mode == "topk" and args.least == 0.6
