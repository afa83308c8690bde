"""A framework and its relative time from files alone: representatives, aligned edges and, for the solve, tie points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import scoring
from ..operators import chronostrat, graph, kernels
from ..scratch import cut
from ..sources import las, npz
from ..sources.delimited import read_delimited, write_csv
from ..sources.paths import read_tiepoints
from ..sources.state import write_json

NODES = ["rep_id", "lat", "lon", "las_path", "curve_used", "score"]
EDGES = ["src_rep_id", "dst_rep_id", "dist_km", "dtw_cost", "dtw_cost_per_step", "sim", "dtw_steps"]


def pruned(edges: DataFrame, mode: str, topk: int, least: float) -> DataFrame:
    """The framework of ``edges(src, dst, sim)``: a spanning forest, each node's most similar, or all that are similar enough."""
    if mode == "mst":
        return graph.spanning_forest(edges).select("src", "dst", "sim")
    if mode == "topk":
        return graph.topk_per_node(edges, topk)
    if mode == "mst_plus_topk":
        return kernels.forest_and_extras(edges, topk, least)
    if mode == "threshold":
        return graph.threshold(edges, least).select("src", "dst", "sim")
    raise ValueError(f"no framework by {mode!r}")


def depth_arrays(spark: SparkSession, reps: DataFrame, n: int, curve: str) -> DataFrame:
    """(well_id, x, depths, status) of the representatives' files."""
    paths = [r[0] for r in reps.select("las_path").filter("las_path <> ''").distinct().collect()]  # representatives are few
    if not paths:
        return spark.createDataFrame([], "well_id long, x array<double>, depths array<double>, status string")
    files = spark.read.text(paths, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"), F.col("value").alias("text"))
    got = las.resampled_curves(files, n, (curve,), min_finite=8)
    depth = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("top") + k * (F.col("base") - F.col("top")) / (n - 1))
    own = reps.select(F.col("rep_id").cast("long").alias("well_id"), F.regexp_replace("las_path", "^file:/*", "/").alias("path"))
    return own.join(got, "path").select("well_id", "x", F.when(F.col("x").isNotNull(), depth).alias("depths"), "status")


def framework(spark: SparkSession, reps_csv: str, edges_csv: str, out: str, paths_jsonl: str | None = None, curve: str = "GR", n: int = 400, mode: str = "mst", topk: int = 3, least: float = 0.60, scale: float = 0.25, damping: float = 0.01, precise: bool = False, most: int = 500, tol: float = 1e-6) -> dict:
    """Write nodes, edges, diagnostics and, where there are tie points, shifts; the diagnostics are returned too."""
    reps, raw = read_delimited(spark, reps_csv), read_delimited(spark, edges_csv)
    have = set(reps.columns)
    number = lambda c: H.to_float(F.col(c))
    edges = raw.select(F.col("src_rep_id").cast("long").alias("src"), F.col("dst_rep_id").cast("long").alias("dst"), number("dist_km").alias("dist_km"), number("dtw_cost").alias("cost"), number("dtw_cost_per_step").alias("cps"), (number("dtw_steps") if "dtw_steps" in raw.columns else F.lit(None)).cast("long").alias("steps"))
    edges = edges.join(reps.select(F.col("rep_id").cast("long").alias("src")), "src", "left_semi").join(reps.select(F.col("rep_id").cast("long").alias("dst")), "dst", "left_semi")
    edges = graph.cheapest(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "dist_km", "cost", "cps", "steps").filter("src <> dst and cps is not null"))
    edges = cut(edges.withColumn("sim", scoring.similarity(F.col("cps"), scale)), "artifact-edges")
    frame = cut(pruned(edges.select("src", "dst", "sim"), mode, topk, least), "artifact-frame")
    nodes = reps.select(F.col("rep_id"), *[(F.col(c) if c in have else F.lit("")).alias(c) for c in ("lat", "lon", "las_path")], (F.col("picked_gr") if "picked_gr" in have else F.lit(curve)).alias("curve_used"), (F.col("score") if "score" in have else F.lit("")).alias("score"))
    write_csv(nodes, f"{out}/framework_nodes", NODES, "overwrite")
    kept = frame.select("src", "dst").join(edges, ["src", "dst"])
    text = lambda c, f: F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c))).otherwise("")
    shown = kept.select(F.col("src").alias("src_rep_id"), F.col("dst").alias("dst_rep_id"), text("dist_km", "%.3f").alias("dist_km"), text("cost", "%.6g").alias("dtw_cost"), text("cps", "%.6g").alias("dtw_cost_per_step"), text("sim", "%.6g").alias("sim"), F.coalesce("steps", F.lit(0)).alias("dtw_steps"))
    write_csv(shown, f"{out}/framework_edges", EDGES, "overwrite")
    facts: dict = {"nodes": reps.count(), "edges_in": edges.count(), "edges_out": frame.count(), "mode": mode, "rgt": {"ok": False, "reason": "no tie points"}}
    if paths_jsonl:
        paths = frame.select("src", "dst").join(read_tiepoints(spark, paths_jsonl), ["src", "dst"])
        arrays = cut(depth_arrays(spark, nodes, n, curve), "artifact-arrays")
        rows = cut(chronostrat.equations(paths, arrays.filter("depths is not null"), precise), "artifact-equations")
        facts["nodes_failed"] = arrays.filter("depths is null").count()
        if rows.isEmpty():
            facts["rgt"]["reason"] = "no equations"
        else:
            shifts = cut(chronostrat.solved(rows, None, damping, 0.0, tol, most), "artifact-shifts")
            whole = arrays.filter("depths is not null").select("well_id", F.posexplode("depths").alias("k", "z")).join(shifts, ["well_id", "k"], "left")
            packed = whole.groupBy("well_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("shift", F.lit(0.0)).alias("s")))), lambda q: q["s"]).alias("shifts"))
            npz.write_named(packed, f"{out}/rgt_shifts.npz", "well_id", "shifts")
            facts["rgt"] = {"ok": True, "damping": damping, "equations": rows.count()}
    write_json(f"{out.removeprefix('file://')}/framework_diagnostics.json", facts)
    return facts
