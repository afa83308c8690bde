"""The correlation pipeline, step by step, over tables.

Inputs are ``wells(well_id, lat, lon)`` and long ``samples(well_id, depth, value)``. Each
step writes its tables under a folder named by the step, a hash of the settings and one of the
rows of the inputs, and a step whose folder is complete is read instead of run: changed settings
or inputs never meet old tables, and an interrupted run goes on at the step it was in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import chronostrat, curves, framework, graph, grid, kernels, merging, series, spatial, typewells, windowed
from ..operators.order import numbered
from ..scratch import cut
from ..sources.state import meta_table
from .scan import Scan, indexed, listing, samples_of


@dataclass(frozen=True)
class Settings:
    min_finite: int = 200
    cell_km: float = 20.0
    lat0: float = 38.5
    min_bin: int = 10
    k_max: int = 12
    radius_km: float = 8.0
    knn_candidates: int = 24
    n_reps: int = 1000
    reps_per_cell: int = 12
    n_samples: int = 400
    alpha: float = 0.15
    tie_points: int = 80
    sim_scale: float = 0.25
    extra: int = 3
    extra_least: float = 0.0
    damping: float = 0.01
    precise_paths: bool = False
    anchor_pull: float = 0.0
    type_samples: int = 400
    time_pad: float = 0.0
    wavelets: tuple[int, ...] = (2, 4, 6, 8, 12, 16, 24, 32)
    snap_window: int = 25
    levels: tuple[int, ...] = (0, 2, 4)
    ntg_cutoff: float = 0.40
    interval_finite: int = 20
    template_samples: int = 256
    kernel_radius: int = 1
    kernel_radius_max: int = 3
    kernel_wells: int = 20
    kernel_cap: int = 200
    grid_type_km: float = 10.0
    grid_type_least: int = 12
    grid_nearest: int = 40
    grid_nearest_km: float = 50.0
    vector_samples: int = 1024
    window_samples: int = 512
    min_overlap: float = 50.0
    base_pad: float = 10.0
    pad_per_km: float = 0.0
    candidates_per_cell: int = 25
    max_edges: int = 0

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From a configuration's values; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def merged(base: dict, over: dict) -> dict:
    """Nested configurations, the second one winning key by key."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def index(wells: DataFrame, samples: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Statistics and status of every well; ``kept`` are those with enough samples."""
    stats = curves.statistics(samples, ["well_id"]).join(samples.groupBy("well_id").agg(F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max")), "well_id")
    rows = wells.join(stats, "well_id", "left").withColumn("n_finite", F.coalesce("n_finite", F.lit(0)))
    true = F.lit(True)
    rows = rows.withColumns({"exists": F.col("n").isNotNull(), "too_large": ~true, "header_ok": true, "has_depth": F.coalesce(F.col("depth_max") > F.col("depth_min"), F.lit(False)), "has_gr": F.col("n_finite") > 0, "stream_ok": true})
    status = curves.keep_status(rows, s.min_finite).drop("exists", "too_large", "header_ok", "has_depth", "has_gr", "stream_ok")
    return {"wells": status, "kept": status.filter("status = 'OK'"), "status_counts": curves.status_counts(status)}


def bins(kept: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Cells of the kept wells, their meta rows, and the bin that each cell belongs to after small ones merged."""
    cells = grid.assign(kept.select("well_id", "lat", "lon"), s.cell_km, s.lat0)
    meta = grid.bins_meta(cells)
    counts = meta.select(F.col("cell_id").alias("id"), F.col("n_wells").alias("n"), F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))
    into = merging.merged(counts, s.min_bin, 3 * s.cell_km).withColumnRenamed("id", "cell_id")
    return {"cells": cells.join(into, "cell_id"), "meta": meta}


def candidates(kept: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """The spatial graph of all kept wells, and its counts."""
    points = kept.select(F.col("well_id").alias("id"), "lat", "lon")
    edges, counts = framework.spatial_graph(points, s.k_max, s.knn_candidates, s.radius_km, s.radius_km)
    return {"edges": edges, "edge_counts": counts}


def vectors(kept: DataFrame, samples: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Every kept well's curve as one vector of even samples."""
    own = samples.join(kept.select("well_id"), "well_id", "left_semi")
    ordered = own if "row" in own.columns else own.withColumn("row", F.row_number().over(Window.partitionBy("well_id").orderBy("depth")).cast("long"))
    return {"vectors": windowed.vectors(ordered, s.vector_samples)}


def pairs(kept: DataFrame, edges: DataFrame, stored: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Every edge of the spatial graph aligned over the depths of both its ends, and how many came to each status."""
    how = windowed.Windowing(n=s.window_samples, alpha=s.alpha, base_pad=s.base_pad, pad_per_km=s.pad_per_km, min_overlap=s.min_overlap, stored_only=True)
    wanted = framework.sampled_edges(edges, s.max_edges) if s.max_edges else edges
    found = cut(windowed.aligned(wanted, kept.select("well_id", "depth_min", "depth_max"), stored, how), "pairs")
    return {"pairs": found, "pair_counts": windowed.diagnostics(found)}


def representatives(cells: DataFrame, s: Settings, scores: DataFrame | None = None) -> dict[str, DataFrame]:
    """Wells that stand for their cells: of the candidates (farthest points, then others in a seeded order, twice as many at most) the
    cell's quota of the best ``scores(well_id, score)``, without scores in the candidates' order; numbered through."""
    quota = merging.quotas(cells.groupBy("cell_id").agg(F.count("*").alias("n")), s.n_reps)
    most = max(s.candidates_per_cell, s.reps_per_cell)
    first = kernels.farthest_in_cells(cells, most).select("cell_id", "well_id", "place")
    others = cells.select("cell_id", "well_id").join(first.select("well_id"), "well_id", "left_anti").select("cell_id", "well_id")
    others = grid.hashed_sample(others, "well_id", ["cell_id"], most).select("cell_id", "well_id", (F.col("draw") + most - 1).cast("int").alias("place"))
    tried = first.union(others) if scores is not None else first
    scored = tried.join(scores.select("well_id", "score"), "well_id").filter("score > -1e8") if scores is not None else tried.withColumn("score", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("score"), "place"))
    picked = scored.withColumn("rank", rank.cast("int")).join(quota, "cell_id").filter("rank <= quota")
    out = picked.join(cells.select("well_id", "lat", "lon"), "well_id").select("well_id", "cell_id", "rank", "score", "lat", "lon")
    return {"reps": numbered(out, [F.col("cell_id"), F.col("rank")], "rep_id")}


def type_wells(cells: DataFrame, reps: DataFrame, samples: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """The type well of every cell and where each representative lies in its cell's."""
    members = cut(typewells.kernel_members(cells, s.kernel_radius, s.kernel_radius_max, s.kernel_wells, s.kernel_cap), "members")
    features = cut(typewells.template_features(samples.join(members.select("well_id").distinct(), "well_id", "left_semi"), s.template_samples, s.ntg_cutoff), "features")
    types = cut(typewells.local_type_wells(members, features), "types")
    curve = samples.join(reps.select("well_id"), "well_id", "left_semi").groupBy("well_id").agg(F.array_sort(F.collect_list(F.struct("depth", "value"))).alias("p"))  # a well's samples
    rows = reps.join(curve, "well_id", "left").select("rep_id", "cell_id", F.transform("p", lambda q: q["depth"]).alias("depths"), F.transform("p", lambda q: q["value"]).alias("values"))
    return {"types": types, "placements": typewells.placed(rows, types, alpha=s.alpha)}


def grid_types(kept: DataFrame, samples: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """The type well of every cell of a finer grid, by whole curves and nearer wells more."""
    cells = grid.assign(kept.select("well_id", "lat", "lon"), s.grid_type_km, s.lat0)
    members = cut(typewells.kernel_members(cells, s.kernel_radius, s.kernel_radius_max, s.grid_type_least, 80, s.grid_nearest, s.grid_nearest_km), "members")
    quality = cut(typewells.curve_quality(samples.join(members.select("well_id").distinct(), "well_id", "left_semi")), "quality")
    return {"grid_types": typewells.grid_type_wells(members, quality, s.grid_type_least)}


def arrays(reps: DataFrame, samples: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Each representative's series: gaps filled, resampled, normalised between percentiles, as an array with its depths; and its meta row."""
    own = samples.join(reps.select("well_id"), "well_id", "left_semi")
    even = series.resample(series.fill_linear(series.dedupe_mean(own)), s.n_samples)
    scaled = series.percentile_normalised(even).join(even.select("well_id", "k", "depth"), ["well_id", "depth"])
    packed = scaled.groupBy("well_id").agg(F.array_sort(F.collect_list(F.struct("k", "depth", "value"))).alias("p"), F.min("depth").alias("top"), F.max("depth").alias("base"))
    out = cut(packed.select("well_id", F.transform("p", lambda x: x["value"]).alias("x"), F.transform("p", lambda x: x["depth"]).alias("depths"), "top", "base"), "arrays")
    return {"arrays": out, "arrays_meta": meta_table(reps.select("well_id").join(out.select("well_id", "x"), "well_id", "left"))}


def correlation(reps: DataFrame, arrays: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Aligned candidate edges, the framework of the best of them, and each representative's shift at each of its samples."""
    points = reps.select(F.col("well_id").alias("id"), "lat", "lon")
    near = cut(spatial.quadrant_candidates_anywhere(points, s.k_max, s.radius_km).select("src", "dst", "dist_km"), "candidates")
    sides = [arrays.select(F.col("well_id").alias(end), F.col("x").alias(v)) for end, v in (("src", "x"), ("dst", "y"))]
    met = near.join(sides[0], "src", "left").join(sides[1], "dst", "left")
    aligned = cut(kernels.align_edges(met, s.alpha, s.tie_points), "aligned").join(near, ["src", "dst"])
    aligned = cut(aligned.withColumn("sim", scoring.similarity(F.col("cps"), s.sim_scale, F.col("status"))), "similar")
    good = graph.usable(aligned)
    frame = cut(kernels.forest_and_extras(good, s.extra, s.extra_least), "frame")
    rows = chronostrat.equations(frame.join(good.select("src", "dst", "ii", "jj"), ["src", "dst"]), arrays, s.precise_paths)
    anchor = graph.anchors(frame).select(F.col("anchor").alias("well_id"), F.explode(F.sequence(F.lit(0), F.lit(s.n_samples - 1))).alias("k"), F.lit(0.0).alias("target"), F.lit(1.0).alias("weight"))
    return {"edges": aligned.select("src", "dst", "dist_km", "status", "cost", "steps", "cps", "sim", "ii", "jj"), "framework": frame, "shifts": chronostrat.solved(rows, anchor, s.damping, s.anchor_pull)}


def shifted(arrays: DataFrame, shifts: DataFrame) -> DataFrame:
    """Long samples with their shifts: a sample without an equation has none of its own and takes the well's median."""
    long = arrays.select("well_id", F.posexplode(F.arrays_zip("depths", "x")).alias("k", "p")).select("well_id", "k", F.col("p.depths").alias("depth"), F.col("p.x").alias("value"))
    usual = shifts.groupBy("well_id").agg(F.median("shift").alias("usual"))
    return long.join(shifts, ["well_id", "k"], "left").join(usual, "well_id", "left").withColumn("shift", F.coalesce("shift", "usual")).drop("usual")


def products(arrays: DataFrame, shifts: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """The chronostratigraphic diagram of all representatives, its type log, and tops at every scale."""
    rows, wells = chronostrat.diagram(shifted(arrays, shifts), [], s.type_samples, s.time_pad)
    rows = cut(rows, "diagram")
    log = cut(chronostrat.type_log(rows, []), "log")
    tops = cut(chronostrat.multiscale_tops(log, [], s.wavelets, s.snap_window), "tops")
    tables = {f"tops_level{k}": chronostrat.tops_table(rows, tops, log, k) for k in s.levels if k < len(s.wavelets)}
    return {"diagram": rows, "diagram_wells": wells, "framework_log": log, "framework_tops": tops} | tables


def type_columns(cells: DataFrame, arrays: DataFrame, shifts: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """For each cell the diagram of the representatives in its kernel, their type log, its tops at every scale and statistics between them."""
    own = cells.join(arrays.select("well_id"), "well_id", "left_semi")
    members = typewells.kernel_members(own, s.kernel_radius, s.kernel_radius_max, min(s.kernel_wells, 5), s.kernel_cap).select("cell_id", "well_id")
    rows, wells = chronostrat.diagram(shifted(arrays, shifts).join(members, "well_id"), ["cell_id"], s.type_samples, s.time_pad)
    rows = cut(rows, "diagrams")
    log = cut(chronostrat.type_log(rows, ["cell_id"]), "logs")
    tops = cut(chronostrat.multiscale_tops(log, ["cell_id"], s.wavelets, s.snap_window), "cell-tops")
    key = F.concat_ws("|", "cell_id", "level")
    levels = tops.select("cell_id", "level").distinct()
    as_wells = log.join(levels, "cell_id").select(key.alias("well_id"), F.col("place").cast("long").alias("k"), "value")
    stats = series.interval_stats(as_wells, tops.select(key.alias("well_id"), F.col("place").cast("long").alias("idx")), s.ntg_cutoff, s.interval_finite)
    parts = F.split("well_id", "\\|")
    named = stats.select(parts[0].alias("cell_id"), parts[1].cast("int").alias("level"), *[c for c in stats.columns if c != "well_id"])
    return {"type_log": log, "type_wells": wells, "tops": tops, "intervals": named}


#: Steps whose tables depend on the representatives' scores.
RANKED = ("02_reps", "02_typewells", "02_arrays", "03_correlation", "03_products", "04_type_columns")


def rows_mark(*tables: DataFrame) -> str:
    """A hash of the rows of tables, in whatever order, and of their columns."""
    marks = []
    for df in tables:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
        # sums besides the exclusive or, so that repeated rows do not cancel out
        found = df.agg(F.count("*"), F.bit_xor(row), F.sum(F.shiftrightunsigned(row, 32)), F.sum(row.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        marks.append([sorted(df.dtypes), list(found)])
    return hashlib.sha1(json.dumps(marks).encode()).hexdigest()[:12]


class Run:
    """A run's folder of tables."""

    def __init__(self, spark: SparkSession, out: str, settings: Settings):
        self.spark, self.out, self.settings = spark, out.rstrip("/"), settings
        self.key = hashlib.sha1(json.dumps(asdict(settings), sort_keys=True).encode()).hexdigest()[:12]
        self.inputs: str | None = None
        self.ranked = ""

    def given(self, *tables: DataFrame, scores: DataFrame | None = None) -> None:
        """From now on the steps are those of these inputs, and so for later runs of these settings until they are given others."""
        self.inputs, self.ranked = rows_mark(*tables), "" if scores is None else f"-{rows_mark(scores)}"
        self.spark.createDataFrame([(self.inputs,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.out}/inputs-{self.key}")

    def _path(self, step: str) -> str:
        if self.inputs is None and self._exists(last := f"{self.out}/inputs-{self.key}"):
            self.inputs = self.spark.read.text(last).first()[0]
        return f"{self.out}/{step}-{self.key}" + (f"-{self.inputs}" if self.inputs else "") + (self.ranked if step in RANKED else "")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def step(self, name: str, make: Callable[[], dict[str, DataFrame]], tables: tuple[str, ...]) -> dict[str, DataFrame]:
        """The step's tables, made unless every one has been written to its end."""
        paths = {t: f"{self._path(name)}/{t}" for t in tables}
        missing = [t for t in tables if not self._exists(f"{paths[t]}/_SUCCESS")]
        if missing:
            made = make()
            for t in missing:
                made[t].write.mode("overwrite").parquet(paths[t])
        return {t: self.spark.read.parquet(p) for t, p in paths.items()}

    def from_files(self, manifest: DataFrame, root: str, scan: Scan = Scan()) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
        """The index of a manifest's LAS files, and the wells and samples that the other steps take. Only what is new is read: the
        inputs are the manifest's rows and the folder's listing."""
        self.given(manifest, listing(self.spark, root), self.spark.createDataFrame([(repr(scan),)], "scan string"))
        rows = self.step("00_files", lambda: {"files": indexed(manifest, root, scan)}, ("files",))["files"]
        kept = rows.filter("status = 'OK' and lat is not null and lon is not null").dropDuplicates(["well_id"])
        made = self.step("00_samples", lambda: {"counts": curves.status_counts(rows), "samples": samples_of(kept, root, scan.family)}, ("counts", "samples"))
        return {"files": rows, "counts": made["counts"]}, kept.select("well_id", "lat", "lon"), made["samples"]

    def run(self, wells: DataFrame, samples: DataFrame, steps: tuple[int, ...] = (0, 1, 2, 3, 4), scores: DataFrame | None = None) -> dict[str, DataFrame]:
        """The steps up to the last one asked for; what they need is read or made. ``scores(well_id, score)`` rank representatives."""
        s, last, out = self.settings, max(steps), {}
        self.given(wells, samples, scores=scores)
        out |= self.step("00_index", lambda: index(wells, samples, s), ("wells", "kept", "status_counts"))
        if last >= 1:
            out |= self.step("01_bins", lambda: bins(out["kept"], s), ("cells", "meta"))
            step = self.step("01_graph", lambda: candidates(out["kept"], s), ("edges", "edge_counts"))
            out |= {"graph": step["edges"], "graph_counts": step["edge_counts"]}
        if last >= 2:
            out |= self.step("02_reps", lambda: representatives(out["cells"], s, scores), ("reps",))
            out |= self.step("02_typewells", lambda: type_wells(out["cells"], out["reps"], samples, s), ("types", "placements"))
            out |= self.step("02_arrays", lambda: arrays(out["reps"], samples, s), ("arrays", "arrays_meta"))
        if last >= 3:
            out |= self.step("03_correlation", lambda: correlation(out["reps"], out["arrays"], s), ("edges", "framework", "shifts"))
            levels = tuple(f"tops_level{k}" for k in s.levels if k < len(s.wavelets))
            out |= self.step("03_products", lambda: products(out["arrays"], out["shifts"], s), ("diagram", "diagram_wells", "framework_log", "framework_tops", *levels))
        if last >= 4:
            out |= self.step("04_type_columns", lambda: type_columns(out["cells"], out["arrays"], out["shifts"], s), ("type_log", "type_wells", "tops", "intervals"))
        return out

    def pairwise(self, wells: DataFrame, samples: DataFrame) -> dict[str, DataFrame]:
        """The other way through: every edge of the spatial graph aligned over the depths of both ends."""
        s, out = self.settings, self.run(wells, samples, (1,))
        out |= self.step("02_vectors", lambda: vectors(out["kept"], samples, s), ("vectors",))
        return out | self.step("02_pairs", lambda: pairs(out["kept"], out["graph"], out["vectors"], s), ("pairs", "pair_counts"))

    def grid_type_wells(self, wells: DataFrame, samples: DataFrame) -> DataFrame:
        """Type wells of a finer grid."""
        out = self.run(wells, samples, (0,))
        return self.step("02_typewells_grid", lambda: grid_types(out["kept"], samples, self.settings), ("grid_types",))["grid_types"]
