"""Type wells of cells and the place of representatives in them.

A cell's candidates are the wells of the smallest kernel of cells around it that holds enough of them. Kernels
overlap, so candidates are rows of their own: (cell, well). How many a cell keeps is a setting, so what meets in a
cell's task is bounded by settings and not by how many wells there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..kernels import align, greedy, traces, typewell
from . import spatial


def curve_quality(samples: DataFrame, n_shape: int = 128, **settings) -> DataFrame:
    """One row a well of ``samples(well_id, depth, value)``: status and reason, range, statistics and shape of its whole curve."""
    numbers = ("top", "base", "finite_frac", "p05", "p50", "p95", "iqr", "spread", "std", "sand_frac", "thickness")
    schema = "well_id long, status string, error string, n long, " + ", ".join(f"{c} double" for c in numbers) + ", shape array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["depth", "value"])
        q = traces.quality(pdf.depth.to_numpy(float), pdf.value.to_numpy(float), n_shape, **settings)
        row = {"well_id": pdf.well_id.iloc[0], "status": q.status, "error": q.error, "n": q.n, "shape": q.shape}
        return pd.DataFrame([row | {c: getattr(q, c) for c in numbers}])[[c.split()[0] for c in schema.split(", ")]]

    return samples.select("well_id", "depth", "value").groupBy("well_id").applyInPandas(run, schema)


def template_features(samples: DataFrame, n: int = 256, cutoff: float = 0.40) -> DataFrame:
    """One row a well: its curve as ``n`` even samples between its percentiles, and what the gates and the medoid look at."""
    schema = "well_id long, x array<double>, top double, base double, thickness double, n_finite long, ntg double, mean double, iqr double, range95 double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["depth", "value"])
        try:
            t = traces.resampled(pdf.depth, pdf.value, n)
        except traces.TraceError:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        p5, p25, p75, p95 = np.percentile(t.x, [5, 25, 75, 95])
        return pd.DataFrame([(pdf.well_id.iloc[0], t.x, t.top, t.base, t.base - t.top, t.n_finite, (t.x < cutoff).mean(), t.x.mean(), p75 - p25, p95 - p5)], columns=[c.split()[0] for c in schema.split(", ")])

    return samples.select("well_id", "depth", "value").groupBy("well_id").applyInPandas(run, schema)


def hard_gate(min_thickness: float = 1.0, min_finite_frac: float = 0.20) -> Column:
    """Whether a row of ``curve_quality`` may be a type well at all."""
    ok = (F.col("status") != "FAIL") & (F.col("thickness") > min_thickness) & ~F.isnan("thickness") & (F.col("finite_frac") >= min_finite_frac) & (F.size("shape") >= 8)
    return F.coalesce(ok, F.lit(False))


def template_gate(thickness: tuple[float, float] = (50.0, 50_000.0), min_finite: int = 64, min_range95: float = 0.08, min_iqr: float = 0.04) -> Column:
    """Whether a row of ``template_features`` is thick, full and varied enough."""
    return F.coalesce(F.col("thickness").between(*thickness) & (F.col("n_finite") >= min_finite) & (F.col("range95") >= min_range95) & (F.col("iqr") >= min_iqr), F.lit(False))


def gated(rows: DataFrame, passes: Column, by: list[str], least: int = 5) -> DataFrame:
    """The rows of each group that pass, or all of a group where fewer than ``least`` do."""
    n = F.sum(passes.cast("int")).over(Window.partitionBy(*by))
    return rows.withColumn("_passes", passes).withColumn("_n", n).filter(F.col("_passes") | (F.col("_n") < least)).drop("_passes", "_n")


def kernel_members(cells: DataFrame, radius: int = 1, radius_max: int = 3, n_min: int = 20, cap: int = 200, nearest: int = 0, nearest_km: float = 50.0) -> DataFrame:
    """(cell_id, well_id, lat, lon, dist_km, radius): the wells around each cell of ``cells(well_id, ix, iy, cell_id, lat, lon)``.

    The first radius whose cells hold ``n_min`` wells counts, else the largest. With ``nearest``, a cell whose largest kernel holds
    too few takes that many nearest wells within ``nearest_km`` of its middle instead (radius -1). Of more than ``cap`` the nearest stay.
    """
    own = cells.groupBy("cell_id", "ix", "iy").agg(F.count("*").alias("n"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(max(abs(a), abs(b))).alias("ring")) for a in range(-radius_max, radius_max + 1) for b in range(-radius_max, radius_max + 1)])).alias("o")
    asked = own.select("cell_id", "clat", "clon", "ix", "iy", offsets).select("cell_id", "clat", "clon", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), "o.ring")
    counted = asked.join(own.select("ix", "iy", "n"), ["ix", "iy"])
    within = counted.groupBy("cell_id").agg(*[F.sum(F.when(F.col("ring") <= r, F.col("n"))).alias(f"n{r}") for r in range(radius, radius_max + 1)])
    chosen = F.coalesce(*[F.when(F.col(f"n{r}") >= n_min, r) for r in range(radius, radius_max + 1)], F.lit(-1 if nearest else radius_max))
    radii = within.select("cell_id", chosen.alias("radius"))
    d = geo.haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))
    wells = cells.select("well_id", "ix", "iy", "lat", "lon")
    found = counted.join(radii, "cell_id").filter("ring <= radius").join(wells, ["ix", "iy"]).select("cell_id", "well_id", "lat", "lon", d.alias("dist_km"), "radius")
    if nearest:
        alone = radii.filter("radius = -1").join(own, "cell_id").select(F.monotonically_increasing_id().alias("id"), "cell_id", F.col("clat").alias("lat"), F.col("clon").alias("lon"))
        near = spatial.within(alone.select(F.col("cell_id").alias("id"), "lat", "lon"), wells.select(F.col("well_id").alias("id"), "lat", "lon"), nearest_km)
        rank = F.row_number().over(Window.partitionBy("src").orderBy("dist_km", "dst"))
        few = near.withColumn("rank", rank).filter(F.col("rank") <= nearest).select(F.col("src").alias("cell_id"), F.col("dst").alias("well_id"), "dist_km")
        found = found.union(few.join(wells, "well_id").select("cell_id", "well_id", "lat", "lon", "dist_km", F.lit(-1).alias("radius")))
    place = F.row_number().over(Window.partitionBy("cell_id").orderBy("dist_km", "well_id"))
    return found.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")


def local_type_wells(members: DataFrame, features: DataFrame, least: int = 5, **settings) -> DataFrame:
    """One row a cell: its type well, template and what is usual there. ``members`` from ``kernel_members``, ``features`` from ``template_features``."""
    kernel = members.groupBy("cell_id").agg(F.count("*").alias("n_kernel"))
    rows = members.select("cell_id", "well_id").join(features.withColumn("passes", template_gate()), "well_id")
    schema = "cell_id string, well_id long, n_read long, n_used long, template array<double>, thickness_median double, ntg_median double, iqr_median double"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("well_id", ignore_index=True)
        f, x = pdf[list(typewell.FEATURES)].to_numpy(float), np.stack(pdf.x.to_numpy()).astype(float)
        at, use = typewell.local(f, x, pdf.passes.to_numpy(bool), least=least, **settings)
        med = np.median(f[use], axis=0)
        return pd.DataFrame([(pdf.cell_id.iloc[0], pdf.well_id.iloc[at], len(pdf), len(use), x[at], med[0], med[1], med[2])], columns=[c.split()[0] for c in schema.split(", ")])

    return kernel.join(rows.groupBy("cell_id").applyInPandas(pick, schema), "cell_id", "left").withColumn("error", F.when(F.col("well_id").isNull(), "no_readable_gr"))


def grid_type_wells(members: DataFrame, quality: DataFrame, n_min: int = 12, sigma_km: float | None = 20.0, **settings) -> DataFrame:
    """One row a cell: status, its type well and the counts on the way. ``members`` from ``kernel_members``, ``quality`` from ``curve_quality``."""
    kernel = members.groupBy("cell_id").agg(F.count("*").alias("n_candidates"), F.first("radius").alias("radius"))
    good = members.select("cell_id", "well_id", "dist_km").join(quality.filter(hard_gate()), "well_id")
    schema = "cell_id string, well_id long, n_pass long, n_kept long"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist_km", "well_id"], ignore_index=True)
        f, x = pdf[list(typewell.GRID_FEATURES)].to_numpy(float), np.stack(pdf["shape"].to_numpy()).astype(float)
        got = typewell.on_grid(f, x, pdf.dist_km.to_numpy(float), n_min, sigma_km=sigma_km, **settings)
        row = (pdf.cell_id.iloc[0], None, len(pdf), None) if got is None else (pdf.cell_id.iloc[0], pdf.well_id.iloc[got[0]], len(pdf), len(got[1]))
        return pd.DataFrame([row], columns=["cell_id", "well_id", "n_pass", "n_kept"]).astype({"well_id": "Int64", "n_kept": "Int64"})

    out = kernel.join(good.groupBy("cell_id").applyInPandas(pick, schema), "cell_id", "left")
    out = out.withColumn("n_pass", F.coalesce("n_pass", F.lit(0).cast("long"))).withColumn("status", F.when(F.col("well_id").isNull(), "FAIL").otherwise("OK"))
    return out.withColumn("reason", F.when(F.col("status") == "FAIL", "too_few_candidates_postqc"))


PLACED = "rep_id long, cell_id string, status string, thickness double, expected double, short boolean, placed_top double, placed_base double, missing_top boolean, missing_base boolean, condensed boolean, j_start int, j_end int, s_start double, s_end double, span double, warp double, cps double"


def placed(reps: DataFrame, templates: DataFrame, short: float = 0.65, lengths: tuple[int, int] = (48, 256), alpha: float = 0.15) -> DataFrame:
    """Where each of ``reps(rep_id, cell_id, depths, values)`` lies in its cell's template (``local_type_wells``).

    A curve of usual thickness is the whole interval. A thinner one is looked for inside the template with as many samples as its
    share of the usual thickness asks for: it misses the top or the base, or is condensed if it matches nearly all of the template.
    """
    rows = reps.select("rep_id", "cell_id", "depths", "values").join(templates.select("cell_id", "template", "thickness_median"), "cell_id", "left")

    def one(rep, cell, depths, values, template, expected) -> tuple:
        none = (None,) * (len(PLACED.split(", ")) - 3)
        if depths is None:
            return rep, cell, "read_fail", *none
        number = lambda v: np.array([np.nan if x is None else x for x in v], float)
        d, v = number(depths), number(values)
        try:
            whole = traces.resampled(d, v, max(8, lengths[1]))
        except traces.TraceError:
            return rep, cell, "read_fail", *none
        if template is None:
            return rep, cell, "missing_template", *none
        m, thick = len(template), whole.base - whole.top
        usual = expected if expected is not None and np.isfinite(expected) and expected > 0 else thick
        if thick >= short * usual:
            return rep, cell, "ok", thick, usual, False, whole.top, whole.base, False, False, False, 0, m - 1, 0.0, 1.0, None, None, None
        n = int(np.clip(round(np.clip(thick / usual, 0.05, 1.0) * m), *lengths))
        _, cps, _, first, last = align.subsequence_dtw(traces.resampled(d, v, n).x, np.array(template, float), alpha)
        s0, s1, warp = first / max(1, m - 1), last / max(1, m - 1), (last - first + 1) / max(1, n)
        condensed = s1 - s0 >= 0.85 and warp >= 1.25
        no_top, no_base = not condensed and s0 > 0.10, not condensed and s1 < 0.90
        return rep, cell, "ok", thick, usual, True, whole.top - (s0 * usual if no_top else 0), whole.base + ((1 - s1) * usual if no_base else 0), no_top, no_base, condensed, first, last, s0, s1, s1 - s0, warp, cps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
        fields = [f.split() for f in PLACED.split(", ")]
        for batch in batches:
            cols = list(zip(*[one(*r.values()) for r in batch.to_pylist()], strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array([None if x is None else t(x) for x in c], kind[k]) for c, (_, k), t in zip(cols, fields, [{"long": int, "string": str, "double": float, "boolean": bool, "int": int}[k] for _, k in fields], strict=True)], [n for n, _ in fields])

    return rows.select("rep_id", "cell_id", "depths", "values", "template", F.col("thickness_median").alias("expected")).mapInArrow(run, PLACED)


def farthest_candidates(members: DataFrame, cap: int) -> DataFrame:
    """Of each cell's members up to ``cap`` by farthest-point sampling, for kernels that are not to be cut by distance."""
    kinds = dict(members.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("well_id", ignore_index=True)
        return pdf if len(pdf) <= cap else pdf.iloc[np.sort(greedy.farthest_points(pdf.lat.to_numpy(), pdf.lon.to_numpy(), cap))]

    return members.groupBy("cell_id").applyInPandas(pick, ", ".join(f"`{c}` {kinds[c]}" for c in members.columns))
