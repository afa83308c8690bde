"""Alignment of edges over the depths that both ends have.

An edge's window is where the depth ranges of its ends overlap, padded by its length. Both curves are cut out of
the ends' stored vectors there, scaled anew and aligned from end to end; every way to fail is a status.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..kernels import align, traces
from .kernels import lists_of, series_of


@dataclass(frozen=True)
class Windowing:
    n: int = 512
    low: float = 1.0
    high: float = 99.0
    alpha: float = 0.15
    base_pad: float = 10.0
    pad_per_km: float = 0.0
    most_pad: float = 200.0
    min_overlap: float = 50.0
    guard_share: float = 0.1
    guard_least: int = 16
    slopes: tuple[float, float] = (0.5, 2.0)
    #: Take ends without a vector as ``cache_miss`` instead of reading their samples.
    stored_only: bool = False


def vectors(samples: DataFrame, n: int = 1024, low: float = 1.0, high: float = 99.0, min_finite: int = 10) -> DataFrame:
    """(well_id, x, top, base, n_finite, step, status) of ``samples(well_id, row, depth, value)``, rows in their file's order."""
    schema = "well_id long, x array<double>, top double, base double, n_finite long, step double, status string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        try:
            t = traces.resampled(pdf.depth, pdf.value, n, low, high, min_finite)
            row = (pdf.well_id.iloc[0], t.x, t.top, t.base, t.n_finite, t.step, "OK")
        except traces.TraceError as e:
            row = (pdf.well_id.iloc[0], None, None, None, int(np.isfinite(pdf.value.to_numpy(float)).sum()), None, f"FAIL: {e}")
        return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

    return samples.select("well_id", "row", "depth", "value").groupBy("well_id").applyInPandas(run, schema)


def planned(edges: DataFrame, nodes: DataFrame, s: Windowing) -> DataFrame:
    """``edges(src, dst, dist_km)`` with pad, overlap, window and the status that can be told from the ranges of ``nodes(well_id, depth_min, depth_max)``."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c))
    out = edges.select("src", "dst", F.coalesce(F.nanvl("dist_km", F.lit(0.0)), F.lit(0.0)).alias("dist_km"))
    for end in ("src", "dst"):
        out = out.join(nodes.select(F.col("well_id").alias(end), finite("depth_min").alias(f"lo_{end}"), finite("depth_max").alias(f"hi_{end}"), F.lit(True).alias(f"is_{end}")), end, "left")
    out = out.withColumn("lo", F.greatest("lo_src", "lo_dst")).withColumn("hi", F.least("hi_src", "hi_dst"))
    known = F.col("lo_src").isNotNull() & F.col("hi_src").isNotNull() & F.col("lo_dst").isNotNull() & F.col("hi_dst").isNotNull()
    overlap = F.when(known, F.greatest(F.lit(0.0), F.col("hi") - F.col("lo")))
    shorter = F.least(F.col("hi_src") - F.col("lo_src"), F.col("hi_dst") - F.col("lo_dst"))
    out = out.withColumn("pad", F.when(known, scoring.clamped_pad(F.col("dist_km"), s.base_pad, s.pad_per_km, s.most_pad))).withColumn("overlap", overlap)
    out = out.withColumn("overlap_frac", F.when(known, F.when(shorter > 0, overlap / shorter).otherwise(0.0)))
    status = F.when(F.col("is_src").isNull() | F.col("is_dst").isNull(), "missing_node").when(~known, "no_depth").when(F.col("overlap") <= 0, "no_overlap").when(F.col("overlap") < s.min_overlap, "overlap_too_small")
    return out.withColumn("status", status).select("src", "dst", "dist_km", "pad", "overlap", "overlap_frac", (F.col("lo") - F.col("pad")).alias("win_lo"), (F.col("hi") + F.col("pad")).alias("win_hi"), "status")


def aligned(edges: DataFrame, nodes: DataFrame, stored: DataFrame, s: Windowing = Windowing(), samples: DataFrame | None = None) -> DataFrame:
    """All edges with status, cost, cost per step (over the whole path) and, for ``ok`` and ``end_mismatch``, the path.

    ``stored(well_id, x, top, base)``: the vectors. An end without one is read anew from ``samples(well_id, row, depth, value)``
    within the edge's window, unless only stored ones are wanted.
    """
    plan = planned(edges, nodes, s)
    for end in ("src", "dst"):
        plan = plan.join(stored.filter("x is not null").select(F.col("well_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("x", "top", "base")]), end, "left")
    if samples is None:
        plan = plan.withColumn("raw_src", F.lit(None).cast("array<struct<row:bigint,depth:double,value:double>>")).withColumn("raw_dst", F.col("raw_src"))
    else:  # only those ends are read whose vector is missing
        wanted = [plan.filter("status is null and (x_src is null or x_dst is null)").select(F.col(end).alias("well_id")) for end in ("src", "dst")]
        raw = samples.join(wanted[0].union(wanted[1]).distinct(), "well_id", "left_semi").groupBy("well_id").agg(F.array_sort(F.collect_list(F.struct(F.col("row").cast("long").alias("row"), F.col("depth").cast("double").alias("depth"), F.col("value").cast("double").alias("value")))).alias("raw"))
        for end in ("src", "dst"):
            plan = plan.join(raw.select(F.col("well_id").alias(end), F.col("raw").alias(f"raw_{end}")), end, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            number = {c: pc.fill_null(column(c), np.nan).to_numpy(zero_copy_only=False) for c in ("win_lo", "win_hi", "top_src", "top_dst", "base_src", "base_dst")}
            stored = {end: series_of(column(f"x_{end}")) for end in ("src", "dst")}
            status = column("status").to_pylist()
            found: list = [(None, None, None, None)] * batch.num_rows

            def curve(k: int, end: str) -> np.ndarray:
                lo, hi = number["win_lo"][k], number["win_hi"][k]  # noqa: B023
                if stored["src"][k] is not None and stored["dst"][k] is not None:  # noqa: B023
                    return traces.windowed(stored[end][k], number[f"top_{end}"][k], number[f"base_{end}"][k], lo, hi, s.n, s.low, s.high)  # noqa: B023
                raw = column(f"raw_{end}")[k]  # noqa: B023
                if not raw.is_valid:
                    raise traces.TraceError("nothing to read")
                d, v = (pc.fill_null(raw.values.field(c), np.nan).to_numpy(zero_copy_only=False) for c in ("depth", "value"))
                return traces.resampled(d, v, s.n, s.low, s.high, window=(lo, hi)).x

            at, xs, ys = [], [], []
            for k in [k for k, told in enumerate(status) if told is None]:
                if s.stored_only and (stored["src"][k] is None or stored["dst"][k] is None):
                    status[k] = "cache_miss"
                    continue
                try:
                    x, y = curve(k, "src"), curve(k, "dst")
                except ValueError:
                    status[k] = "read_fail"
                    continue
                at.append(k)
                xs.append(x)
                ys.append(y)
            for some, x, y in align.by_shape(xs, ys):
                for k, (cost, path) in zip(some.tolist(), align.dtw_many(x, y, s.alpha), strict=True):
                    ok = np.isfinite(cost) and align.end_slopes_ok(path, s.guard_share, s.guard_least, *s.slopes, n=s.n)
                    status[at[k]] = "ok" if ok else "end_mismatch" if np.isfinite(cost) else "dtw_fail"
                    if np.isfinite(cost):
                        found[at[k]] = cost, cost / len(path), path[:, 0], path[:, 1]
            cost, cps, ii, jj = zip(*found, strict=True) if found else ((),) * 4
            kept = [column(c) for c in ("src", "dst", "dist_km", "pad", "overlap", "overlap_frac")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(status, pa.string()), pa.array(cost, pa.float64()), pa.array(cps, pa.float64()), lists_of(ii), lists_of(jj)], ["src", "dst", "dist_km", "pad", "overlap", "overlap_frac", "status", "cost", "cps", "ii", "jj"])

    columns = ["src", "dst", "dist_km", "pad", "overlap", "overlap_frac", "win_lo", "win_hi", "status", *[f"{c}_{e}" for c in ("x", "top", "base", "raw") for e in ("src", "dst")]]
    return plan.select(*columns).mapInArrow(run, "src long, dst long, dist_km double, pad double, overlap double, overlap_frac double, status string, cost double, cps double, ii array<int>, jj array<int>")


def diagnostics(edges: DataFrame) -> DataFrame:
    """How many edges came to each status."""
    return edges.groupBy("status").agg(F.count("*").alias("n"))


def as_text(edges: DataFrame) -> DataFrame:
    """The edges as their text sink has them: distances with three decimals, costs with six digits, '' for none."""
    text = lambda c, f: F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c))).otherwise("").alias(c)
    return edges.select("src", "dst", text("dist_km", "%.3f"), "status", text("cost", "%.6g"), text("cps", "%.6g"))
