"""Relative geologic time: equations from alignment paths, the diagram of wells in it, tops and their depths.

Tables are long: ``samples(well_id, k, depth, value, shift)`` with a shift for each sample, and the diagram one row for
each well and place on the common grid. What a group (a cell, or one column of nothing for the whole framework) gathers
is its grid of places, whose size is a setting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import solve, tops, traces
from ..scratch import cut
from . import graph

#: Equations of a system that one task solves; larger systems are solved by joins.
SMALL_SYSTEM = 1_000_000


def equations(paths: DataFrame, arrays: DataFrame, precise: bool = False) -> DataFrame:
    """(src, i, dst, j, dz): shift of (src, i) less shift of (dst, j) is dz, for each place on ``paths(src, dst, ii, jj)``.

    ``arrays(well_id, depths)``. Unless ``precise``, a place of src has one equation, with the median (rounded down) of
    its partners' places, and the unknown on the other side is that of its own place.
    """
    points = paths.select("src", "dst", F.explode(F.arrays_zip("ii", "jj")).alias("p")).select("src", "dst", F.col("p.ii").alias("i"), F.col("p.jj").alias("at"))
    if not precise:
        points = points.groupBy("src", "dst", "i").agg(F.floor(F.median("at")).cast("int").alias("at"))
    a, b = (arrays.select(F.col("well_id").alias(end), F.col("depths").alias(f"z_{end}")) for end in ("src", "dst"))
    met = points.join(a, "src").join(b, "dst").filter((F.col("i") >= 0) & (F.col("at") >= 0) & (F.col("i") < F.size("z_src")) & (F.col("at") < F.size("z_dst")))
    dz = F.element_at("z_dst", F.col("at") + 1) - F.element_at("z_src", F.col("i") + 1)
    return met.select("src", F.col("i").cast("int").alias("i"), "dst", (F.col("at") if precise else F.col("i")).cast("int").alias("j"), dz.alias("dz")).filter("dz is not null")


def solved(rows: DataFrame, anchors: DataFrame | None = None, damping: float = 0.01, pull: float = 0.0, tol: float = 1e-6, most: int = 500, small: int = SMALL_SYSTEM) -> DataFrame:
    """(well_id, k, shift): the damped least-squares solution of ``equations``, every sample an unknown.

    ``anchors(well_id, k, target, weight)`` pull samples to targets. Systems that do not touch are solved apart. Where each
    equation is between samples of one place, as ``equations`` makes them unless ``precise``, the samples of each place are
    a system of their own: a component of wells falls into as many as it has places, and a task has equations of one. Else
    a component is one system. A system of more than ``small`` equations is solved by conjugate gradients on tables.
    """
    spark = rows.sparkSession
    rows = cut(rows, "equations")
    if anchors is None:
        anchors = spark.createDataFrame([], "well_id long, k int, target double, weight double")
    label = graph.components(rows.select("src", "dst").distinct()).withColumnRenamed("id", "src")
    by_place = rows.filter("i <> j").isEmpty()
    place = lambda c: (F.col(c) if by_place else F.lit(0)).cast("int").alias("system")
    key = ["component", "system"]
    labelled = cut(rows.join(label, "src").withColumn("system", place("i")), "labelled")
    sizes = cut(labelled.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    few, many = sizes.filter(F.col("n") <= small).select(*key), sizes.filter(F.col("n") > small).select(*key)
    own = anchors.join(label.withColumnRenamed("src", "well_id"), "well_id").withColumn("system", place("k"))

    def at_once(key: tuple, e: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values(["src", "i", "dst", "j", "dz"], ignore_index=True)
        low = min(e.i.min(), e.j.min(), a.k.min() if len(a) else 0)
        wide = int(max(e.i.max(), e.j.max(), a.k.max() if len(a) else 0)) - int(low) + 1
        wells, at_well = np.unique(np.r_[e.src, e.dst, a.well_id], return_inverse=True)
        code = at_well * wide + np.r_[e.i, e.j, a.k] - low  # one number for a sample
        known, at = np.unique(code[: 2 * len(e)], return_inverse=True)
        held = code[2 * len(e) :]
        place = np.searchsorted(known, held).clip(0, len(known) - 1)
        good = known[place] == held
        diag, rhs = np.zeros(len(known)), np.zeros(len(known))
        np.add.at(diag, place[good], a.weight.to_numpy()[good] ** 2)
        np.add.at(rhs, place[good], (a.weight**2 * a.target).to_numpy()[good])
        s = solve.pulled_shifts(len(known), at[: len(e)], at[len(e) :], e.dz.to_numpy(float), diag * pull, rhs * pull, damping, tol, most)
        return pd.DataFrame({"well_id": wells[known // wide], "k": (known % wide + low).astype(np.int32), "shift": s})

    schema = "well_id long, k int, shift double"
    grouped = labelled.join(few, key).groupBy(*key).cogroup(own.join(few, key).groupBy(*key))
    out = grouped.applyInPandas(at_once, schema)
    if many.isEmpty():
        return out
    node = lambda w, k: F.struct(F.col(w).cast("long").alias("well_id"), F.col(k).cast("int").alias("k"))
    big = labelled.join(many, key).select(node("src", "i").alias("u"), node("dst", "j").alias("v"), "dz")
    held = own.join(many, key).groupBy(node("well_id", "k").alias("id")).agg(F.sum(F.pow("weight", F.lit(2)) * pull).alias("diag"), F.sum(F.pow("weight", F.lit(2)) * F.col("target") * pull).alias("rhs"))
    found = conjugate_gradients(big, held, damping, tol, most)
    return out.union(found.select("id.well_id", "id.k", F.col("x").alias("shift")))


def conjugate_gradients(rows: DataFrame, held: DataFrame, damping: float, tol: float = 1e-6, most: int = 500) -> DataFrame:
    """(id, x): x[u] - x[v] = dz for ``rows(u, v, dz[, w])`` in the (weighted) damped least-squares sense, with ``held(id, diag, rhs)`` added.

    Directions are scaled by the diagonal of the normal equations, the sum of a node's weights, so nodes of many and of few
    equations come to rest together. A step is two grouped sums over the rows and two numbers on the driver; the vectors are
    tables, written before they are used again.
    """
    rows = cut(rows.select("u", "v", "dz", F.col("w") if "w" in rows.columns else F.lit(1.0).alias("w")), "rows")
    sides = lambda r, c: r.select(F.col("u").alias("id"), F.col(c).alias("g")).union(r.select(F.col("v").alias("id"), (-F.col(c)).alias("g")))
    both = rows.select(F.explode(F.array(F.struct(F.col("u").alias("id"), (F.col("w") * F.col("dz")).alias("g"), "w"), F.struct(F.col("v").alias("id"), (-F.col("w") * F.col("dz")).alias("g"), "w"))).alias("e"))
    b = both.groupBy("e.id").agg(F.sum("e.g").alias("g"), F.sum("e.w").alias("weight")).join(held, "id", "left")
    diag = F.coalesce("diag", F.lit(0.0))
    state = b.select("id", diag.alias("diag"), (F.col("weight") + diag + damping).alias("scale"), F.lit(0.0).alias("x"), (F.col("g") + F.coalesce("rhs", F.lit(0.0))).alias("r"))
    state = cut(state.withColumn("p", F.col("r") / F.col("scale")), "state")
    norms = [F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("r") / F.col("scale"))]
    rr, rz = (v or 0.0 for v in state.agg(*norms).first())
    goal = tol * tol * rr
    for _ in range(most):
        if rr <= goal or rr == 0.0:
            return state.select("id", "x")
        ends = [state.select(F.col("id").alias(c), F.col("p").alias(f"p_{c}")) for c in ("u", "v")]
        d = rows.join(ends[0], "u").join(ends[1], "v").select("u", "v", (F.col("w") * (F.col("p_u") - F.col("p_v"))).alias("d"))
        ap = sides(d, "d").groupBy("id").agg(F.sum("g").alias("g"))
        step = cut(state.join(ap, "id").withColumn("ap", F.col("g") + (F.col("diag") + damping) * F.col("p")).drop("g"), "step")
        a = rz / step.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        moved = cut(step.select("id", "diag", "scale", (F.col("x") + a * F.col("p")).alias("x"), (F.col("r") - a * F.col("ap")).alias("r"), "p"), "moved")
        old, (rr, rz) = rz, moved.agg(*norms).first()
        state = moved.withColumn("p", F.col("r") / F.col("scale") + (rz / old) * F.col("p"))
    if rr <= goal:
        return state.select("id", "x")
    raise ArithmeticError(f"no convergence in {most} steps")


def diagram(samples: DataFrame, by: list[str], n: int = 400, pad: float = 0.0, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """The wells of each group on its common grid of relative time, and what became of each well.

    ``samples(*by, well_id, k, depth, value, shift)``. Time is depth plus shift, made monotone by the running maximum; of samples at
    one time the last counts. Returns rows ``(*by, well_id, place, rgt, value, depth)`` where the grid lies inside a well's time, and
    ``(*by, well_id, reversal_frac, status)`` with ``used``, ``missing_shift`` or ``too_few_finite_samples``.
    """
    own = Window.partitionBy(*by, "well_id")
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    s = samples.withColumn("rgt", F.when(good("depth") & good("shift"), F.col("depth") + F.col("shift")))
    s = s.withColumn("fin", F.col("rgt").isNotNull() & good("value"))
    s = s.withColumn("mono", F.when(F.col("rgt").isNotNull(), F.max("rgt").over(own.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))))
    back = F.avg(F.when(F.col("rgt").isNotNull(), (F.col("mono") > F.col("rgt") + 1e-10 + 1e-8 * F.abs("rgt")).cast("double")))
    status = F.when(F.count_if(good("shift")) == 0, "missing_shift").when(F.count_if("fin") < least, "too_few_finite_samples").otherwise("used")
    wells = s.groupBy(*by, "well_id").agg(F.coalesce(back, F.lit(0.0)).alias("reversal_frac"), status.alias("status"))
    s = s.join(wells.filter("status = 'used'").select(*by, "well_id"), [*by, "well_id"])
    bounds = s.groupBy(*by).agg(F.min("mono").alias("lo"), F.max("mono").alias("hi")).filter("hi > lo")
    bounds = bounds.select(*by, (F.col("lo") - pad * (F.col("hi") - F.col("lo"))).alias("lo"), (F.col("hi") + pad * (F.col("hi") - F.col("lo"))).alias("hi"))
    n = max(50, n)
    last = s.filter("fin").groupBy(*by, "well_id", "mono").agg(F.max_by(F.struct("value", "depth"), "k").alias("s"))
    along = own.orderBy("mono")
    seg = last.select(*by, "well_id", "mono", "s.value", "s.depth", *[F.lead(c).over(along).alias(f"{name}2") for c, name in (("mono", "mono"), ("s.value", "value"), ("s.depth", "depth"))])
    seg = seg.withColumn("points", F.count("*").over(own)).filter("points >= 2")
    seg = seg.join(bounds, by) if by else seg.crossJoin(F.broadcast(bounds))  # one row
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    first = F.ceil((F.col("mono") - F.col("lo")) / step - 1e-9)
    after = F.coalesce(F.ceil((F.col("mono2") - F.col("lo")) / step - 1e-9), F.floor((F.col("mono") - F.col("lo")) / step + 1e-9) + 1)
    places = F.when(after > first, F.sequence(first, after - 1)).otherwise(F.array().cast("array<bigint>"))
    seg = seg.withColumn("step", step).withColumn("place", F.explode(places)).withColumn("rgt", F.col("lo") + F.col("place") * F.col("step"))
    t = (F.col("rgt") - F.col("mono")) / (F.col("mono2") - F.col("mono"))
    mix = lambda c: F.when(F.col("mono2").isNull(), F.col(c)).otherwise(F.col(c) + t * (F.col(f"{c}2") - F.col(c)))
    return seg.select(*by, "well_id", F.col("place").cast("int").alias("place"), "rgt", mix("value").alias("value"), mix("depth").alias("depth")), wells


def type_log(rows: DataFrame, by: list[str]) -> DataFrame:
    """The mean over the wells of a diagram at each place."""
    return rows.groupBy(*by, "place").agg(F.min("rgt").alias("rgt"), F.avg("value").alias("value"), F.count("*").alias("n_wells"))


def multiscale_tops(log: DataFrame, by: list[str], widths: tuple[int, ...] = tops.WIDTHS, window: int = 25, ends: bool = True) -> DataFrame:
    """(*by, level, width, top, place): tops of each group's type log at every scale; places that no well covers count as the mean."""
    kinds = dict(log.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "level int, width int, top int, place int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        y = np.full(int(pdf.place.max()) + 1, np.nan)
        y[pdf.place] = pdf.value
        y = np.where(np.isfinite(y), y, np.nanmean(y))
        rows = [(level, widths[level], k, int(p)) for level, at in enumerate(tops.by_level(y, widths, window, ends)) for k, p in enumerate(at)]
        out = pd.DataFrame(rows, columns=["level", "width", "top", "place"]).astype("int32")
        for i, c in enumerate(by):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    return log.select(*by, "place", "value").groupBy(*by).applyInPandas(run, schema)


def tops_table(rows: DataFrame, found: DataFrame, log: DataFrame, level: int, prefix: str = "TOP") -> DataFrame:
    """One row for each well of a diagram: depth ('' where the well does not reach) and time of each top of a level, three decimals.

    The tops of one level are few (places on one grid), so their names are columns.
    """
    mine = found.filter(F.col("level") == level).select("top", "place").join(log.select("place", "rgt"), "place", "left")
    named = sorted((r["top"], r["place"], r["rgt"]) for r in mine.collect())
    met = rows.join(F.broadcast(mine.select("top", "place")), "place")
    wide = rows.select("well_id").distinct().join(met.groupBy("well_id").pivot("top", [t for t, *_ in named]).agg(F.first("depth")), "well_id", "left")
    columns = []
    for t, _, rgt in named:
        depth = F.col(f"`{t}`")
        columns += [F.when(depth.isNotNull(), F.format_string("%.3f", depth)).otherwise("").alias(f"{prefix}{t:03d}_DEPTH"), F.lit("" if rgt is None else f"{rgt:.3f}").alias(f"{prefix}{t:03d}_RGT")]
    return wide.select("well_id", *columns)


def cell_scalar(stats: DataFrame, log: DataFrame, stat: str, level: int | None = None) -> DataFrame:
    """(cell_id, value): the mean of a statistic over a cell's intervals of a level; for cells without, of its type log."""
    rows = stats if level is None or "level" not in stats.columns else stats.filter(F.col("level") == level)
    mean = rows.groupBy("cell_id").agg(F.avg(F.nanvl(F.col(stat).cast("double"), F.lit(None).cast("double"))).alias("a"))
    of_log = log.groupBy("cell_id").agg(F.avg("value").alias("b"))
    return of_log.join(mean, "cell_id", "full").select("cell_id", F.coalesce("a", "b").alias("value"))


def fence(stations: DataFrame, arrays: DataFrame, paths: DataFrame, grid: tuple[float, float, int], columns: int = 0) -> DataFrame:
    """The section along ``stations(station, well_id)``: each track, and the warped picture of the gap after it, on a common depth grid.

    ``arrays(well_id, depths, values, shift)`` (shift an array or null), ``paths(src, dst, ii, jj)`` in either orientation. Returns
    ``(station, well_id, track, gap)``: arrays over the grid from top to base, the gap row by row with ``columns`` places, null without a path.
    """
    order = Window.orderBy("station")  # a fence is a few dozen stations
    s = stations.select("station", "well_id", F.lead("well_id").over(order).alias("next"))
    both = paths.select("src", "dst", "ii", "jj").union(paths.select(F.col("dst"), F.col("src"), F.col("jj"), F.col("ii")))
    both = both.dropDuplicates(["src", "dst"]).toDF("well_id", "next", "ii", "jj")
    b = arrays.select(*[F.col(c).alias(f"{c}_b") for c in arrays.columns])
    rows = s.join(arrays, "well_id").join(b, F.col("next") == F.col("well_id_b"), "left").join(both, ["well_id", "next"], "left")
    y = np.linspace(*grid)

    def series(v) -> np.ndarray:
        return np.array([np.nan if x is None else x for x in v], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                z, x = series(r["depths"]), series(r["values"])
                track = np.interp(y, *_pair(z + traces.shift_resized(r["shift"], len(z)), x), left=np.nan, right=np.nan)
                gap = None
                if columns and r["ii"] is not None and r["depths_b"] is not None:
                    zb, xb = series(r["depths_b"]), series(r["values_b"])
                    right = np.interp(y, *_pair(zb + traces.shift_resized(r["shift_b"], len(zb)), xb), left=np.nan, right=np.nan)
                    ties = traces.knots(np.c_[r["ii"], r["jj"]], z, zb, r["shift"], r["shift_b"])
                    gap = None if ties is None else traces.warped_between(track, right, y, ties, columns).ravel()
                out.append((r["station"], r["well_id"], track, gap))
            cols = list(zip(*out, strict=True)) or [()] * 4
            number = lambda v: None if v is None else [None if np.isnan(q) else float(q) for q in v]
            arrays_of = [pa.array([number(v) for v in c], pa.list_(pa.float64())) for c in cols[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *arrays_of], ["station", "well_id", "track", "gap"])

    keep = ["station", "well_id", "depths", "values", "shift", "depths_b", "values_b", "shift_b", "ii", "jj"]
    return rows.withColumn("station", F.col("station").cast("long")).select(*keep).mapInArrow(run, "station long, well_id long, track array<double>, gap array<double>")


def _pair(z: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z, x = traces.rising(z, x)
    return (z, x) if len(z) >= 2 else (np.array([0.0]), np.array([np.nan]))
