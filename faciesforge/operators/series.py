"""Depth series in long form: one row a sample, ``(well_id, depth, value)``.

A missing sample is NULL (NaN becomes NULL at the sources). Every operator works within a
well by window or grouped aggregate, so a well's samples meet in one task and nothing wider
does; operators that chain share the exchange on ``well_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_depth() -> WindowSpec:
    return Window.partitionBy("well_id").orderBy("depth")


def up_to_each(down: bool = False) -> WindowSpec:
    """A sample and all above it, or all below it (``down``); of samples at one depth the missing ones are furthest.

    What lies below is a running frame of the order turned round: a frame that ends with the well is gone through anew for each
    sample, the square of a well's samples.
    """
    depth = F.desc("depth") if down else F.asc("depth")
    return Window.partitionBy("well_id").orderBy(depth, F.isnull("value")).rowsBetween(Window.unboundedPreceding, 0)


def sanitised(c: Column, null_value: float | None = None) -> Column:
    """NaN, infinities and the file's null marker as NULL."""
    good = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(good if null_value is None else good & (c != null_value), c)


def dedupe_last(series: DataFrame, order: str) -> DataFrame:
    """Of samples at one depth, the one that comes last by ``order``."""
    return series.groupBy("well_id", "depth").agg(F.max_by(F.struct("value"), F.col(order)).alias("s")).select("well_id", "depth", F.col("s.value").alias("value"))


def dedupe_mean(series: DataFrame) -> DataFrame:
    """The mean of the samples at one depth, missing ones left out."""
    return series.groupBy("well_id", "depth").agg(F.avg("value").alias("value"))


def fill_linear(series: DataFrame, min_finite: int = 1) -> DataFrame:
    """Missing samples on the line between their neighbours; at the ends the nearest one is held.

    Wells with fewer than ``min_finite`` samples stay as they are.
    """
    point = F.when(F.col("value").isNotNull(), F.struct("depth", "value"))
    few = [F.count("value").over(Window.partitionBy("well_id")).alias("n")] if min_finite > 1 else []  # a well without samples stays as it is anyhow
    out = series.select("well_id", "depth", "value", F.last(point, True).over(up_to_each()).alias("a"), F.last(point, True).over(up_to_each(down=True)).alias("b"), *few)
    t = (F.col("depth") - F.col("a.depth")) / F.nullif(F.col("b.depth") - F.col("a.depth"), F.lit(0.0))
    line = F.col("a.value") + t * (F.col("b.value") - F.col("a.value"))
    filled = F.coalesce(F.col("value"), line, F.col("a.value"), F.col("b.value"))
    return out.select("well_id", "depth", (F.when(F.col("n") >= min_finite, filled).otherwise(F.col("value")) if few else filled).alias("value"))


def resample(series: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced depths from top to base, ``(well_id, k, depth, value)``, by linear interpolation.

    Each segment between neighbouring samples makes the grid points inside it, so grid and
    samples never have to be joined.
    """
    own = Window.partitionBy("well_id")
    s = series.filter("value is not null").select(
        "well_id", "depth", "value", F.lead("depth").over(by_depth()).alias("d2"), F.lead("value").over(by_depth()).alias("v2"), F.min("depth").over(own).alias("top"), F.max("depth").over(own).alias("base")
    )
    step = (F.col("base") - F.col("top")) / (n - 1)
    last = F.col("d2").isNull()
    first_k = F.ceil((F.col("depth") - F.col("top")) / step - 1e-9)
    next_k = F.when(last, F.lit(n)).otherwise(F.least(F.lit(n - 1), F.ceil((F.col("d2") - F.col("top")) / step - 1e-9)))
    ks = F.when(next_k > first_k, F.sequence(first_k, next_k - 1)).otherwise(F.array().cast("array<bigint>"))
    out = s.filter("base > top").select("well_id", "depth", "value", "d2", "v2", "top", step.alias("step"), F.explode(ks).alias("k"))
    at = F.col("top") + F.col("k") * F.col("step")
    value = F.when(F.col("d2").isNull(), F.col("value")).otherwise(F.col("value") + (at - F.col("depth")) / (F.col("d2") - F.col("depth")) * (F.col("v2") - F.col("value")))
    return out.select("well_id", F.col("k").cast("long").alias("k"), at.alias("depth"), value.alias("value"))


def imputed_mask(series: DataFrame, max_gap: float) -> DataFrame:
    """``imputed``: a missing sample outside the well's samples, or in a gap longer than ``max_gap``."""
    at = F.when(F.col("value").isNotNull(), F.col("depth"))
    a, b = (F.last(at, True).over(up_to_each(down)) for down in (False, True))
    return series.select("well_id", "depth", "value", F.coalesce((b - a) > max_gap, F.lit(True)).alias("imputed"))


def percentile_normalised(series: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values scaled between a well's exact percentiles and clipped to 0..1; 0 where these are equal."""
    own = Window.partitionBy("well_id")
    out = series.select("well_id", "depth", "value", F.percentile("value", low).over(own).alias("lo"), F.percentile("value", high).over(own).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(0.0)
    return out.select("well_id", "depth", F.when(F.col("value").isNotNull(), scaled).alias("value"))


def features(series: DataFrame, cutoff: float) -> DataFrame:
    """One row a well: percentiles, spread, mean, share below the cutoff, thickness, counts."""
    p = lambda q: F.percentile("value", q)
    return series.groupBy("well_id").agg(
        F.count("*").alias("n"),
        F.count("value").alias("n_finite"),
        p(0.05).alias("p05"),
        p(0.5).alias("p50"),
        p(0.95).alias("p95"),
        (p(0.75) - p(0.25)).alias("iqr"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.avg(F.when(F.col("value").isNotNull(), (F.col("value") < cutoff).cast("double"))).alias("ntg"),
        (F.max("depth") - F.min("depth")).alias("thickness"),
    )


def robust_z(rows: DataFrame, column: str, partition: list[str], style: str = "0.6745") -> DataFrame:
    """``z``: distance from the median in units of the median absolute deviation, 0 where that vanishes."""
    if partition:
        own = Window.partitionBy(*partition)
        dev = rows.withColumn("_med", F.median(column).over(own))
        dev = dev.withColumn("_mad", F.median(F.abs(F.col(column) - F.col("_med"))).over(own))
    else:  # two aggregates of one row each
        dev = rows.crossJoin(F.broadcast(rows.agg(F.median(column).alias("_med"))))
        dev = dev.crossJoin(F.broadcast(dev.agg(F.median(F.abs(F.col(column) - F.col("_med"))).alias("_mad"))))
    d = F.col(column) - F.col("_med")
    z = F.lit(0.6745) * d / F.col("_mad") if style == "0.6745" else d / (F.lit(1.4826) * F.col("_mad"))
    return dev.withColumn("z", F.when(F.col("_mad") > 1e-12, z).otherwise(0.0)).drop("_med", "_mad")


def monotone(series: DataFrame) -> DataFrame:
    """``mono``: the running maximum; ``reversed``: whether the sample lies below it."""
    up = F.max("value").over(by_depth().rowsBetween(Window.unboundedPreceding, 0))
    gap = F.abs(up - F.col("value")) > F.lit(1e-10) + F.lit(1e-8) * F.abs(F.col("value"))
    return series.select("well_id", "depth", "value", up.alias("mono"), F.coalesce(gap, F.lit(False)).alias("reversed"))


def zero_crossings(series: DataFrame) -> DataFrame:
    """Samples where the sign changes; zeros carry the sign before them, leading ones the sign after."""
    sign = F.when(F.abs("value") > 1e-12, F.signum("value"))
    before, after = by_depth().rowsBetween(Window.unboundedPreceding, 0), up_to_each(down=True)
    s = series.select("well_id", "depth", "value", F.coalesce(F.last(sign, True).over(before), F.last(sign, True).over(after)).alias("s"))
    return s.withColumn("was", F.lag("s").over(by_depth())).filter("s <> was").select("well_id", "depth", "value")


def snap(coarse: DataFrame, fine: DataFrame, window: int) -> DataFrame:
    """``coarse(well_id, idx)`` to the nearest ``fine(well_id, idx)`` within the window, the first on a tie, else itself.

    Buckets of the window's width turn the range into an equality: a match lies in the same
    bucket or a neighbouring one.
    """
    bucket = F.floor(F.col("idx") / window)
    near = fine.select("well_id", F.col("idx").alias("fine"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    met = coarse.withColumn("bucket", bucket).join(near, ["well_id", "bucket"], "left")
    d = F.abs(F.col("fine") - F.col("idx"))
    best = F.min(F.when(d <= window, F.struct(d.alias("d"), F.col("fine").alias("fine"))))
    return met.groupBy("well_id", "idx").agg(best.alias("best")).select("well_id", "idx", F.coalesce("best.fine", "idx").alias("snapped"))


def ricker(series: DataFrame, width: int) -> DataFrame:
    """Same-mode convolution of ``series(well_id, k, value)`` with an L1-normalised Ricker wavelet.

    Each sample is spread to the positions that it reaches, a bounded fan-out, and the
    positions are summed; samples beyond the ends count as zero.
    """
    import math

    half = max(2, 5 * width)
    taps = [(1 - (i / width) ** 2) * math.exp(-(i**2) / (2 * width**2)) for i in range(-half, half + 1)]
    total = sum(map(abs, taps))
    kernel = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t / total).alias("t")) for i, t in zip(range(-half, half + 1), taps, strict=True)])
    spread = series.select("well_id", "k", "value", F.max("k").over(Window.partitionBy("well_id")).alias("last"), F.explode(kernel).alias("w"))
    at = F.col("k") + F.col("w.i")
    return spread.withColumn("at", at).filter("at between 0 and last").groupBy("well_id", F.col("at").alias("k")).agg(F.sum(F.col("value") * F.col("w.t")).alias("response"))


def interval_stats(samples: DataFrame, tops: DataFrame, cutoff: float, min_finite: int = 20) -> DataFrame:
    """Statistics of ``samples(well_id, k, value)`` between consecutive ``tops(well_id, idx)``, both ends included."""
    order = Window.partitionBy("well_id").orderBy("idx")
    spans = tops.select("well_id", F.col("idx").alias("i0"), F.lead("idx").over(order).alias("i1"), (F.row_number().over(order) - 1).alias("interval")).filter("i1 is not null")
    per_well = spans.groupBy("well_id").agg(F.collect_list(F.struct("interval", "i0", "i1")).alias("spans"))  # a well's tops are few
    hit = samples.join(per_well, "well_id").select("well_id", "k", "value", F.explode(F.filter("spans", lambda s: (s["i0"] <= F.col("k")) & (F.col("k") <= s["i1"]))).alias("s"))
    p = lambda q: F.percentile("value", q)
    enough = lambda c: F.when(F.count("value") >= min_finite, c)
    return hit.groupBy("well_id", F.col("s.interval").cast("long").alias("interval")).agg(
        F.count("value").alias("n_finite"),
        enough(F.avg("value")).alias("mean"),
        enough(F.stddev_pop("value")).alias("std"),
        enough(p(0.75) - p(0.25)).alias("iqr"),
        enough(p(0.95) - p(0.05)).alias("range90"),
        enough(F.avg((F.col("value") < cutoff).cast("double"))).alias("ntg"),
    )


def tops_pivot(tops: DataFrame, names: list[str]) -> DataFrame:
    """One row a well, a depth column for each named top (three decimals, '' where there is none)."""
    wide = tops.groupBy("well_id").pivot("top_name", names).agg(F.min("depth"))
    return wide.select("well_id", *[F.when(F.col(f"`{n}`").isNotNull(), F.format_string("%.3f", F.col(f"`{n}`"))).otherwise("").alias(f"{n}_DEPTH") for n in names])


def type_log(series: DataFrame, n: int) -> DataFrame:
    """The mean of all wells on a common grid of ``n`` depths, each inside its own range: ``(k, depth, value, n_wells)``."""
    bounds = series.filter("value is not null").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    s = series.filter("value is not null").select("well_id", "depth", "value", F.lead("depth").over(by_depth()).alias("d2"), F.lead("value").over(by_depth()).alias("v2"))
    s = s.crossJoin(F.broadcast(bounds)).filter("hi > lo")  # one row
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    first_k = F.ceil((F.col("depth") - F.col("lo")) / step - 1e-9)
    next_k = F.coalesce(F.ceil((F.col("d2") - F.col("lo")) / step - 1e-9), F.floor((F.col("depth") - F.col("lo")) / step + 1e-9) + 1)
    ks = F.when(next_k > first_k, F.sequence(first_k, next_k - 1)).otherwise(F.array().cast("array<bigint>"))
    s = s.select("well_id", "depth", "value", "d2", "v2", "lo", step.alias("step"), F.explode(ks).alias("k"))
    at = F.col("lo") + F.col("k") * F.col("step")
    value = F.when(F.col("d2").isNull(), F.col("value")).otherwise(F.col("value") + (at - F.col("depth")) / (F.col("d2") - F.col("depth")) * (F.col("v2") - F.col("value")))
    return s.groupBy(F.col("k").cast("long").alias("k")).agg(F.min(at).alias("depth"), F.avg(value).alias("value"), F.count("*").alias("n_wells"))
