"""Scores, overlaps and weights as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def similarity(cost_per_step: Column, scale: float, status: Column | None = None) -> Column:
    """exp(-cost/scale); zero for a cost that is not finite, or an edge whose status is not OK."""
    good = finite(cost_per_step) if status is None else finite(cost_per_step) & (status == "OK")
    return F.when(good, F.exp(-cost_per_step / max(scale, 1e-9))).otherwise(0.0)


def clamped_pad(distance: Column, base: float, slope: float, most: float) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(0.0), F.lit(base) + F.lit(slope) * distance))


def overlap(top1: Column, base1: Column, top2: Column, base2: Column, pad: float | Column = 0.0) -> tuple[Column, Column, Column, Column]:
    """Window (low, high) of the shared depths with a pad, their length, and its share of the shorter interval."""
    low, high = F.greatest(top1, top2), F.least(base1, base2)
    shared = F.greatest(F.lit(0.0), high - low)
    shorter = F.least(base1 - top1, base2 - top2)
    return low - pad, high + pad, shared, F.when(shorter > 0, shared / shorter).otherwise(0.0)


def range_score(x: Column, low: float, high: float) -> Column:
    """1 inside the range, falling exponentially with the distance in units of a margin outside."""
    margin = max(1.0, 0.2 * (high - low))
    return F.when((x >= low) & (x <= high), 1.0).otherwise(F.exp(-F.greatest(F.lit(low) - x, x - F.lit(high)) / margin))


def log_suite_score(canonical: Column) -> Column:
    """Score of the set of canonical mnemonics that a well has; -1e9 without a gamma ray."""
    has = lambda *names: F.arrays_overlap(canonical, F.array(*[F.lit(n) for n in names]))
    one = lambda c, w: F.when(c, F.lit(float(w))).otherwise(0.0)
    den, neu = has("RHOB"), has("NPHI", "NPOR", "CNPOR")
    total = one(has("GR"), 10) + one(has("DPHI", "DPOR", "SPOR"), 4) + one(den, 2) + one(neu, 2) + one(has("PE"), 3) + one(has("DT", "DTC"), 1) + one(den & neu, 2)
    total = total + 0.01 * F.size(F.array_distinct(canonical))
    return F.when(has("GR"), total).otherwise(-1e9)


def distance_weight(distance: Column, sigma: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-6), F.exp(-F.pow(distance / sigma, 2))))


def minmax_width(value: Column, low: Column, high: Column, inverted: bool = False) -> Column:
    """0.5 + 3.5 of the min-max scaled value; 1 for values that are not finite, 2 for a constant metric."""
    t = (value - low) / (high - low)
    return F.when(~finite(value), 1.0).when(high <= low, 2.0).otherwise(0.5 + 3.5 * (1 - t if inverted else t))
