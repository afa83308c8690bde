"""One depth series at a time, on NumPy: resampling, normalising, quality features, shifts and knots."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# The congruential generator that places samples in a full reservoir.
LCG_FACTOR, LCG_STEP, LCG_MASK = 1103515245, 12345, 0x7FFFFFFF


class TraceError(ValueError):
    """A series that cannot be used; the text says why."""


def scaled(x: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    """Between two percentiles to 0..1, clipped; between the extremes where these are equal, else zeros. Missing samples stay."""
    good = x[np.isfinite(x)]
    if not len(good):
        return np.zeros(len(x))
    for a, b in (np.percentile(good, [low, high]), (good.min(), good.max())):
        if b > a:
            return np.clip((x - a) / (b - a), 0.0, 1.0)
    return np.zeros(len(x))


@dataclass(frozen=True)
class Trace:
    x: np.ndarray
    top: float
    base: float
    n_finite: int
    #: The median of the steps between different depths, as the file has them (negative in a file from the bottom up).
    step: float


def resampled(depth, value, n: int, low: float = 1.0, high: float = 99.0, min_finite: int = 10, window: tuple[float, float] | None = None, step_rows: int = 10_000) -> Trace:
    """``n`` even depths over a file's rows, read in their order, on lines between neighbouring rows; then ``scaled``.

    Top and base are those of all finite depths in the window, whether or not there is a value. Of
    neighbouring rows at one depth the mean counts; where depth falls from one row to the next there is
    no line, and what has been passed is not filled again; before the first and after the last row the
    value is held.
    """
    if n < 8 or not 0 <= low < high <= 100 or (window and window[1] <= window[0]):
        raise ValueError("at least 8 samples, ascending percentiles in 0..100 and an ascending window")
    d, v = np.asarray(depth, float), np.asarray(value, float)
    inside = np.isfinite(d)
    if window:
        inside &= (d >= window[0]) & (d <= window[1])
    d, v = d[inside], v[inside]
    if not len(d) or d.max() <= d.min():
        raise TraceError("no range of depths")
    steps = np.diff(d)
    steps = steps[steps != 0][:step_rows]
    top, base = float(d.min()), float(d.max())
    d, v = d[np.isfinite(v)], v[np.isfinite(v)]
    if len(d) < min_finite:
        raise TraceError("too few finite samples")
    run = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    z = np.linspace(top, base, n)
    x = along(z, d[run], np.add.reduceat(v, run) / np.diff(np.r_[run, len(d)])) if len(run) else np.full(n, np.nan)
    return Trace(scaled(x, low, high), top, base, len(d), float(np.median(steps)) if len(steps) else float("nan"))


def along(z: np.ndarray, d: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values at ascending ``z`` on the lines between points in their own order, no two neighbours alike: each place is
    filled by the first point from the second on that reaches it; ends are held."""
    if len(d) < 2:
        return np.full(len(z), v[0])
    at = 1 + np.searchsorted(np.maximum.accumulate(d[1:]), z)
    k = np.minimum(at, len(d) - 1)
    with np.errstate(all="ignore"):
        line = v[k - 1] + (z - d[k - 1]) / (d[k] - d[k - 1]) * (v[k] - v[k - 1])
    return np.where(z < d[0], v[0], np.where(at < len(d), line, v[-1]))


def windowed(x: np.ndarray, top: float, base: float, lo: float, hi: float, n: int, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    """``n`` samples of an even series between two depths, ends held, scaled anew."""
    if len(x) < 2:
        raise TraceError("series too short")
    return scaled(np.interp(np.linspace(lo, hi, n), np.linspace(top, base, len(x)), x), low, high)


def reservoir(values: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` values, each later one put in the place that a generator names if that is within."""
    values = np.asarray(values, float)
    out = values[:size].copy()
    if size > 0 and len(values) > size:
        seen = np.arange(size + 1, len(values) + 1, dtype=np.int64)
        at = (LCG_FACTOR * seen + LCG_STEP & LCG_MASK) % seen
        out[at[at < size]] = values[size:][at < size]  # of several for one place the last one stays
    return out


@dataclass(frozen=True)
class Quality:
    status: str
    error: str
    top: float
    base: float
    n: int
    finite_frac: float
    p05: float
    p50: float
    p95: float
    iqr: float
    spread: float
    std: float
    sand_frac: float
    shape: np.ndarray | None

    @property
    def thickness(self) -> float:
        return self.base - self.top if self.status != "FAIL" else float("nan")


def quality(depth, value, n_shape: int = 128, low: float = 1.0, high: float = 99.0, min_finite: int = 50, min_iqr: float = 0.5, min_spread: float = 2.0, sand: float = 0.35) -> Quality:
    """Statistics of a whole curve and its shape (filled, even, scaled): FAIL without enough samples, WARN if it hardly varies."""
    d, v = np.asarray(depth, float), np.asarray(value, float)
    n, nan = min(len(d), len(v)), float("nan")
    fail = lambda why, frac=0.0, top=nan, base=nan: Quality("FAIL", why, top, base, n, frac, *[nan] * 7, None)
    if n < 2:
        return fail("too_short")
    order = np.argsort(d, kind="stable")
    d, v = d[order], v[order]
    good = np.isfinite(d) & np.isfinite(v)
    k, frac = int(good.sum()), float(good.mean())
    if k < min_finite:
        there = d[np.isfinite(d)]
        return fail(f"too_few_finite:{k}", frac, *((float(there[0]), float(there[-1])) if len(there) else (nan, nan)))
    p5, p25, p50, p75, p95 = np.percentile(v[np.isfinite(v)], [5, 25, 50, 75, 95])
    top, base = float(d[good][0]), float(d[good][-1])
    last = np.r_[d[good][1:] != d[good][:-1], True]  # of rows at one depth the last
    shape = scaled(np.interp(np.linspace(top, base, n_shape), d[good][last], v[good][last]), low, high) if base > top else None
    flat = p75 - p25 < min_iqr and p95 - p5 < min_spread
    return Quality("WARN" if flat else "OK", "low_variance" if flat else "", top, base, n, frac, p5, p50, p95, p75 - p25, p95 - p5, float(np.std(v[good])), float(np.mean(shape < sand)) if shape is not None else nan, shape)


def shift_vector(shift, n: int) -> np.ndarray:
    """A shift for each of ``n`` samples: none is zero, one is everybody's, missing ones are the median, a short one goes on as it ends."""
    s = np.empty(0) if shift is None else np.asarray(shift, float).reshape(-1)
    if not len(s):
        return np.zeros(n)
    if len(s) == 1:
        return np.full(n, s[0])
    good = s[np.isfinite(s)]
    s = np.where(np.isfinite(s), s, np.median(good) if len(good) else 0.0)
    return np.r_[s[:n], np.full(max(0, n - len(s)), s[-1])]


def shift_resized(shift, n: int) -> np.ndarray:
    """As ``shift_vector``, but one of another length is stretched over the samples."""
    s = np.empty(0) if shift is None else np.asarray(shift, float).reshape(-1)
    if len(s) < 2:
        return shift_vector(shift, n)
    return s if len(s) == n else np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(s)), s)


def rising(z, x) -> tuple[np.ndarray, np.ndarray]:
    """Finite pairs by ascending, different ``z``, the first of each."""
    z, x = np.asarray(z, float), np.asarray(x, float)
    good = np.isfinite(z) & np.isfinite(x)
    z, first = np.unique(z[good], return_index=True)
    return z, x[good][first]


def knots(path: np.ndarray, depth_a: np.ndarray, depth_b: np.ndarray, shift_a=None, shift_b=None, z0: float = 0.0, most: int = 600) -> tuple[np.ndarray, np.ndarray] | None:
    """Where a path carries shifted depths of the first series to in the second, the median of several; None for hardly any."""
    n = min(len(depth_a), len(depth_b))
    p = np.asarray(path, np.int64).reshape(-1, 2)
    p = p[((p >= 0) & (p < n)).all(axis=1)]
    if len(p) < 4:
        return None
    if len(p) > most:
        p = p[np.linspace(0, len(p) - 1, most).astype(int)]
    ya, yb = depth_a[:n] + shift_vector(shift_a, n) - z0, depth_b[:n] + shift_vector(shift_b, n) - z0
    p = p[np.argsort(p[:, 0], kind="stable")]
    i, first = np.unique(p[:, 0], return_index=True)
    a, b = ya[i], np.array([np.median(part) for part in np.split(yb[p[:, 1]], first[1:])])
    good = np.isfinite(a) & np.isfinite(b)
    return (a[good], b[good]) if good.sum() >= 2 else None


def template_positions(path: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The template's positions on a path, in order, and the positions of the series that meet each."""
    p = np.asarray(path, np.int64).reshape(-1, 2)
    p = p[np.argsort(p[:, 1], kind="stable")]
    j, first = np.unique(p[:, 1], return_index=True)
    return j, np.split(p[:, 0], first[1:]) if len(j) else []


def warped_between(left: np.ndarray, right: np.ndarray, grid: np.ndarray, ties: tuple[np.ndarray, np.ndarray], columns: int) -> np.ndarray:
    """(grid, columns): the picture between two tracks on a depth grid. A depth of the left track leads to its partner on
    the right along the ties; in between, depths lie on straight lines and values are mixed by the way gone."""
    ya, yb = rising(*ties)
    out = np.full((len(grid), columns), np.nan)
    partner = np.interp(grid, ya, yb, left=np.nan, right=np.nan)
    there = np.isfinite(partner)
    if there.sum() < 2:
        return out
    value_right = np.interp(partner, grid, np.where(np.isfinite(right), right, np.nan))
    for c, t in enumerate((np.arange(columns) + 0.5) / columns):
        y, x = rising((1 - t) * grid[there] + t * partner[there], (1 - t) * left[there] + t * value_right[there])
        if len(y) >= 2:
            out[:, c] = np.interp(grid, y, x, left=np.nan, right=np.nan)
    return out
