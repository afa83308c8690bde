"""Dynamic time warping of depth series, on NumPy: many pairs of one shape at once, an anti-diagonal of their tables at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Steps back: both series, the first only, the second only.
DIAGONAL, UP, LEFT = 0, 1, 2
FAR = 1e30
#: Cells of the tables that are held at once.
CELLS = 1 << 24


def _tables(x: np.ndarray, y: np.ndarray, alpha: float, free_start: bool, order: tuple[int, int, int], band: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Accumulated costs of the last row (m, pairs) and steps back (diagonal, i, pairs) of ``x`` (n, pairs) against ``y`` (m, pairs).

    Of equal steps the first in ``order``. A diagonal only needs the two before it, in which place i + 1 belongs to row i
    and place 0 to the border above the table.
    """
    (n, pairs), m = x.shape, len(y)
    upside = y[::-1]  # along a diagonal j falls as i grows
    before, last = np.full((n + 1, pairs), FAR), np.full((n + 1, pairs), FAR)
    before[0] = 0.0
    if free_start:
        last[0] = 0.0
    back, final = np.empty((n + m - 1, n, pairs), np.int8), np.empty((m, pairs))
    for s in range(n + m - 1):
        lo, hi = max(0, s - m + 1), min(n, s + 1)
        cost = np.abs(x[lo:hi] - upside[m - 1 - s + lo : m - 1 - s + hi]) ** alpha
        if band is not None:
            cost[band[np.arange(lo, hi), s - np.arange(lo, hi)]] = FAR
        steps = {DIAGONAL: before[lo:hi], UP: last[lo:hi], LEFT: last[lo + 1 : hi + 1]}
        best, pick = steps[order[0]].copy(), back[s, lo:hi]
        pick[:] = order[0]
        for k in order[1:]:
            less = steps[k] < best
            np.copyto(best, steps[k], where=less)
            pick[less] = k
        best += cost
        np.minimum(best, FAR, out=best)
        before[lo + 1 : hi + 1] = best
        if s == 0 and not free_start:
            before[0] = FAR
        before, last = last, before
        if hi == n:
            final[s - n + 1] = last[n]
    return final, back


def _paths(back: np.ndarray, end: np.ndarray, stop_at_row: bool) -> Iterator[np.ndarray]:
    """The way of each pair from its end (the last row, place ``end``) back to the start, as (i, j) from the start."""
    n, pairs = back.shape[1:]
    i, j, which = np.full(pairs, n - 1), end.astype(np.int64), np.arange(pairs)
    ways = np.empty((back.shape[0], 2, pairs), np.int32)
    length = np.zeros(pairs, np.int64)
    for k in range(back.shape[0]):
        ways[k, 0, which], ways[k, 1, which] = i, j
        length[which] = k + 1
        more = (i > 0) | ((j > 0) & (not stop_at_row))
        i, j, which = i[more], j[more], which[more]
        step = back[i + j, i, which]
        i, j = i - (step != LEFT), j - (step != UP)
        inside = (i >= 0) & (j >= 0)
        i, j, which = i[inside], j[inside], which[inside]
        if not len(which):
            break
    for k in range(pairs):
        yield ways[: length[k], :, k][::-1]


def _pieces(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (pairs, n), (pairs, m) some at a time, turned so that pairs lie side by side."""
    some = max(1, CELLS // max(1, x.shape[1] * (x.shape[1] + y.shape[1])))
    for at in range(0, len(x), some):
        yield np.ascontiguousarray(x[at : at + some].T, float), np.ascontiguousarray(y[at : at + some].T, float)


def dtw_many(x: np.ndarray, y: np.ndarray, alpha: float = 0.15, band: int | None = None) -> Iterator[tuple[float, np.ndarray]]:
    """Cost and path of the end-to-end alignment of each row of ``x`` with that of ``y`` under ``|x - y| ** alpha``, inside a band of frames if given."""
    n, m = x.shape[1], y.shape[1]
    off = None
    if band is not None:
        off = np.abs(np.arange(n)[:, None] * (m - 1) / max(1, n - 1) - np.arange(m)[None, :]) > max(band, abs(n - m) / max(1, n - 1) + 1)
    for a, b in _pieces(x, y):
        final, back = _tables(a, b, alpha, False, (DIAGONAL, LEFT, UP), off)
        yield from zip(final[-1].tolist(), _paths(back, np.full(a.shape[1], m - 1), False), strict=True)


def subsequence_many(x: np.ndarray, y: np.ndarray, alpha: float = 0.15) -> Iterator[tuple[float, np.ndarray]]:
    """Cost and path of the best place of each row of ``x`` inside that of ``y``."""
    if min(x.shape[1], y.shape[1]) < 8 or alpha <= 0:
        raise ValueError("both series need 8 samples, and alpha has to be positive")
    for a, b in _pieces(x, y):
        final, back = _tables(a, b, alpha, True, (DIAGONAL, UP, LEFT), None)
        end = final.argmin(axis=0)
        yield from zip(final[end, np.arange(len(end))].tolist(), _paths(back, end, True), strict=True)


def by_shape(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of series gathered by their two lengths: (places, rows of x, rows of y)."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(x, y, strict=True)):
        shapes.setdefault((len(a), len(b)), []).append(k)
    for at in shapes.values():
        yield np.array(at), np.stack([x[k] for k in at]), np.stack([y[k] for k in at])


def filled(x: np.ndarray) -> np.ndarray:
    """Missing samples on the line between their neighbours, the ends held."""
    x = np.asarray(x, float)
    good = np.isfinite(x)
    if good.all():
        return x
    return np.interp(np.arange(len(x)), np.flatnonzero(good), x[good]) if good.any() else x


def path_sample(path: np.ndarray, n: int) -> np.ndarray:
    """``n`` evenly spaced steps of a path with both ends (whole positions, rounded down)."""
    return path if n <= 0 or len(path) <= n else path[np.linspace(0, len(path) - 1, n).astype(int)]


def dtw(x: np.ndarray, y: np.ndarray, alpha: float = 0.15, band: int | None = None) -> tuple[float, np.ndarray]:
    """``dtw_many`` for one pair."""
    return next(dtw_many(np.asarray(x, float)[None], np.asarray(y, float)[None], alpha, band))


def subsequence_dtw(x: np.ndarray, y: np.ndarray, alpha: float = 0.15) -> tuple[float, float, np.ndarray, int, int]:
    """Cost, cost per step, path, first and last position of the best place of ``x`` inside ``y``."""
    cost, path = next(subsequence_many(np.asarray(x, float)[None], np.asarray(y, float)[None], alpha))
    return cost, cost / len(path), path, int(path[0, 1]), int(path[-1, 1])


def end_slopes_ok(path: np.ndarray, share: float = 0.1, least: int = 16, low: float = 0.5, high: float = 2.0, n: int | None = None) -> bool:
    """Whether the slope over the first and over the last steps (a share of ``n`` samples, by default of the path) lies in
    the allowed range; a stretch without advance passes, and so does a path of one step."""
    k = min(len(path), max(least, int(share * (len(path) if n is None else n))))
    if k < 2:
        return True
    for a, b in ((path[0], path[k - 1]), (path[-k], path[-1])):
        di, dj = b - a
        if di and not low <= dj / di <= high:
            return False
    return True


def median_j(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each i of a path and the truncated median of its j."""
    i = np.unique(path[:, 0])
    return i, np.array([int(np.median(path[path[:, 0] == k, 1])) for k in i])


def align_many(xs: list[np.ndarray | None], ys: list[np.ndarray | None], alpha: float, points: int, steps: str = "tiepoints", least: int = 8) -> list[tuple[str, float, int, float, np.ndarray]]:
    """Status, cost, steps, cost per step and tie points of each edge; edges of equal lengths are aligned together."""
    none = np.empty((0, 2), int)
    out: list = [("SKIP:missing_arrays", np.nan, 0, np.nan, none)] * len(xs)
    fit = []
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        if x is not None and y is not None:
            out[k] = ("SKIP:too_short", np.nan, 0, np.nan, none)
            if min(np.isfinite(x).sum(), np.isfinite(y).sum()) >= least:
                fit.append(k)
    for at, x, y in by_shape([filled(xs[k]) for k in fit], [filled(ys[k]) for k in fit]):
        for k, (cost, path) in zip(at.tolist(), dtw_many(x, y, alpha), strict=True):
            ties = path_sample(path, points)
            n = len(ties) if steps == "tiepoints" else len(path)
            out[fit[k]] = ("OK", cost, n, cost / n, ties)
    return out


def align_edge(x: np.ndarray | None, y: np.ndarray | None, alpha: float, points: int, steps: str = "tiepoints", least: int = 8) -> tuple[str, float, int, float, np.ndarray]:
    """``align_many`` for one edge."""
    return align_many([x], [y], alpha, points, steps, least)[0]
