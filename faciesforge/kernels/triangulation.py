"""Delaunay triangulation of points in the plane, with exact signs and a corner at infinity.

Points are inserted from west to east. Signs of determinants come from floating point where
its error cannot matter and from integers where it could. Points on one circle are told apart
as if later ones (further east, then north) were lifted ever so little more, a rule that does
not depend on which other points are there: parts of a set that are triangulated separately
agree wherever each knows all that matters. Beyond each edge of the hull stands a triangle
with a corner at infinity, whose circle is the half plane outside.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: Bounds on the error of the two determinants, against sums of products of what goes into them.
ORIENT_ERROR, CIRCLE_ERROR = 4e-16, 3e-15
#: From this ratio of squared side to area on, a circle's centre is not computed from floating point.
THIN = 1e6


def _sign(x) -> int:
    return (x > 0) - (x < 0)


class Points:
    """Coordinates in floating point and, where asked for, as exact integers: all by one power of two, which no sign depends on."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    @cached_property
    def whole(self) -> list[tuple[int, int]]:
        ratios = [[v.as_integer_ratio() for v in np.asarray(c, float).tolist()] for c in (self.x, self.y)]
        one = max((d for c in ratios for _, d in c), default=1)
        return list(zip(*([n * (one // d) for n, d in c] for c in ratios), strict=True))

    def exact(self, i: int) -> tuple[int, int]:
        return self.whole[i]

    def orient(self, a: int, b: int, c: int) -> int:
        """1 if c lies left of the way from a to b, -1 right, 0 on the line."""
        (ax, ay), (bx, by), (cx, cy) = (self.exact(i) for i in (a, b, c))
        return _sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    def in_circle(self, a: int, b: int, c: int, p: int) -> int:
        """1 if p lies inside the circle of a, b, c (counter-clockwise), -1 outside, 0 on it."""
        px, py = self.exact(p)
        rows = [(x - px, y - py) for x, y in (self.exact(i) for i in (a, b, c))]
        (ax, ay), (bx, by), (cx, cy) = rows
        la, lb, lc = (x * x + y * y for x, y in rows)
        return _sign(la * (bx * cy - cx * by) + lb * (cx * ay - ax * cy) + lc * (ax * by - bx * ay))


def circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii of circles, and whether a triangle is too thin for them to be trusted."""
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    (bx, by), (cx, cy) = (b - a).T, (c - a).T
    d = 2 * (bx * cy - cx * by)
    lb, lc = bx * bx + by * by, cx * cx + cy * cy
    longest = np.maximum(np.maximum(lb, lc), (bx - cx) ** 2 + (by - cy) ** 2)
    thin = longest > THIN * np.abs(d)
    with np.errstate(all="ignore"):
        ux, uy = (cy * lb - by * lc) / d, (bx * lc - cx * lb) / d
    return np.stack([ux, uy], axis=1) + a, np.hypot(ux, uy), thin


def triangulate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (counter-clockwise) and edges of the hull (counter-clockwise) of different points ordered by (x, y).

    Both are empty where all points lie on a line.
    """
    n, points, p = len(x), Points(x, y), np.stack([x, y], axis=1)
    none = np.empty((0, 3), np.int64), np.empty((0, 2), np.int64)
    k = next((i for i in range(2, n) if points.orient(0, 1, i)), None)
    if k is None:
        return none
    left = points.orient(0, 1, k) > 0
    row = np.arange(k)
    fan = np.stack([row[:-1], row[1:], np.full(k - 1, k)], axis=1)
    way = np.r_[row, k] if left else np.r_[k, row[::-1]]
    tri, hull = fan if left else fan[:, [1, 0, 2]], np.stack([way, np.roll(way, -1)], axis=1)
    span = max(np.ptp(x), np.ptp(y))

    def reach(t: np.ndarray) -> np.ndarray:
        """East of this a circle surely has no point."""
        centre, r, thin = circles(p, t)
        with np.errstate(invalid="ignore"):
            return np.where(thin, np.inf, centre[:, 0] + r * (1 + 1e-6) + 1e-9 * span)

    done, east = [], reach(tri)
    corner = p[tri].reshape(-1, 6)
    for q in range(k + 1, n):
        past = east < x[q]
        if past.any():
            done.append(tri[past])
            tri, corner, east = tri[~past], corner[~past], east[~past]
        ax, ay, bx, by, cx, cy = (corner - p[[q, q, q]].ravel()).T
        la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        det = la * (bx * cy - cx * by) + lb * (cx * ay - ax * cy) + lc * (ax * by - bx * ay)
        bad = det > 0
        for i in np.flatnonzero(np.abs(det) <= CIRCLE_ERROR * (la + lb + lc) ** 2):
            bad[i] = points.in_circle(*tri[i].tolist(), q) > 0
        a, b = p[hull[:, 0]] - p[q], p[hull[:, 1]] - p[q]
        one, two = b[:, 0] * a[:, 1], b[:, 1] * a[:, 0]
        seen = one - two > 0
        for i in np.flatnonzero(np.abs(one - two) <= ORIENT_ERROR * (np.abs(one) + np.abs(two))):
            seen[i] = points.orient(hull[i, 1], hull[i, 0], q) > 0
        ends = hull[seen].tolist()
        # few sides, so plain sets are faster than arrays; those whose other side goes too are inside the hole
        sides = {(v, u) for u, v in ends}
        for i, j, k in tri[bad].tolist():
            sides |= {(i, j), (j, k), (k, i)}
        new = np.array([(u, v, q) for u, v in sides if (v, u) not in sides])
        # what is seen of the hull is one stretch, whose two ends get an edge to the new point
        starts, stops = {u for u, _ in ends}, {v for _, v in ends}
        hull = np.concatenate([hull[~seen], [[(starts - stops).pop(), q], [q, (stops - starts).pop()]]])
        tri, corner, east = np.concatenate([tri[~bad], new]), np.concatenate([corner[~bad], p[new].reshape(-1, 6)]), np.concatenate([east[~bad], reach(new)])
    return np.concatenate([*done, tri]), hull


def edges_of(tri: np.ndarray) -> np.ndarray:
    """The different edges (i < j) of triangles."""
    ends = np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1)
    return np.unique(ends, axis=0)


def ordered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the different points by (x, y), of coincident ones the first."""
    order = np.lexsort((np.arange(len(x)), y, x))
    fresh = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)] if len(x) else np.empty(0, bool)
    return order[fresh]


def hull_corners(points: Points) -> np.ndarray:
    """Places of the corners of the hull of different points; exact, without those that lie within an edge."""
    order = np.lexsort((points.y, points.x)).tolist()

    def side(places: list[int]) -> list[int]:
        way: list[int] = []
        for q in places:
            while len(way) > 1:
                a, b = way[-2], way[-1]
                one = (points.x[b] - points.x[a]) * (points.y[q] - points.y[a])
                two = (points.y[b] - points.y[a]) * (points.x[q] - points.x[a])
                turn = one - two
                if abs(turn) <= ORIENT_ERROR * (abs(one) + abs(two)):
                    turn = points.orient(a, b, q)
                if turn > 0:
                    break
                way.pop()
            way.append(q)
        return way

    return np.unique(np.array(side(order) + side(order[::-1]), np.int64))


def touched(p: np.ndarray, tri: np.ndarray, boxes: np.ndarray, known: np.ndarray, own: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) where the circle of ``tri[i]`` may hold unknown points of ``boxes[j]`` (x0, y0, x1, y1).

    All points in the rectangle ``known`` and in the box ``own`` are known. What is not sure counts as touched. Circles count
    only where points can be: beyond the hull nothing is.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    lo, hi = boxes[:, :2], boxes[:, 2:]

    def unknown(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Boxes that meet a rectangle elsewhere than in what is known."""
        a, b = np.maximum(lo, low), np.minimum(hi, high)
        return (a <= b).all(axis=1) & ~((a >= known[:2]).all(axis=1) & (b <= known[2:]).all(axis=1))

    def met(i: int, which: np.ndarray) -> None:
        j = np.flatnonzero(which)
        j = j[j != own]
        out.append((np.full(len(j), i), j))

    centre, r, thin = circles(p, tri)
    r = r * (1 + 1e-6) + margin
    sure = ~thin & (centre - r[:, None] >= known[:2]).all(axis=1) & (centre + r[:, None] <= known[2:]).all(axis=1)
    for i in np.flatnonzero(~sure & ~thin):
        c = centre[i]
        met(i, unknown(c - r[i], c + r[i]) & ((np.maximum(0, np.maximum(lo - c, c - hi)) ** 2).sum(axis=1) <= r[i] ** 2))
    for i in np.flatnonzero(thin):
        # a thin triangle's circle lies beyond its longest side, but for a segment of the circle over that side
        at = tri[i]
        k = int(np.argmax([np.hypot(*(p[at[(j + 1) % 3]] - p[at[j]])) for j in range(3)]))
        a, b, c = p[at[k]], p[at[(k + 1) % 3]], p[at[(k + 2) % 3]]
        length = np.hypot(*(b - a))
        d = (b - a) / length
        t, h = float((c - a) @ d), abs(float((c - a) @ [-d[1], d[0]]))
        height = min(length, h * length**2 / max(2 * t * (length - t), 1e-300)) + margin  # twice what it can be
        x, y = np.where(d[1] > 0, hi[:, 0], lo[:, 0]), np.where(d[0] > 0, lo[:, 1], hi[:, 1])  # the corner furthest beyond the side
        beyond = (x - a[0]) * d[1] - (y - a[1]) * d[0] >= -margin
        met(i, beyond | unknown(np.minimum(a, b) - height, np.maximum(a, b) + height))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def inside(corners: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For circles through ``corners`` (ax, ay, bx, by, cx, cy, counter-clockwise), a row each, and points, a column each: which
    may lie inside, and how far (of one circle, larger is deeper)."""
    ax, ay, bx, by, cx, cy = (corners[:, k, None] - (y if k % 2 else x) for k in range(6))
    la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = la * (bx * cy - cx * by) + lb * (cx * ay - ax * cy) + lc * (ax * by - bx * ay)
    return det >= -CIRCLE_ERROR * (la + lb + lc) ** 2, det
