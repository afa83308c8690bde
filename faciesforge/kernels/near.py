"""Places of one block and what lies within a radius of them, a matrix of some places by those around at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .greedy import EARTH_KM, haversine

#: Numbers of a matrix.
MOST = 1 << 15


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def _km(squared: np.ndarray, short: bool) -> np.ndarray:
    """The distances of squared chords; of short ones by the series, whose next term is below rounding."""
    chord = np.sqrt(squared)
    if not short:
        return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, chord / 2))
    more = squared * (3 * EARTH_KM / 640)
    more += EARTH_KM / 24
    more *= squared
    more += EARTH_KM
    chord *= more
    return chord


def meetings(lat: np.ndarray, lon: np.ndarray, own: int, radius_km: float, chord: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, km, near): the first ``own`` places in parts, all places that can lie within the radius of some of a part, their
    distances, and which of these are within it; ``chord`` is the radius's on the unit sphere, with room for rounding.

    Squares of half the radius on the plane that touches the sphere tell what can: to look from above only makes distances shorter.
    """
    at = on_sphere(lat, lon)
    up = at.mean(axis=0)
    up = up / np.linalg.norm(up) if np.linalg.norm(up) > 1e-9 else np.array([0.0, 0.0, 1.0])
    east = np.cross(up, np.eye(3)[int(np.argmin(np.abs(up)))])
    east /= np.linalg.norm(east)
    plane = at @ np.stack([east, np.cross(up, east)], axis=1)
    square = np.floor((plane - plane.min(axis=0)) / (chord / 2)).astype(np.int64)
    high = int(square[:, 1].max()) + 1
    code = square[:, 0] * high + square[:, 1]
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    exact, short = 4 * np.sin(min(radius_km / (2 * EARTH_KM), np.pi / 2)) ** 2, chord < 1e-2
    surely, maybe = exact * (1 - 1e-7) - 1e-18, exact * (1 + 1e-7) + 1e-18
    mine = np.argsort(code[:own], kind="stable")
    for part in np.split(mine, np.flatnonzero(np.diff(code[mine])) + 1):
        i, j = square[part[0]]
        first, last = max(j - 2, 0), min(j + 2, high - 1)
        ends = np.searchsorted(sorted_code, [[k * high + first, k * high + last + 1] for k in range(i - 2, i + 3)])
        columns = np.concatenate([order[a:b] for a, b in ends])
        middle = at[part[0]]
        b = at[columns] - middle
        right = np.concatenate([-2 * b, np.ones((len(b), 1)), (b * b).sum(axis=1)[:, None]], axis=1).T
        step = max(1, MOST // len(columns))
        for rows in (part[k : k + step] for k in range(0, len(part), step)):
            a = at[rows] - middle
            squared = np.concatenate([a, (a * a).sum(axis=1)[:, None], np.ones((len(a), 1))], axis=1) @ right
            np.maximum(squared, 0.0, out=squared)
            near, can = squared <= surely, squared <= maybe
            if np.count_nonzero(near) < np.count_nonzero(can):
                p, q = np.nonzero(near != can)
                near[p, q] = haversine(lat[rows[p]], lon[rows[p]], lat[columns[q]], lon[columns[q]]) <= radius_km
            yield rows, columns, _km(squared, short), near


def join(up: np.ndarray, members: np.ndarray) -> None:
    """All ``members`` in one set of the forest ``up``, whose roots are the least of their sets."""
    members = roots(up, members)
    up[members] = members.min()


def roots(up: np.ndarray, members: np.ndarray) -> np.ndarray:
    while True:
        above = up[members]
        if np.array_equal(above, members):
            return members
        members = above
