"""Tops of a type log at several wavelet scales."""

from __future__ import annotations

import numpy as np

WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32)


def ricker_response(x: np.ndarray, width: int) -> np.ndarray:
    """Same-mode convolution with an odd Ricker wavelet of ten widths (five samples at least), its absolute sum one."""
    m = max(5, 10 * width) | 1
    t = (np.arange(m) - (m - 1) / 2) / width
    wave = (1 - t**2) * np.exp(-(t**2) / 2)
    full = np.convolve(x, wave / np.abs(wave).sum(), mode="full")
    return full[(m - 1) // 2 :][: len(x)]


def crossings(y: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Positions whose sign differs from the one before; zeros carry the sign before them, leading ones the sign after."""
    sign = np.where(np.abs(y) > eps, np.sign(y), 0)
    known = np.flatnonzero(sign)
    if not len(known):
        return np.empty(0, int)
    held = sign[known[np.maximum(np.searchsorted(known, np.arange(len(y)), "right") - 1, 0)]]
    return 1 + np.flatnonzero(held[1:] != held[:-1])


def snapped(coarse: np.ndarray, fine: np.ndarray, window: int) -> np.ndarray:
    """Each position to the nearest fine one within the window, the lower on a tie, else itself. ``fine`` ascends."""
    if not len(fine) or not len(coarse):
        return coarse
    after = np.searchsorted(fine, coarse)
    below, above = fine[np.maximum(after - 1, 0)], fine[np.minimum(after, len(fine) - 1)]
    near = np.where(np.abs(below - coarse) <= np.abs(above - coarse), below, above)
    return np.where(np.abs(near - coarse) <= window, near, coarse)


def by_level(type_log: np.ndarray, widths: tuple[int, ...] = WIDTHS, window: int = 25, ends: bool = True) -> list[np.ndarray]:
    """For each width its crossings, traced through all finer levels to the finest, with both ends of the log."""
    x = np.asarray(type_log, float)
    if not len(x):
        return [np.empty(0, int) for _ in widths]
    level = [crossings(ricker_response(x, w)) for w in widths]
    out = []
    for k, z in enumerate(level):
        for finer in reversed(level[:k]):
            z = snapped(z, finer, window)
        out.append(np.unique(np.r_[0, z, len(x) - 1] if ends else z))
    return out
