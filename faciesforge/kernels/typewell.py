"""The well that stands for a cell: outliers out, then the medoid of shapes and features. A kernel's candidates are capped
by its settings (by farthest points or by distance), so the pairwise tables here stay small."""

from __future__ import annotations

import numpy as np

FEATURES = ("thickness", "ntg", "iqr", "mean")
#: Of shape and of each feature.
WEIGHTS = (1.0, 0.6, 0.6, 0.3, 0.2)
GRID_FEATURES = ("thickness", "p50", "iqr", "spread", "std", "sand_frac", "finite_frac")


def mad(x: np.ndarray) -> float:
    return float(np.median(np.abs(x - np.median(x))))


def robust_z(x: np.ndarray, style: str = "0.6745") -> np.ndarray:
    m = mad(x)
    if not np.isfinite(m) or m <= 1e-12:
        return np.zeros(len(x))
    return 0.6745 * (x - np.median(x)) / m if style == "0.6745" else (x - np.median(x)) / (1.4826 * m)


def local(features: np.ndarray, shapes: np.ndarray, passes: np.ndarray, z_max: float = 3.5, shape_z_max: float = 3.5, weights: tuple[float, float, float, float, float] = WEIGHTS, least: int = 5) -> tuple[int, np.ndarray]:
    """(medoid, members used) among candidates with columns ``FEATURES``; a filter that leaves fewer than ``least`` is not applied.

    Distances: mean absolute difference of shapes and each feature's difference in units of its median absolute deviation, weighted.
    """

    def narrowed(use: np.ndarray, keep: np.ndarray) -> np.ndarray:
        return use[keep] if keep.sum() >= least else use

    use = narrowed(np.arange(len(features)), passes)
    use = narrowed(use, (np.abs(np.stack([robust_z(features[use, k]) for k in range(features.shape[1])])) <= z_max).all(axis=0))
    off = np.abs(shapes[use] - np.median(shapes[use], axis=0)).mean(axis=1)
    use = narrowed(use, np.abs(robust_z(off)) <= shape_z_max)
    x, f = shapes[use], features[use]
    d = weights[0] * np.stack([np.abs(x - row).mean(axis=1) for row in x])
    for k, w in enumerate(weights[1:]):
        d += w * np.abs(f[:, None, k] - f[None, :, k]) / max(mad(f[:, k]), 1e-6)
    return int(use[np.argmin(d.sum(axis=1))]), use


def on_grid(features: np.ndarray, shapes: np.ndarray, dist_km: np.ndarray, n_min: int = 12, z_max: float = 3.5, sigma_km: float | None = 20.0, w_feature: float = 1.0, w_shape: float = 2.0) -> tuple[int, np.ndarray] | None:
    """(medoid, members used) among candidates that passed the gates, with columns ``GRID_FEATURES``; None for fewer than ``n_min``.

    Sums of absolute differences, nearer members weighing more; outliers in a feature or in shape go unless hardly any would stay.
    """
    n = len(features)
    if n < n_min:
        return None
    z = np.abs(np.stack([robust_z(features[:, k], "1.4826") for k in range(features.shape[1])]))
    between = np.stack([np.abs(shapes - row).sum(axis=1) for row in shapes])
    keep = (z <= z_max).all(axis=0) & (np.abs(robust_z(np.median(between, axis=1), "1.4826")) <= z_max)
    use = np.flatnonzero(keep) if keep.sum() >= max(3, n_min // 2) else np.arange(n)
    d = w_feature * np.stack([np.abs(features[use] - row).sum(axis=1) for row in features[use]]) + w_shape * between[np.ix_(use, use)]
    w = np.ones(len(use)) if sigma_km is None else np.clip(np.exp(-((dist_km[use] / max(sigma_km, 1e-6)) ** 2)), 1e-6, 1.0)
    return int(use[np.argmin(d @ w)]), use
