"""Perceptual ramps and differences of images, as arrays."""

from __future__ import annotations

import numpy as np

# The sRGB primaries under D65, its white, and the two ends of the gamma ray ramp.
TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])
PALE, DARK = "#F6E8A5", "#4B2E13"
KNEE = 6 / 29


def lab(rgb: np.ndarray) -> np.ndarray:
    """sRGB in 0..1 to CIE Lab."""
    rgb = np.asarray(rgb, float)
    t = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4) @ TO_XYZ.T / WHITE
    f = np.where(t > KNEE**3, np.cbrt(t), t / (3 * KNEE**2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def srgb(lab_colour: np.ndarray) -> np.ndarray:
    """CIE Lab to sRGB, clipped to 0..1."""
    c = np.asarray(lab_colour, float)
    fy = (c[..., 0] + 16) / 116
    f = np.stack([fy + c[..., 1] / 500, fy, fy - c[..., 2] / 200], axis=-1)
    xyz = np.where(f > KNEE, f**3, 3 * KNEE**2 * (f - 4 / 29)) * WHITE
    lin = np.clip(xyz @ np.linalg.inv(TO_XYZ).T, 0, 1)
    return np.clip(np.where(lin <= 0.0031308, 12.92 * lin, 1.055 * lin ** (1 / 2.4) - 0.055), 0, 1)


def of_hex(text: str) -> np.ndarray:
    return np.array([int(text.lstrip("#")[i : i + 2], 16) for i in (0, 2, 4)]) / 255


def ramp(low: str = PALE, high: str = DARK, n: int = 256) -> np.ndarray:
    """``n`` sRGB colours evenly spaced in Lab between two."""
    if n < 2:
        raise ValueError("a ramp needs two colours")
    t = np.linspace(0, 1, n)[:, None]
    return srgb((1 - t) * lab(of_hex(low)) + t * lab(of_hex(high)))


def difference(a: np.ndarray, b: np.ndarray, signed: bool = False, percentile: float = 99.0) -> np.ndarray:
    """Grey picture of how two pictures (rows, columns, channels) differ over the middle that both have, scaled by a percentile."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    middle = lambda im: im[(im.shape[0] - h) // 2 :][:h, (im.shape[1] - w) // 2 :][:, :w]
    d = middle(np.asarray(b, float)) - middle(np.asarray(a, float))
    grey = d.mean(axis=2) if signed else np.abs(d).mean(axis=2)
    scale = np.nanpercentile(np.abs(grey), percentile) if grey.size and np.isfinite(grey).any() else 1.0
    scale = scale if scale > 1e-9 else 1.0
    return np.clip(0.5 + 0.5 * grey / scale if signed else grey / scale, 0, 1)
