"""Maps and panels as SVG texts, from what a query has collected for a picture (a picture's points are few)."""

from __future__ import annotations

from xml.sax.saxutils import escape

import numpy as np
import pandas as pd

from . import colours

SIZE, EDGE = 800, 30


def hex_of(colour: np.ndarray) -> str:
    return "#" + "".join(f"{round(255 * c):02x}" for c in colour)


def frame(body: list[str], title: str, width: float = SIZE, height: float = SIZE) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}"><rect width="100%" height="100%" fill="white"/>'
    return "\n".join([head, f'<text x="{EDGE}" y="20" font-size="14">{escape(title)}</text>', *body, "</svg>"])


def placer(lon: np.ndarray, lat: np.ndarray):
    """lon, lat to the picture, north up and true to scale in the middle."""
    stretch = np.cos(np.radians(np.mean(lat)))
    x0, x1, y0, y1 = lon.min() * stretch, lon.max() * stretch, lat.min(), lat.max()
    scale = (SIZE - 2 * EDGE) / max(x1 - x0, y1 - y0, 1e-9)
    return lambda lo, la: (EDGE + (lo * stretch - x0) * scale, SIZE - EDGE - (la - y0) * scale)


def shade(values: pd.Series) -> list[str]:
    """A colour for each value on the ramp; grey for missing ones."""
    v = values.to_numpy(float)
    good = np.isfinite(v)
    low, high = (v[good].min(), v[good].max()) if good.any() else (0.0, 1.0)
    steps = [hex_of(c) for c in colours.ramp()]
    return [steps[int(255 * (x - low) / (high - low)) if high > low else 128] if ok else "#cccccc" for x, ok in zip(v, good, strict=True)]


def point_map(points: pd.DataFrame, title: str = "", colour: str | None = None, edges: pd.DataFrame | None = None, widths: str | None = None) -> str:
    """``points(id, lat, lon)`` over the edges between them, points shaded and edges as wide as a column says."""
    if not len(points):
        return frame([], title)
    place, body = placer(points.lon.to_numpy(float), points.lat.to_numpy(float)), []
    at = {i: place(lo, la) for i, lo, la in points[["id", "lon", "lat"]].itertuples(index=False)}
    if edges is not None:
        for s, d, w in zip(edges.src, edges.dst, edges[widths] if widths else [1.0] * len(edges), strict=True):
            if s in at and d in at:
                (x1, y1), (x2, y2) = at[s], at[d]
                body.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="#888888" stroke-width="{w:.2f}"/>')
    fills = shade(points[colour]) if colour else ["#4b2e13"] * len(points)
    body += [f'<circle cx="{at[i][0]:.1f}" cy="{at[i][1]:.1f}" r="3" fill="{c}"/>' for i, c in zip(points.id, fills, strict=True)]
    return frame(body, title)


def cell_map(rings: pd.DataFrame, values: dict[str, float], title: str = "") -> str:
    """Cells (``cell_id, corner, lat, lon``) shaded by a number."""
    if not len(rings):
        return frame([], title)
    place, body = placer(rings.lon.to_numpy(float), rings.lat.to_numpy(float)), []
    ids = sorted(rings.cell_id.unique())
    for cell, fill in zip(ids, shade(pd.Series([values.get(c, np.nan) for c in ids], dtype=float)), strict=True):
        corners = [place(lo, la) for lo, la in rings[rings.cell_id == cell].sort_values("corner")[["lon", "lat"]].itertuples(index=False)]
        body.append(f'<polygon points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in corners)}" fill="{fill}" stroke="#666666"><title>{escape(str(cell))}</title></polygon>')
    return frame(body, title)


def panel(logs: dict[str, tuple[np.ndarray, np.ndarray]], tops: dict[str, list[float]] | None = None, title: str = "", width: float = 90.0) -> str:
    """Series (depths or times, values) side by side, downwards on one scale, with marks."""
    good = [z[np.isfinite(z)] for z, _ in logs.values()]
    good = np.concatenate(good) if good else np.empty(0)
    if not len(good):
        return frame([], title)
    low, high, body = good.min(), max(good.max(), good.min() + 1e-9), []
    y = lambda z: EDGE + 20 + (z - low) / (high - low) * (SIZE - 2 * EDGE - 20)
    for k, (name, (z, x)) in enumerate(logs.items()):
        left, ok = EDGE + k * width, np.isfinite(z) & np.isfinite(x)
        lo, hi = (x[ok].min(), max(x[ok].max(), x[ok].min() + 1e-9)) if ok.any() else (0.0, 1.0)
        line = " ".join(f"{left + (v - lo) / (hi - lo) * (width - 10):.1f},{y(d):.1f}" for d, v in zip(z[ok], x[ok], strict=True))
        body += [f'<text x="{left:.0f}" y="{EDGE + 12}" font-size="9">{escape(str(name))}</text>', f'<polyline points="{line}" fill="none" stroke="#4b2e13"/>']
        body += [f'<line x1="{left:.1f}" y1="{y(t):.1f}" x2="{left + width - 10:.1f}" y2="{y(t):.1f}" stroke="#cc3311"/>' for t in (tops or {}).get(name, []) if np.isfinite(t)]
    return frame(body, title, max(SIZE, 2 * EDGE + width * len(logs)))


def heat(matrix: np.ndarray, title: str = "") -> str:
    """A matrix as a picture (missing cells white): a section, a chronostratigraphic diagram, a raster."""
    steps, (rows, columns) = [hex_of(c) for c in colours.ramp()], matrix.shape
    good = matrix[np.isfinite(matrix)]
    low, high = (good.min(), max(good.max(), good.min() + 1e-9)) if len(good) else (0.0, 1.0)
    w, h, body = (SIZE - 2 * EDGE) / max(1, columns), (SIZE - 2 * EDGE) / max(1, rows), []
    for i, j in zip(*np.nonzero(np.isfinite(matrix)), strict=True):
        body.append(f'<rect x="{EDGE + j * w:.1f}" y="{EDGE + i * h:.1f}" width="{w:.2f}" height="{h:.2f}" fill="{steps[int(255 * (matrix[i, j] - low) / (high - low))]}"/>')
    return frame(body, title)
