"""The Delaunay triangulation of a table of points, in tiles.

Points are dealt to tiles of about equal numbers: strips by quantiles of x, cut by quantiles
of y. A tile triangulates its own points with those of a halo. A triangle at one of its own
points is right if its circle holds no other point; what the tile does not know are the points
of other tiles outside its halo, and those lie in their tiles' boxes. A triangle whose circle
meets no such box, or meets it within the halo alone, is right for all points. Else the tile
asks the tiles whose boxes are met for the points in that circle, and looks again: a triangle
that is still there when all were told is right. A tile at the rim gets the corners of the hull
of all points first, so that beyond its own hull nothing is. So a tile gathers what its own
triangles ask for and no task holds all points; only a point whose edges lead everywhere (the
hub of a wheel) needs them all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import triangulation
from ..scratch import cut, many_tasks

#: Points of a tile, and how many tiles at most; beyond that tiles grow. Their boxes, four numbers each, are sent to all tasks.
TILE_POINTS, MAX_TILES = 2000, 65_536
#: A halo's width in mean distances between points; points that a tile tells of one circle the first time, twice as many each further one.
HALO, TOLD = 8.0, 32
#: Numbers of a matrix of circles and points.
MATRIX = 1 << 18
#: Rows of a tile: a point (a: its id, b: its tile, or -1), a circle that was asked about (a, b, c: its corners' ids), one of which not all
#: points were told, and that the corners of the hull are among the points.
POINT, ASKED, UNTOLD, CORNER = range(4)
CORNERS = ("ax", "ay", "bx", "by", "cx", "cy")


def below(bounds, value):
    """How many of an array of ascending bounds are not above the value."""
    return F.size(F.filter(bounds, lambda b: b <= value))


def tiled(points: DataFrame, tile_points: int) -> DataFrame:
    """``points(id, x, y)`` (written) with ``strip`` and ``tile``, of about ``tile_points`` points each."""
    n = points.count()
    tiles = max(1, min(MAX_TILES, -(-n // tile_points)))
    strips = max(1, round(math.sqrt(tiles)))
    rows = -(-tiles // strips)
    inner = lambda parts: [i / parts for i in range(1, parts)]
    quantiles = lambda c, parts: F.array_distinct(F.percentile_approx(c, F.array(*map(F.lit, inner(parts))), 100 * parts)) if parts > 1 else F.array().cast("array<double>")
    bounds = points.agg(quantiles("x", strips).alias("b")).first()["b"] or []
    placed = points.withColumn("strip", below(F.array(*map(F.lit, bounds)).cast("array<double>"), F.col("x")))
    cuts = cut(placed.groupBy("strip").agg(quantiles("y", rows).alias("cuts")), "strip-cuts")  # a row a strip, 256 at most
    return placed.join(F.broadcast(cuts), "strip").withColumn("tile", F.col("strip") * rows + below(F.col("cuts"), F.col("y"))).drop("cuts")


def overlapping(strip: np.ndarray, known: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of tiles where the rectangle known to i meets the box of j; strips that are far apart are passed over."""
    out = []
    for s in np.unique(strip):
        mine = np.flatnonzero(strip == s)
        near = np.flatnonzero((boxes[:, 0] <= known[mine, 2].max()) & (boxes[:, 2] >= known[mine, 0].min()))
        a, b = known[mine][:, None], boxes[near][None]
        i, j = np.nonzero((b[..., 0] <= a[..., 2]) & (b[..., 2] >= a[..., 0]) & (b[..., 1] <= a[..., 3]) & (b[..., 3] >= a[..., 1]))
        out.append((mine[i], near[j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def hull_of(placed: DataFrame, tasks: int) -> DataFrame:
    """(id, x, y): the corners of the hull of ``placed(cell, strip, id, x, y)``, those of the hulls of cells, then of strips, then of these."""

    def corners(rows: pa.Table) -> pa.Table:
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        return rows.take(pa.array(triangulation.hull_corners(triangulation.Points(x, y))))

    part, kinds = placed.select("cell", "strip", "id", "x", "y"), dict(placed.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in part.columns)
    for by in (["cell"], ["strip"]):
        part = part.repartition(tasks, *by).groupBy(*by).applyInArrow(corners, schema)
    return part.groupBy().applyInArrow(corners, schema).select("id", "x", "y")


def delaunay_edges(points: DataFrame, tile_points: int = TILE_POINTS) -> DataFrame:
    """(src, dst), src < dst: the Delaunay edges of all ``points(id, x, y)`` together.

    Of coincident points the smallest id has the edges; points without coordinates take no part, and points that all lie
    on one line have no edges. Of points on one circle the triangles are those of ``kernels.triangulation``.
    """
    spark = points.sparkSession
    tasks = many_tasks(spark)  # a tile is few bytes and much work, so tasks are not dealt by bytes
    usable = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    whole = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(usable)
    sites = cut(tiled(cut(whole.repartition(tasks, "x", "y").groupBy("x", "y").agg(F.min("id").alias("id")), "sites"), tile_points), "tiled")
    found = sites.groupBy("tile").agg(F.first("strip").alias("strip"), F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"]).orderBy("tile").collect()
    if sum(r["n"] for r in found) < 3:
        return spark.createDataFrame([], "src long, dst long")
    number = {r["tile"]: i for i, r in enumerate(found)}  # MAX_TILES at most
    boxes = np.array([[r["min_x"], r["min_y"], r["max_x"], r["max_y"]] for r in found], float)
    sides = boxes[:, 2:] - boxes[:, :2]
    count = np.array([r["n"] for r in found])
    width = HALO * np.maximum(np.sqrt(sides.prod(axis=1) / count), sides.max(axis=1) / count)
    known = boxes + width[:, None] * [-1, -1, 1, 1]
    margin = 1e-9 * float(max(np.ptp(boxes[:, [0, 2]]), np.ptp(boxes[:, [1, 3]]), 1e-300))
    shared = spark.sparkContext.broadcast((boxes, known))
    tile_of = spark.createDataFrame([(t, i) for t, i in number.items()], "tile int, cell int")
    placed = cut(sites.join(F.broadcast(tile_of), "tile").select("cell", "strip", "id", "x", "y").repartition(tasks, "cell"), "placed")
    kinds = {"tile": pa.int32(), "src": pa.int64(), "dst": pa.int64(), "rim": pa.bool_(), "cell": pa.int32(), "a": pa.int64(), "b": pa.int64(), "c": pa.int64()} | dict.fromkeys(CORNERS, pa.float64())

    def looked(rows: pa.Table) -> pa.Table:
        """Edges of a tile's ``rows``, if it is sure of all; else that it lies at the rim, or the circles it asks other tiles about."""
        boxes, known = shared.value
        tile = rows.column("tile")[0].as_py()
        kind = rows.column("kind").to_numpy()
        a, b, c = (rows.column(k).to_numpy() for k in ("a", "b", "c"))
        told, untold = ({t for t in zip(*(x[kind == k].tolist() for x in (a, b, c)), strict=True)} for k in (ASKED, UNTOLD))
        point = np.flatnonzero(kind == POINT)
        point = point[np.unique(a[point], return_index=True)[1]]
        ids, x, y = a[point], rows.column("x").to_numpy()[point], rows.column("y").to_numpy()[point]
        order = np.lexsort((y, x))
        ids, p, own = ids[order], np.stack([x[order], y[order]], axis=1), np.isin(ids[order], a[(kind == POINT) & (b == tile)])
        tri, hull = triangulation.triangulate(p[:, 0], p[:, 1])

        def out(n: int, **columns) -> pa.Table:
            return pa.table({c: pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in (kinds | {"tile": pa.int32()}).items()})

        if not (kind == CORNER).any() and (not len(tri) or own[hull].any()):
            return out(1, tile=[tile], rim=[True])
        at_own = tri[own[tri].any(axis=1)]
        i, j = triangulation.touched(p, at_own, boxes, known[tile], tile, margin)
        names = np.sort(ids[at_own], axis=1)
        open_ = np.array([t in untold or t not in told for t in map(tuple, names.tolist())], bool)
        i, j = i[open_[i]], j[open_[i]]
        if len(i):
            corners = p[at_own[i]].reshape(-1, 6)
            return out(len(i), tile=np.full(len(i), tile), cell=j, **dict(zip("abc", names[i].T, strict=True)), **dict(zip(CORNERS, corners.T, strict=True)))
        ends = triangulation.edges_of(at_own)
        # each edge from the tile of its smaller id
        src, dst = np.minimum(ids[ends[:, 0]], ids[ends[:, 1]]), np.maximum(ids[ends[:, 0]], ids[ends[:, 1]])
        first = np.where(ids[ends[:, 0]] < ids[ends[:, 1]], own[ends[:, 0]], own[ends[:, 1]])
        return out(int(first.sum()), tile=np.full(int(first.sum()), tile), src=src[first], dst=dst[first])

    def telling(most: int):
        def tell(asked: pa.Table, points: pa.Table) -> pa.Table:
            """The points of a tile inside the circles that it is asked about, ``most`` of each at most, the deepest first; circles with more are named."""
            ids, x, y = (points.column(c).to_numpy() for c in ("id", "x", "y"))
            corners = np.stack([asked.column(c).to_numpy() for c in CORNERS], axis=1)
            tile, names = asked.column("tile").to_numpy(), np.stack([asked.column(c).to_numpy() for c in "abc"], axis=1)
            step = max(1, MATRIX // max(1, len(ids)))
            to, which, more = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in range(0, len(corners), step):
                into, depth = triangulation.inside(corners[k : k + step], x, y)
                over = np.flatnonzero(into.sum(axis=1) > most)
                for i in over:
                    into[i, np.argsort(np.where(into[i], depth[i], -np.inf), kind="stable")[:-most]] = False
                i, j = np.nonzero(into)
                to, which, more = [*to, tile[i + k]], [*which, j], [*more, over + k]
            more = np.concatenate(more)
            sent = np.unique(np.stack([np.concatenate(to), np.concatenate(which)], axis=1), axis=0)  # once to each tile
            n, m = len(sent), len(more)
            return pa.table({
                "tile": pa.array(np.r_[sent[:, 0], tile[more]], pa.int32()),
                "kind": pa.array(np.r_[np.full(n, POINT), np.full(m, UNTOLD)], pa.int32()),
                "a": pa.array(np.r_[ids[sent[:, 1]], names[more, 0]], pa.int64()),
                "b": pa.array(np.r_[np.full(n, -1), names[more, 1]], pa.int64()),
                "c": pa.array(np.r_[np.full(n, -1), names[more, 2]], pa.int64()),
                "x": pa.array(np.r_[x[sent[:, 1]], np.zeros(m)], pa.float64()),
                "y": pa.array(np.r_[y[sent[:, 1]], np.zeros(m)], pa.float64()),
            })

        return tell

    of_points = "tile int, kind int, a long, b long, c long, x double, y double"
    found_schema = "tile int, src long, dst long, rim boolean, cell int, a long, b long, c long, " + ", ".join(f"{c} double" for c in CORNERS)
    none = F.lit(-1).cast("long")
    i, j = overlapping(np.array([r["strip"] for r in found]), known, boxes)
    halo = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), *known[i].T.tolist(), strict=True)), "tile int, cell int, x0 double, y0 double, x1 double, y1 double")
    mine = F.col("tile") == F.col("cell")
    within = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    point = [F.lit(POINT).alias("kind"), F.col("id").cast("long").alias("a"), F.col("cell").cast("long").alias("b"), none.alias("c"), "x", "y"]
    held = cut(cut(halo, "halo").join(placed, "cell").filter(mine | within).select("tile", *point), "held")
    edges, corners, most = None, None, TOLD
    while True:
        out = cut(held.repartition(tasks, "tile").groupBy("tile").applyInArrow(looked, found_schema), "tiles")
        some = out.filter("src is not null").select("src", "dst")
        edges = some if edges is None else edges.union(some)  # a part a round, of which there are few
        left = out.filter("src is null")
        if left.isEmpty():
            return edges
        at_rim, asked = left.filter("rim").select("tile"), left.filter("rim is null")
        if corners is None:
            corners = cut(hull_of(placed, tasks), "corners")
        told = at_rim.crossJoin(corners.select("id", "x", "y")).withColumn("cell", F.lit(-1)).select("tile", *point)
        told = told.union(at_rim.select("tile", F.lit(CORNER), none, none, none, F.lit(0.0), F.lit(0.0)))
        there = placed.join(asked.select("cell").distinct(), "cell", "left_semi")
        found_in = asked.repartition(tasks, "cell").groupBy("cell").cogroup(there.repartition(tasks, "cell").groupBy("cell")).applyInArrow(telling(most), of_points)
        told = told.union(cut(found_in, "told")).union(asked.select("tile", F.lit(ASKED), "a", "b", "c", F.lit(0.0), F.lit(0.0)).distinct())
        # what a tile was not told of a circle once it can be told later, then the circle is asked about anew
        before = held.filter(F.col("kind") != UNTOLD).join(left.select("tile").distinct(), "tile", "left_semi").select(*held.columns)
        held, most = cut(before.union(told), "held"), most * 2
