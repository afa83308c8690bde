"""Shifts of points by least squares over all their pairs within a radius, without a table of pairs.

Pairs are quadratic in the points of a region. A step of conjugate gradients only wants their weighted sums, so blocks of the sphere work
pairs out from their places and those around again in each step. Coincident points have the same weights to all others: what they
differ by is told from their own right sides, so there is one unknown a place. Directions are scaled by the diagonal, and
sums over coarse cells are solved at once, or what differs over a long way would take many steps to even out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import near
from ..scratch import Latest, cut, many_tasks
from . import graph, spatial

#: Coarse cells at most, and points that a task of a block has of its own about.
COARSE, OWN = 2048, 10_000
KEYS = ("kx", "ky", "kz")
NODE = "kind int, id long, other long, lat double, lon double, b double, w double, degree long"
SITE = "block long, part int, home boolean, site long, lat double, lon double, n double, w double, pull double, coarse int, x double, r double, p double, ap double"


def _packed(keys: list[Column]) -> Column:
    return sum((F.shiftleft(k.cast("long") + (1 << 20), 21 * i) for i, k in enumerate(keys)), F.lit(0).cast("long"))


def _cell(side: float) -> Column:
    return _packed([F.floor(F.col(c) / side) for c in spatial.ON_SPHERE])


def parts_of(points: DataFrame, side: float) -> DataFrame:
    """(block, parts) of each block of ``points(lat, lon)``: in how many parts its own points are taken."""
    counts = spatial.placed(points.select("lat", "lon")).groupBy(_cell(side).alias("block")).agg(F.count("*").alias("n"))
    return cut(counts.select("block", F.ceil(F.col("n") / OWN).cast("int").alias("parts")), "shift-blocks")


def dealt(points: DataFrame, parts: DataFrame, chord: float, side: float) -> DataFrame:
    """``points(lat, lon, key, ...)`` in each block of that side that they are in (``home``) or within the chord of. A block of
    many points has several ``part`` s, which share its own points by their ``key``."""
    at = spatial.placed(points)
    near_ends = [F.array_distinct(F.array(*[F.floor((F.col(c) + e) / side) for e in (-chord, 0.0, chord)])) for c in spatial.ON_SPHERE]
    at = at.withColumn("own", _cell(side))
    for k, ends in zip(KEYS, near_ends, strict=True):
        at = at.withColumn(k, F.explode(ends))
    at = at.withColumn("block", _packed([F.col(k) for k in KEYS])).join(parts, "block")
    at = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    home = (F.col("block") == F.col("own")) & (F.pmod(F.xxhash64("key"), F.col("parts")) == F.col("part"))
    return at.withColumn("home", home).drop(*KEYS, *spatial.ON_SPHERE, "own", "parts")


def coarse_side(points: DataFrame, chord: float) -> float:
    """The side of coarse cells: twice the chord, doubled until there are few of them."""
    sides = [2 * chord * 2**i for i in range(40) if i == 0 or 2 * chord * 2 ** (i - 1) < 2]
    cells = F.array(*[F.struct(F.lit(i).alias("level"), _cell(s).alias("cell")) for i, s in enumerate(sides)])
    counts = spatial.placed(points.select("lat", "lon")).select(F.explode(cells).alias("c")).groupBy("c.level").agg(F.approx_count_distinct("c.cell").alias("n"))
    few = [r["level"] for r in counts.collect() if r["n"] <= 0.9 * COARSE]  # a row a side
    return sides[min(few, default=len(sides) - 1)]


def _split(table: pa.Table) -> tuple[dict[str, np.ndarray], int]:
    """Columns with those at home first, in the order of their ids, and how many these are."""
    data = {c: table[c].to_numpy() for c in table.column_names}
    order = np.lexsort((data["key"], ~data["home"]))
    return {c: v[order] for c, v in data.items()}, int(data["home"].sum())


def _squares(weight: Callable[[np.ndarray], np.ndarray], km: np.ndarray, close: np.ndarray) -> np.ndarray:
    w2 = np.square(weight(km))
    w2 *= close
    return w2


def radius_shifts(points: DataFrame, radius_km: float, weight: Callable[[np.ndarray], np.ndarray], offset: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: Callable[[], DataFrame], damping: float = 0.01, pull: float = 1.0, tol: float = 1e-6, most: int = 500, small: int = graph.SMALL_COMPONENT) -> DataFrame:
    """(id, shift): ``kernels.solve_shifts`` of the pairs of ``points(id, lat, lon)`` at most ``radius_km`` apart, ``weight`` a function of
    their distances and ``offset`` one of their ids. Where there are ``small`` or fewer, or ids repeat, ``pairs`` gives them as edges.
    """
    from .kernels import solve_shifts

    spark, chord = points.sparkSession, spatial.chord_of(radius_km)
    limits = F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan(F.col("lat") + F.col("lon"))
    whole = cut(points.select(F.col("id").cast("long").alias("id"), "lat", "lon").filter(limits).repartition(many_tasks(spark)), "shift-points")
    size = whole.agg(F.count("*"), F.count_distinct("id")).first()
    if size[0] != size[1]:
        return solve_shifts(pairs(), damping, pull)
    coarse, side = coarse_side(whole, chord), max(6 * chord, 2e-6)

    def told(table: pa.Table) -> pa.Table:
        """What each point at home has to know of its pairs, and which points hang together here."""
        data, own = _split(table)
        if not own:
            return pa.table({c: [] for c in names}, schema)
        ids, lat, lon = data["key"], data["lat"], data["lon"]
        b, w, degree = np.zeros(own), np.zeros(own), np.zeros(own, np.int64)
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        up = np.arange(len(ids))
        cells, cell = np.unique(data["coarse"], return_inverse=True)
        sums = np.zeros((len(cells), len(cells)))
        for rows, columns, km, close in near.meetings(lat, lon, own, radius_km, chord):
            w2 = _squares(weight, km, close)
            mine, theirs = ids[rows][:, None], ids[columns][None]
            later = mine > theirs
            off = offset(np.where(later, theirs, mine), np.where(later, mine, theirs))
            b[rows] += (w2 * np.where(mine == theirs, 0.0, np.where(later, off, -off))).sum(axis=1)
            w[rows] += w2.sum(axis=1)
            degree[rows] += close.sum(axis=1) - 1
            here, which = np.unique(cell[columns], return_inverse=True)
            of_cells = np.zeros((len(rows), len(here)))
            for k in range(len(here)):
                of_cells[:, k] = w2[:, which == k].sum(axis=1)
            np.add.at(sums, (cell[rows][:, None], here[None]), of_cells)
            if close[:, np.flatnonzero(columns == rows[0])[0]].all():  # all of them near to one
                near.join(up, rank[np.concatenate([rows, columns[close.any(axis=0)]])])
            else:
                for i, row in enumerate(close):
                    near.join(up, rank[np.append(columns[row], rows[i])])
        root = ids[by_id][near.roots(up, rank)]
        p, q = np.nonzero(sums)
        n, m = len(ids) - own, len(p)
        fill = lambda x, before, after: np.concatenate([np.zeros(before, x.dtype), x, np.zeros(after, x.dtype)])
        return pa.table({
            "kind": np.repeat(np.array([0, 1, 2], np.int32), [own, n, m]), "id": np.concatenate([ids, cells[p]]), "other": np.concatenate([root, cells[q]]),
            "lat": fill(lat[:own], 0, n + m), "lon": fill(lon[:own], 0, n + m), "b": np.concatenate([b, np.zeros(n), sums[p, q]]), "w": fill(w, 0, n + m), "degree": fill(degree, 0, n + m),
        }, schema)

    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in NODE.split(", ")])
    tasks = 4 * many_tasks(spark)  # blocks are few and uneven
    around = dealt(whole.withColumnRenamed("id", "key"), parts_of(whole, side), chord, side)
    around = spatial.placed(around).withColumn("coarse", _cell(coarse)).select("block", "part", "home", "key", "lat", "lon", "coarse")
    found = cut(around.repartition(tasks, "block", "part").groupBy("block", "part").applyInArrow(told, NODE), "shift-sums")
    nodes = found.filter("kind = 0 and degree > 0")
    if (nodes.agg(F.sum("degree")).first()[0] or 0) <= 2 * small:
        return solve_shifts(pairs(), damping, pull)

    rim = found.filter("kind = 1").select("id", F.col("other").alias("b")).join(nodes.select("id", F.col("other").alias("a")), "id")
    label = graph.components(rim.select(F.col("a").alias("src"), F.col("b").alias("dst")).filter("a <> b").distinct())
    labelled = nodes.join(label.withColumnRenamed("id", "other"), "other", "left").withColumn("component", F.coalesce("component", "other"))
    anchors = labelled.groupBy("component").agg(F.max_by("id", F.struct(F.col("degree"), -F.col("id"))).alias("id")).select("id", F.lit(float(pull)).alias("pull"))
    held = nodes.join(anchors, "id", "left").withColumn("pull", F.coalesce("pull", F.lit(0.0)))
    # an anchor is a site of its own
    sites = held.groupBy("lat", "lon", F.when(F.col("pull") > 0, F.col("id")).alias("anchor")).agg(F.min("id").alias("site"), F.count("*").cast("double").alias("n"), F.avg("b").alias("mean"), F.first("w").alias("w"), F.max("pull").alias("pull"))
    sites = cut(spatial.placed(sites).withColumn("cell", _cell(coarse)), "shift-sites")

    # the coarse system: a row and a column for each coarse cell
    inside = sites.groupBy("cell").agg(F.sum(F.col("n") * (F.col("w") + damping) + F.col("pull")).alias("d"), F.sum(F.col("n") * F.col("mean")).alias("r")).orderBy("cell").collect()  # COARSE about
    at = {r["cell"]: i for i, r in enumerate(inside)}
    full = np.diag([r["d"] for r in inside])
    for r in found.filter("kind = 2").groupBy("id", "other").agg(F.sum("b").alias("v")).collect():  # coarse cells next to each other
        if r["id"] in at and r["other"] in at:
            full[at[r["id"]], at[r["other"]]] -= r["v"]
    inverse = np.linalg.pinv((full + full.T) / 2, hermitian=True)
    numbered = F.broadcast(spark.createDataFrame(list(at.items()), "cell long, coarse int"))
    own_weight = float(weight(np.zeros(1))[0]) ** 2
    diagonal = F.col("n") * (F.col("w") + damping) + F.col("pull") - F.col("n") * F.col("n") * own_weight

    start = sites.join(numbered, "cell").select("site", "lat", "lon", "n", "w", "pull", "coarse", F.lit(0.0).alias("x"), (F.col("n") * F.col("mean")).alias("r"), F.lit(0.0).alias("p"), F.lit(0.0).alias("ap"))
    carried = [c.split()[0] for c in SITE.split(", ")]
    site_schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SITE.split(", ")])

    def applied(table: pa.Table) -> pa.Table:
        """The normal equations' product with the directions, for the sites at home."""
        data, own = _split(table.rename_columns(["key" if c == "site" else c for c in table.column_names]))
        data["site"] = data.pop("key")
        sent = data["n"] * data["p"]
        got = np.zeros(own)
        for rows, columns, km, close in near.meetings(data["lat"], data["lon"], own, radius_km, chord) if own else ():
            got[rows] += _squares(weight, km, close) @ sent[columns]
        here = {c: v[:own] for c, v in data.items()}
        here["ap"] = (here["n"] * (here["w"] + damping) + here["pull"]) * here["p"] - here["n"] * got
        return pa.table({c: here[c] for c in carried}, site_schema)

    parts = parts_of(sites, side)
    latest, state, a, beta = Latest("shift-state"), start, 0.0, 0.0
    rc = np.array([r["r"] for r in inside])
    zc, goal = inverse @ rc, None
    for _ in range(most):
        told_coarse = F.broadcast(spark.createDataFrame(list(enumerate(zc.tolist())), "coarse int, zc double"))
        state = state.withColumns({"x": F.col("x") + a * F.col("p"), "r": F.col("r") - a * F.col("ap")}).join(told_coarse, "coarse")
        state = state.withColumn("p", F.col("r") / diagonal + F.col("zc") + beta * F.col("p")).drop("zc", "ap")
        there = dealt(state.withColumnRenamed("site", "key"), parts, chord, side).withColumnRenamed("key", "site").withColumn("ap", F.lit(0.0))
        there = there.select(*[F.when(F.col("home"), F.col(c)).otherwise(0.0).alias(c) if c in ("w", "pull", "x", "r") else F.col(c) for c in carried])
        step = latest(there.repartition(tasks, "block", "part").groupBy("block", "part").applyInArrow(applied, SITE))
        r, p, ap = F.col("r"), F.col("p"), F.col("ap")
        terms = [r, ap, r * r / F.col("n"), r * r / diagonal, r * ap / diagonal, ap * ap / diagonal, p * ap, r * ap / F.col("n"), ap * ap / F.col("n")]
        sums = step.groupBy("coarse").agg(*[F.sum(t).alias(f"t{i}") for i, t in enumerate(terms)]).collect()  # COARSE about
        by_cell = np.zeros((len(at), len(terms)))
        for row in sums:
            by_cell[row["coarse"]] = row[1:]
        total = by_cell.sum(axis=0)
        rc, rz = by_cell[:, 0], total[3] + by_cell[:, 0] @ inverse @ by_cell[:, 0]
        goal = tol * tol * total[2] if goal is None else goal
        a = rz / total[6] if total[6] else 0.0
        rc = rc - a * by_cell[:, 1]
        zc = inverse @ rc
        beta = (total[3] - 2 * a * total[4] + a * a * total[5] + rc @ zc) / rz if rz else 0.0
        left = total[2] - 2 * a * total[7] + a * a * total[8]
        state = step.drop("block", "part", "home")
        if left <= goal:
            break
    else:
        raise ArithmeticError(f"no convergence in {most} steps")
    solved = state.select("site", "n", (F.col("x") + a * F.col("p")).alias("x"))
    return _told_apart(held, sites, solved, damping)


def _told_apart(held: DataFrame, sites: DataFrame, solved: DataFrame, damping: float) -> DataFrame:
    """The shift of each point: its site's, and what its own right side differs by."""
    free = sites.filter("pull = 0").join(solved, "site").select("lat", "lon", "x", "mean")
    coincident = held.filter("pull = 0").join(free, ["lat", "lon"]).select("id", (F.col("x") + (F.col("b") - F.col("mean")) / (F.col("w") + damping)).alias("shift"))
    return coincident.union(solved.join(sites.filter("pull > 0").select("site"), "site", "left_semi").select(F.col("site").alias("id"), F.col("x").alias("shift")))
