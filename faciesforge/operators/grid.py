"""Grid binning of wells ``(well_id, lat, lon)`` on an equirectangular plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..scratch import cut
from .order import numbered


def assign(wells: DataFrame, cell_km: float, lat0: float) -> DataFrame:
    """``wells`` with plane coordinates and the cell (ix, iy, cell_id) counted from the plane's origin."""
    x, y = geo.equirect_xy(F.col("lat"), F.col("lon"), lat0)
    out = wells.withColumn("x", x).withColumn("y", y)
    ix, iy = geo.grid_index(F.col("x"), 0.0, cell_km), geo.grid_index(F.col("y"), 0.0, cell_km)
    return out.withColumn("ix", ix).withColumn("iy", iy).withColumn("cell_id", geo.cell_id(F.col("ix"), F.col("iy")))


def bins_meta(cells: DataFrame) -> DataFrame:
    """Wells, centroid and largest distance from it, for each cell."""
    centre = cells.groupBy("cell_id").agg(F.count("*").alias("n_wells"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    far = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return cells.join(centre, "cell_id").groupBy("cell_id").agg(F.first("n_wells").alias("n_wells"), F.first("clat").alias("centroid_lat"), F.first("clon").alias("centroid_lon"), F.max(far).alias("radius_km"))


def neighbourhood(radius: int) -> Column:
    """Array of (dx, dy) with Chebyshev distance up to ``radius``."""
    side = range(-radius, radius + 1)
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(max(abs(dx), abs(dy))).alias("r")) for dx in side for dy in side])


def adaptive_kernel(cells: DataFrame, r_min: int, r_max: int, least: int) -> DataFrame:
    """For each cell the smallest radius whose square of cells holds ``least`` wells (the largest one if none does), and that count.

    Only counts of cells move: a cell's count is sent to the cells around it.
    """
    counts = cells.groupBy("ix", "iy", "cell_id").agg(F.count("*").alias("n"))
    sent = counts.select("n", "ix", "iy", F.explode(neighbourhood(r_max)).alias("d")).select((F.col("ix") + F.col("d.dx")).alias("ix"), (F.col("iy") + F.col("d.dy")).alias("iy"), F.col("d.r").alias("r"), "n")
    got = counts.select("ix", "iy", "cell_id").join(sent, ["ix", "iy"])
    sums = got.groupBy("cell_id").agg(*[F.sum(F.when(F.col("r") <= k, F.col("n"))).alias(f"n{k}") for k in range(r_min, r_max + 1)])
    radius = F.coalesce(*[F.when(F.col(f"n{k}") >= least, F.lit(k)) for k in range(r_min, r_max + 1)], F.lit(r_max))
    held = F.coalesce(*[F.when(radius == k, F.col(f"n{k}")) for k in range(r_min, r_max + 1)])
    return sums.select("cell_id", radius.alias("radius"), held.alias("n_wells"))


def occupancy(wells: DataFrame, sizes: list[float], lat0: float) -> DataFrame:
    """Cells and mean wells in an occupied cell for each candidate cell size, in one pass over the wells."""
    x, y = geo.equirect_xy(F.col("lat"), F.col("lon"), lat0)
    each = wells.select(x.alias("x"), y.alias("y"), F.explode(F.array(*[F.lit(s) for s in sizes])).alias("cell_km"))
    cells = each.groupBy("cell_km", F.floor(F.col("x") / F.col("cell_km")).alias("ix"), F.floor(F.col("y") / F.col("cell_km")).alias("iy")).count()
    return cells.groupBy("cell_km").agg(F.count("*").alias("n_cells"), F.max("count").alias("largest"))


def choose_cell_size(candidates: DataFrame, target: int) -> DataFrame:
    """Of the candidates whose largest cell holds at most the target, the one nearest to it (the coarser on a tie); else the finest."""
    fits = F.col("largest") <= target
    order = [fits.desc(), F.when(fits, F.lit(target) - F.col("largest")).otherwise(F.col("largest")).asc(), F.desc("cell_km")]
    return candidates.orderBy(*order).limit(1)  # the choice is the feature


def grid_spec(wells: DataFrame, cell_km: float | None = None, target: int | None = None, min_size: int = 1, pad_frac: float = 0.01, steps: int = 30) -> dict[str, float]:
    """A local plane's grid over the wells: middle, lowest x and y, cell size, rows and columns.

    Without a size it is searched for: coarser by a quarter while there are more occupied cells than ``target`` or one of fewer than
    ``min_size`` wells, finer by 0.85 else; of ``steps`` sizes the best counts. A step looks at counts of cells only.
    """
    good = wells.select("lat", "lon").filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    n, lat0, lon0 = good.agg(F.count("*"), F.avg("lat"), F.avg("lon")).first()
    if n < 2:
        raise ValueError("too few wells for a grid")
    x, y = geo.centred_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    plane = cut(good.select(x.alias("x"), y.alias("y")), "plane")
    x0, x1, y0, y1 = plane.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if cell_km is None:
        if target is None:
            raise ValueError("a size of cells or a number of them")
        size = min(2000.0, max(0.25, (max(1e-6, (x1 - x0) * (y1 - y0)) / max(1, target)) ** 0.5))
        cell_km, best = size, float("inf")
        for _ in range(steps):
            cells = plane.groupBy(F.floor((F.col("x") - x0) / size).alias("i"), F.floor((F.col("y") - y0) / size).alias("j")).count()
            occupied, least = cells.agg(F.count("*"), F.min("count")).first()
            miss = abs(occupied - target) + (10_000 + 100 * (min_size - least) if least < min_size else 0)
            if miss < best:
                cell_km, best = size, miss
            size = min(2000.0, max(0.25, size * (1.25 if least < min_size or occupied > target else 0.85)))
    if not cell_km > 0:
        raise ValueError(f"no size of cells: {cell_km}")
    px, py = pad_frac * max(1e-9, x1 - x0), pad_frac * max(1e-9, y1 - y0)
    count = lambda a, b: max(1, -int(-(b - a) // cell_km))
    return {"lat0": lat0, "lon0": lon0, "x_min_km": x0 - px, "y_min_km": y0 - py, "cell_km": cell_km, "n_cols": count(x0 - px, x1 + px), "n_rows": count(y0 - py, y1 + py)}


def tiles_with_halo(wells: DataFrame, tile_km: float, halo_km: float, lat0: float) -> DataFrame:
    """(tile ix, iy, well_id, core): each well in its own tile and in those whose halo holds it (closed bounds)."""
    x, y = geo.equirect_xy(F.col("lat"), F.col("lon"), lat0)
    w = wells.select("well_id", x.alias("x"), y.alias("y"))
    reach = int(-(-halo_km // tile_km))
    w = w.withColumn("cx", F.floor(F.col("x") / tile_km)).withColumn("cy", F.floor(F.col("y") / tile_km))
    near = w.withColumn("d", F.explode(neighbourhood(reach))).withColumn("tx", F.col("cx") + F.col("d.dx")).withColumn("ty", F.col("cy") + F.col("d.dy"))
    inside = lambda c, t: (F.col(c) >= F.col(t) * tile_km - halo_km) & (F.col(c) <= (F.col(t) + 1) * tile_km + halo_km)
    core = (F.col("tx") == F.col("cx")) & (F.col("ty") == F.col("cy"))
    all_tiles = near.filter(inside("x", "tx") & inside("y", "ty")).select("tx", "ty", "well_id", core.alias("core"))
    own = w.select(F.col("cx").alias("tx"), F.col("cy").alias("ty")).distinct()
    return all_tiles.join(own, ["tx", "ty"], "left_semi")


def tile_adjacency(members: DataFrame) -> DataFrame:
    """Pairs of tiles that share an edge, with the number of wells in both."""
    tile = members.select("tx", "ty", "well_id")
    sides = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    out = tile.withColumn("s", F.explode(sides)).select("tx", "ty", "well_id", (F.col("tx") + F.col("s.dx")).alias("ux"), (F.col("ty") + F.col("s.dy")).alias("uy"))
    other = tile.select(F.col("tx").alias("ux"), F.col("ty").alias("uy"), "well_id")
    return out.join(other, ["ux", "uy", "well_id"]).groupBy("tx", "ty", "ux", "uy").agg(F.count("*").alias("shared"))


def merge_small_bins(bins: list[tuple[str, int, float, float]], least: int) -> dict[str, str]:
    """Bin -> bin after merging: the smallest bin joins the nearest centroid until all hold ``least``.

    The rule as it is said, for a few bins at hand; ``merging.merged`` gives the same for tables.
    """
    import math

    live = {b: (n, lat, lon) for b, n, lat, lon in bins}
    into = {b: b for b in live}

    def far(p: tuple, q: tuple) -> float:
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(min(1.0, math.sqrt(a)))

    while len(live) > 1:
        small = min(live, key=lambda b: (live[b][0], b))
        if live[small][0] >= least:
            break
        n, lat, lon = live.pop(small)
        near = min(live, key=lambda b: (far((n, lat, lon), live[b]), b))
        m, mlat, mlon = live[near]
        live[near] = (n + m, (n * lat + m * mlat) / (n + m), (n * lon + m * mlon) / (n + m))
        into = {b: near if t == small else t for b, t in into.items()}
    return into


def quotas(caps: dict[str, int], total: int, mode: str = "equal", least: int = 1) -> dict[str, int]:
    """How many to take from each cell: equal or proportional shares, never above a cell's size, summing to ``total`` where that is possible.

    The rule as it is said, for a few cells at hand; ``merging.quotas`` gives the same for tables.
    """
    n, cells = sum(caps.values()), sorted(caps)
    share = lambda c: -(-total // len(cells)) if mode == "equal" else max(least, round(total * caps[c] / n))
    take = {c: min(caps[c], share(c)) for c in cells}
    while (gap := min(total, n) - sum(take.values())) != 0:
        if gap > 0:
            free = sorted((c for c in cells if take[c] < caps[c]), key=lambda c: (-(caps[c] - take[c]), c))
        else:
            free = sorted((c for c in cells if take[c] > 0), key=lambda c: (-take[c], c))
        for c in free[: abs(gap)]:
            take[c] += 1 if gap > 0 else -1
    return take


def west_to_east(points: DataFrame) -> DataFrame:
    """``station`` by (lon, lat), missing coordinates as 0."""
    k = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return numbered(points, [k("lon"), k("lat"), F.col("well_id")], "station")


def extent(cells: DataFrame) -> DataFrame:
    """Lowest and highest cell indices, from columns or, where they are missing, from the ids."""
    gx, gy = geo.parse_cell_id(F.col("cell_id"))
    ix, iy = (F.coalesce(F.col("ix"), gx), F.coalesce(F.col("iy"), gy)) if "ix" in cells.columns else (gx, gy)
    return cells.agg(F.min(ix).alias("ix_min"), F.max(ix).alias("ix_max"), F.min(iy).alias("iy_min"), F.max(iy).alias("iy_max"))


def rings(cells: DataFrame, cell_km: float, lat0: float) -> DataFrame:
    """The corners of each cell, counter-clockwise and closed: ``(cell_id, corner, lat, lon)``."""
    corner = F.posexplode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])).alias("corner", "c")
    out = cells.select("cell_id", "ix", "iy").distinct().select("cell_id", "ix", "iy", corner)
    lat, lon = geo.inverse_equirect((F.col("ix") + F.col("c.dx")) * cell_km, (F.col("iy") + F.col("c.dy")) * cell_km, lat0)
    return out.select("cell_id", F.col("corner").cast("long").alias("corner"), lat.alias("lat"), lon.alias("lon"))


def evenly_spaced(points: DataFrame, n: int) -> DataFrame:
    """``n`` points evenly spaced in the order (lon, lat, id), both ends among them."""
    placed = west_to_east(points)
    total = F.broadcast(points.agg(F.count("*").alias("total")))  # one row
    at = F.expr(f"transform(sequence(0, {n - 1}), k -> cast(floor(k * (total - 1) / {max(1, n - 1)}) as bigint) + 1)")
    return placed.crossJoin(total).filter(F.array_contains(at, F.col("station").cast("long")) | (F.col("total") <= n)).drop("total")


def hashed_sample(rows: DataFrame, key: str, by: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group by a seeded hash of their key: the same rows in any order and on any cluster."""
    draw = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)))
    return rows.withColumn("draw", draw).filter(F.col("draw") <= n)


def raster(cells: DataFrame, value: str) -> DataFrame:
    """One row for each grid row, ``values`` an array over all columns of the extent with nulls for empty cells."""
    e = F.broadcast(extent(cells))  # one row
    rows = cells.groupBy("iy").agg(F.map_from_entries(F.collect_list(F.struct("ix", value))).alias("m"))
    return rows.crossJoin(e).select("iy", F.transform(F.sequence("ix_min", "ix_max"), lambda k: F.try_element_at(F.col("m"), k)).alias("values"))
