"""Small bins merged in the order of their sizes, and quotas of cells, as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from . import spatial
from .order import numbered

#: A time after all others.
_NEVER = 2**63 - 1
_EARTH_KM = 20_040.0


def _lives(bins: DataFrame, arrivals: DataFrame, least: int) -> DataFrame:
    """(id, n, lat, lon, from_n, from_id, to_n, to_id): what each bin is between its arrivals, ``arrivals(id, at_n, at_id, lat, lon)``.

    A bin's rows are gone through in the order of time, one by one, so a bin that takes many others in is never gathered.
    """
    own = bins.select("id", F.lit(-1).cast("long").alias("at_n"), F.lit(None).cast(dict(bins.dtypes)["id"]).alias("at_id"), "lat", "lon", F.col("n").alias("m"))
    rows = own.unionByName(arrivals.withColumn("m", F.col("at_n")))
    kind = dict(bins.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # id, n, lat, lon, from_n, from_id

        def end(out: list, n: int | None = None, at=None) -> None:
            if now is not None:
                dies = now[1] < least
                out.append((*now, *((n, at) if n is not None else (now[1], now[0]) if dies else (_NEVER, None))))

        for batch in batches:
            out: list[tuple] = []
            for id_, n, at, lat, lon, m in zip(*(batch.column(c).to_pylist() for c in ("id", "at_n", "at_id", "lat", "lon", "m")), strict=True):
                if n < 0:
                    end(out)
                    now = [id_, m, lat, lon, -1, None]
                elif now[1] >= least or (n, at) < (now[1], id_):  # one that comes after the bin went itself was told of too early
                    end(out, n, at)
                    total = m + now[1]
                    now = [id_, total, (m * lat + now[1] * now[2]) / total, (m * lon + now[1] * now[3]) / total, n, at]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        out = []
        end(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    name = pa.string() if kind == "string" else pa.int64()
    types = [name, pa.int64(), pa.float64(), pa.float64(), pa.int64(), name, pa.int64(), name]
    names = ["id", "n", "lat", "lon", "from_n", "from_id", "to_n", "to_id"]
    ordered = rows.repartition("id").sortWithinPartitions("id", "at_n", "at_id")
    return ordered.mapInArrow(run, f"id {kind}, n long, lat double, lon double, from_n long, from_id {kind}, to_n long, to_id {kind}")


def _before(n: str, i: str, at_n: str, at_i: str, same: bool) -> Column:
    """Whether the time (n, i) is before (at_n, at_i), or the same."""
    ids = F.col(i) <= F.col(at_i) if same else F.col(i) < F.col(at_i)
    return (F.col(n) < F.col(at_n)) | ((F.col(n) == F.col(at_n)) & F.coalesce(ids, F.lit(False)))


def _targets(lives: DataFrame, start_km: float) -> DataFrame | None:
    """(id, n, lat, lon, target): the nearest bin at the time that each small one goes, ties to the smaller id; nothing if none goes."""
    state = F.struct("id", "from_n", "from_id", "to_n", "to_id").alias("id")
    states = lives.select(state, "lat", "lon")
    going = (F.col("to_n") == F.col("n")) & (F.col("to_id") == F.col("id"))
    last, left = lives.agg(F.max(F.struct("to_n", "to_id")), F.count_if(going)).first()
    rest = lives.filter(going).select(F.struct("id", "n", "lat", "lon").alias("id"), "lat", "lon")
    if last and last["to_id"] is not None:  # all go, and to the last one nothing is left
        rest, left = rest.filter(F.col("id.id") != last["to_id"]), left - 1
    done, radius = None, start_km
    while left:
        met = spatial.within(rest, states, radius).select("src", "dist_km", F.col("src.n").alias("at_n"), F.col("src.id").alias("at_id"), F.col("dst.id").alias("other"), *[F.col(f"dst.{c}").alias(c) for c in ("from_n", "from_id", "to_n", "to_id")])
        alive = met.filter((F.col("other") != F.col("at_id")) & _before("from_n", "from_id", "at_n", "at_id", False) & _before("at_n", "at_id", "to_n", "to_id", True))
        found = cut(alive.groupBy("src").agg(F.min(F.struct("dist_km", "other")).alias("best")), "targets")
        done = found if done is None else done.unionByName(found)
        left = left - found.count() if radius < _EARTH_KM else 0
        if left:
            rest = cut(rest.join(found.select(F.col("src").alias("id")), "id", "left_anti"), "looking")
            radius *= 4
    return None if done is None else done.select("src.*", F.col("best.other").alias("target"))


def merged(bins: DataFrame, least: int, start_km: float) -> DataFrame:
    """(id, bin_id) of ``bins(id, n, lat, lon)``: while there are bins of fewer than ``least``, the smallest one (of these that of the
    smallest id) goes to the nearest one, whose place becomes the mean of both by numbers.

    A bin goes when its turn comes, and turns are in the order of (number, id), as numbers only grow. All bins work out at once
    what they are between arrivals, when they go and where to, from what was said last about arrivals, until nobody says anything
    new. What is said about a turn depends on earlier turns alone, so this is the answer of going one by one; it takes as many
    rounds as the longest chain of bins that wait for each other, wherever they lie. Nearest ones are looked for by a distance
    join that starts at ``start_km``.

    Bins without a place stay as they are, as does the last one left. Ids are distinct, strings or integers.
    """
    bins = cut(bins.select("id", F.col("n").cast("long").alias("n"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), "bins")
    placed = bins.filter("id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    arrivals = placed.limit(0).select("id", F.col("n").alias("at_n"), F.col("id").alias("at_id"), "lat", "lon")
    seen = None
    while True:
        lives = cut(_lives(placed, arrivals, least), "lives")
        gone = _targets(lives, start_km)
        if gone is None:
            return bins.select("id", F.col("id").alias("bin_id"))
        mark = gone.agg(F.bit_xor(F.xxhash64("id", "n", "lat", "lon", "target")), F.count("*")).first()
        if mark == seen:
            break
        seen = mark
        arrivals = gone.select(F.col("target").alias("id"), F.col("n").alias("at_n"), F.col("id").alias("at_id"), "lat", "lon")
    # where each one ends: half as many steps are left each time
    into = cut(bins.join(gone.select("id", "target"), "id", "left").select("id", F.coalesce("target", "id").alias("bin_id")), "into")
    while True:
        further = into.select(F.col("id").alias("bin_id"), F.col("bin_id").alias("next")).filter("bin_id <> next")
        ahead = cut(into.join(further, "bin_id", "left").select("id", F.coalesce("next", "bin_id").alias("bin_id"), F.col("next").isNotNull().alias("moved")), "into")
        into = ahead.select("id", "bin_id")
        if ahead.filter("moved").isEmpty():
            return into


def quotas(cells: DataFrame, total: int, mode: str = "equal", least: int = 1) -> DataFrame:
    """(cell_id, quota): how many to take from each of ``cells(cell_id, n)``: equal shares or, as ``mode``, proportional ones of at
    least ``least``, never more than a cell has, in sum ``total`` if there are as many.

    What shares leave over goes round: one to each cell that has room, those with most room first (then by id), again and again; what
    they take too much goes back the same way, those with most first. Full turns are worked out from the numbers of cells with the
    same room (there are less than the root of twice all members), and only the last turn needs the cells in order.
    """
    if mode not in ("equal", "proportional"):
        raise ValueError(f"no mode of quotas: {mode}")
    cells = cells.select("cell_id", F.col("n").cast("long").alias("n"))
    count, members = cells.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not count:
        return cells.select("cell_id", F.col("n").cast("int").alias("quota"))
    total = max(0, total)
    share = F.lit(-(-total // count)) if mode == "equal" else F.greatest(F.lit(least), F.bround(F.lit(total) * F.col("n") / F.lit(members)))
    cells = cut(cells.withColumn("take", F.least("n", share.cast("long"))), "shares")
    gap = min(total, members) - cells.agg(F.sum("take")).first()[0]
    cells = cells.withColumn("room", F.col("n") - F.col("take") if gap > 0 else F.col("take"))
    same = cells.groupBy("room").agg(F.count("*").alias("c"))
    upward = Window.orderBy("room").rowsBetween(Window.unboundedPreceding, -1)  # of rooms, not of cells
    steps = same.withColumn("filled", F.coalesce(F.sum(F.col("room") * F.col("c")).over(upward), F.lit(0))).withColumn("above", F.lit(count) - F.coalesce(F.sum("c").over(upward), F.lit(0)))
    first = steps.filter(F.col("filled") + F.col("room") * F.col("above") > abs(gap)).orderBy("room").select("filled", "above").first()
    turns = (abs(gap) - first["filled"]) // first["above"] if first else abs(gap)  # all rooms are filled else
    left = abs(gap) - first["filled"] - turns * first["above"] if first else 0
    more = F.least(F.col("room"), F.lit(turns))
    if left:
        cells = numbered(cells, [-F.col("room"), F.col("cell_id")], "place")
        more = more + F.when(F.col("place") <= left, 1).otherwise(0)
    return cells.select("cell_id", (F.col("take") + (more if gap > 0 else -more)).cast("int").alias("quota"))
