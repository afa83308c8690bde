"""Alignment paths as tables: ragged arrays of tie points, in either orientation and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import running_total


def oriented(paths: DataFrame) -> DataFrame:
    """``paths(src, dst, ii, jj)`` with src < dst; where ends are swapped, so are the columns."""
    flip = F.col("src") > F.col("dst")
    return paths.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.when(flip, F.col("jj")).otherwise(F.col("ii")).alias("ii"), F.when(flip, F.col("ii")).otherwise(F.col("jj")).alias("jj"))


def inject(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges with the path of their ends, found in either orientation; ``ii`` belongs to src."""
    return edges.join(oriented(paths), ["src", "dst"], "left")


def pack(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the range of rows that is theirs, and all tie points in that order: (src, dst, first, last), (place, i, j)."""
    index = running_total(paths.select("src", "dst", "ii", "jj"), [F.col("src"), F.col("dst")], F.size("ii"), "first")
    points = index.select("first", F.posexplode(F.arrays_zip("ii", "jj"))).select((F.col("first") + F.col("pos")).alias("place"), F.col("col.ii").alias("i"), F.col("col.jj").alias("j"))
    return index.select("src", "dst", "first", (F.col("first") + F.size("ii")).alias("last")), points


def unpack(index: DataFrame, points: DataFrame) -> DataFrame:
    """The inverse of ``pack``."""
    own = index.select("src", "dst", "first", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("place"))
    met = own.join(points, "place").groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("place", "i", "j"))).alias("p"))
    return met.select("src", "dst", F.transform("p", lambda x: x["i"]).alias("ii"), F.transform("p", lambda x: x["j"]).alias("jj"))


def read_tiepoints(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"src", "dst", "ij": [[i, j], ...]}`` in canonical orientation."""
    raw = spark.read.schema("src long, dst long, ij array<array<int>>").json(path)
    part = lambda k: F.transform("ij", lambda p: F.get(p, F.lit(k)))
    return oriented(raw.select("src", "dst", part(0).alias("ii"), part(1).alias("jj")))
