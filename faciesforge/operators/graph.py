"""Graph operators over edge tables ``(src, dst, ...)`` with src < dst.

Ranking, thresholds, set operations, components and spanning forests are joins and
aggregates. Steps whose result depends on the order in which edges are taken (degree
pruning, greedy extras, breadth-first shifts) run as a kernel over one connected component
at a time, so that components are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.greedy import Sets
from ..scratch import cut, scratch_path
from .order import numbered

#: Edges that are few enough for one task.
SMALL_EDGES = 200_000
#: Edges of a component that one task works on where there is another way for larger ones.
SMALL_COMPONENT = 2_000_000


def canonical(edges: DataFrame) -> DataFrame:
    """Smaller id first, self loops dropped, of repeated edges the least distance."""
    out = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "dist_km").filter("src <> dst")
    return out.groupBy("src", "dst").agg(F.min("dist_km").alias("dist_km"))


def union_with_flags(first: DataFrame, knn: DataFrame, name: str = "delaunay") -> DataFrame:
    """Edges of either kind, marked ``both``, by the name of the first kind, or ``knn``."""
    each = first.select("src", "dst", F.lit(1).alias("d"), F.lit(0).alias("k")).union(knn.select("src", "dst", F.lit(0).alias("d"), F.lit(1).alias("k")))
    out = each.groupBy("src", "dst").agg(F.max("d").alias("d"), F.max("k").alias("k"))
    return out.select("src", "dst", F.when((F.col("d") == 1) & (F.col("k") == 1), "both").when(F.col("d") == 1, name).otherwise("knn").alias("edge_type"))


def edge_types(pairs: DataFrame, name: str) -> DataFrame:
    """``union_with_flags`` of ``pairs(src, dst, near, knn)`` that know of both kinds already."""
    return pairs.select("src", "dst", F.when(F.col("near") & F.col("knn"), "both").when(F.col("near"), name).otherwise("knn").alias("edge_type"))


def sides(pairs: DataFrame) -> DataFrame:
    """``difference`` of ``pairs(src, dst, near, knn)`` that know of both kinds already."""
    return pairs.filter(F.col("near") != F.col("knn")).select("src", "dst", F.when(F.col("near"), "missing").otherwise("extra").alias("side"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges in one set only, with the side that has them."""
    key = ["src", "dst"]
    left = a.select(*key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return left.union(b.select(*key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def threshold(edges: DataFrame, least: float) -> DataFrame:
    return edges.filter(F.col("sim") >= least)


def topk_per_node(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the ``k`` most similar of either endpoint, ties to the smaller neighbour."""
    ends = edges.select("src", "dst", "sim", F.explode(F.array(F.struct(F.col("src").alias("me"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("me"), F.col("src").alias("other")))).alias("e"))
    rank = F.row_number().over(Window.partitionBy("e.me").orderBy(F.desc("sim"), "e.other"))
    return ends.withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "dst", "sim").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each endpoint reaches. Large-star and small-star steps on tables."""
    stars, mark = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct(), "stars"), None
    while True:
        seen = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark or not seen[0]:
            roots = stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
        mark = seen
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        x = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")
        stars = cut(large.join(least, "a").select(x).select("x.a", "x.b").filter("a <> b").distinct(), "stars")


def anchors(edges: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(component, anchor): the node of highest degree of each component, the smallest id on a tie; ``label(id, component)`` if it is known."""
    best = F.max_by("id", F.struct(F.col("degree"), -F.col("id")))
    return (components(edges) if label is None else label).join(degrees(edges), "id").groupBy("component").agg(best.alias("anchor"))


def spanning_forest(edges: DataFrame, small: int = SMALL_EDGES, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """The maximum spanning forest by ``sim``, ties to the smaller (src, dst).

    Rounds in which each component takes its best edge out; the number of components at least
    halves, so a graph of n nodes needs at most log2 n rounds. Components are contracted to
    their labels as they grow, and once ``small`` edges or fewer are left between them, the
    rest is decided in one place. ``ends`` name the components that edges lead between already.
    """
    spark = edges.sparkSession
    rest = cut(edges.select("src", "dst", "sim", F.col(ends[0]).alias("cs"), F.col(ends[1]).alias("cd")).filter("cs <> cd"), "forest-rest")
    taken = [edges.select("src", "dst", "sim").limit(0)]
    while (left := rest.count()) > small:
        best = F.max_by(F.struct("src", "dst", "sim", "cs", "cd"), F.struct("sim", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d")))
        ends = rest.select("src", "dst", "sim", "cs", "cd", F.explode(F.array("cs", "cd")).alias("c"))
        picked = cut(ends.groupBy("c").agg(best.alias("e")).select("e.*").distinct(), "forest-picked")
        taken.append(picked.select("src", "dst", "sim"))
        label = cut(components(picked.select(F.col("cs").alias("src"), F.col("cd").alias("dst"))), "forest-labels")
        a, b = label.toDF("cs", "la"), label.toDF("cd", "lb")
        rest = cut(rest.join(a, "cs", "left").join(b, "cd", "left").select("src", "dst", "sim", F.coalesce("la", "cs").alias("cs"), F.coalesce("lb", "cd").alias("cd")).filter("cs <> cd"), "forest-rest")
    if left:
        last = rest.toPandas().sort_values(["sim", "src", "dst"], ascending=[False, True, True])  # ``small`` rows at most
        sets = Sets()
        last = last[[sets.join(s, d) for s, d in last[["cs", "cd"]].itertuples(index=False)]]
        taken.append(spark.createDataFrame(last[["src", "dst", "sim"]], taken[0].schema))
    return reduce(DataFrame.union, taken)


def per_component(edges: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, large: Callable[[DataFrame], DataFrame] | None = None, small: int = SMALL_COMPONENT) -> DataFrame:
    """``kernel`` on the edges of each connected component.

    Where there is a way for ``large`` components too, those of more than ``small`` edges go that way: it gets their
    edges with their ``component`` and works by joins, so that no task holds a component of any size.
    """
    label = components(edges).select(F.col("id").alias("src"), "component")
    labelled = edges.join(label, "src")
    at_once = lambda df: df.groupBy("component").applyInPandas(lambda pdf: kernel(pdf.drop(columns="component").sort_values(["src", "dst"], ignore_index=True)), schema)
    if large is None:
        return at_once(labelled)
    labelled = cut(labelled, "labelled")
    big = cut(labelled.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("component"), "large-components")
    if big.isEmpty():
        return at_once(labelled)
    return at_once(labelled.join(big, "component", "left_anti")).union(large(labelled.join(big, "component", "left_semi")))


def both_ways(edges: DataFrame, value: Column, back: Column) -> DataFrame:
    """(u, v, x): each edge from either end, written."""
    there = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), value.alias("x"))
    return cut(there.union(edges.select(F.col("dst"), F.col("src"), back)), "both-ways")


def breadth_first(edges: DataFrame) -> DataFrame:
    """(id, shift, anchor) of ``edges(component, src, dst, offset)``: a level at a time from each component's smallest id.

    A node's parent is the neighbour that comes first in the level before, in the order in which a queue would hold it: by
    the parent's own place, then by id. A level only has to be told from itself and the one before.
    """
    spark = edges.sparkSession
    offset = F.when(~F.isnan("offset") & (F.abs("offset") < F.lit(float("inf"))), F.col("offset")).otherwise(0.0)
    near = both_ways(edges, offset, -offset)
    path = scratch_path(spark, "levels")
    schema = "id long, place int, shift double, anchor long"
    edges.select("component").distinct().select(F.col("component").alias("id"), F.lit(1).alias("place"), F.lit(0.0).alias("shift"), F.col("component").alias("anchor")).write.parquet(f"{path}/level=0")
    level = 0
    while True:
        now = spark.read.schema(schema).parquet(f"{path}/level={level}")
        known = now.select("id") if level == 0 else now.select("id").union(spark.read.schema(schema).parquet(f"{path}/level={level - 1}").select("id"))
        met = near.join(now.withColumnRenamed("id", "u"), "u").join(known.select(F.col("id").alias("v")), "v", "left_anti")
        best = met.groupBy("v").agg(F.min(F.struct("place", "u", "x", "shift", "anchor")).alias("m"))
        found = cut(best.select(F.col("v").alias("id"), "m.place", (F.col("m.shift") + F.col("m.x")).alias("shift"), "m.anchor"), "level")
        if found.isEmpty():
            return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path).select("id", "shift", "anchor")
        ordered = numbered(found, [F.col("place"), F.col("id")], "next")
        level += 1
        ordered.select("id", F.col("next").cast("int").alias("place"), "shift", "anchor").write.parquet(f"{path}/level={level}")


def shortest_ways(edges: DataFrame) -> DataFrame:
    """(start, goal, dist_km, way) of ``edges(component, src, dst, dist_km)``: each component's shortest way from its smallest to its largest id.

    Distances are improved from the nodes that changed last until none does; a way is then followed back from its goal.
    """
    spark = edges.sparkSession
    near = both_ways(edges, F.col("dist_km"), F.col("dist_km"))
    ends = {r[0]: r[1] for r in edges.groupBy("component").agg(F.max(F.greatest("src", "dst"))).collect()}  # the large components
    known = cut(edges.select("component").distinct().select(F.col("component").alias("id"), F.lit(0.0).alias("far"), F.lit(None).cast("long").alias("before")), "known")
    fresh = known
    while not fresh.isEmpty():
        step = near.join(fresh.select(F.col("id").alias("u"), "far"), "u").groupBy(F.col("v").alias("id")).agg(F.min(F.struct((F.col("far") + F.col("x")).alias("far"), "u")).alias("m"))
        fresh = cut(step.join(known.select("id", F.col("far").alias("old")), "id", "left").filter("old is null or m.far < old").select("id", "m.far", F.col("m.u").alias("before")), "fresh")
        known = cut(known.join(fresh.select("id"), "id", "left_anti").union(fresh), "known")
    out = []
    for start, goal in sorted(ends.items()):
        way, far = [goal], None
        while way[-1] != start:
            row = known.filter(F.col("id") == way[-1]).first()
            far = row["far"] if far is None else far
            way.append(row["before"])
        out.append((start, goal, far or 0.0, way[::-1]))
    return spark.createDataFrame(out, "start long, goal long, dist_km double, way array<long>")


def usable(edges: DataFrame) -> DataFrame:
    """Edges whose alignment is OK, with a finite cost and some similarity."""
    return edges.filter((F.col("status") == "OK") & ~F.isnan("cps") & (F.abs("cps") < F.lit(float("inf"))) & (F.col("sim") > 0))


def with_endpoints(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both of whose endpoints are among ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def attach(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Node columns on both endpoints, ``_src`` and ``_dst``; edges with a missing endpoint keep nulls there."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end, "left")
    return edges


def cheapest(edges: DataFrame) -> DataFrame:
    """Of repeated edges the one with the lowest finite cost per step."""
    good = edges.filter(~F.isnan("cps") & (F.abs("cps") < F.lit(float("inf"))))
    rest = [F.col(c) for c in edges.columns if c not in ("src", "dst")]
    if len(rest) == 1:  # numbers are compared in hash tables, rows are sorted first
        return good.groupBy("src", "dst").agg(F.min("cps").alias("cps"))
    return good.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), "cps").alias("e")).select("src", "dst", "e.*")


def cheapest_of(edges: DataFrame) -> DataFrame:
    """``cheapest`` of edges each of which is a row with its repeats' costs in an array ``cps``: nothing has to be gathered."""
    least = F.array_min(F.filter("cps", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return edges.withColumn("cps", least).filter("cps is not null")
