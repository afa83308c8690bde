"""Places and running totals over a whole table in order, without sending it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before each one in this order.

    Rows are dealt to ranges of the order; each range is summed up on its own and shifted by
    the totals of the ranges before it, a number each. ``order`` has to tell rows apart.
    """
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    ranged = df.withColumns(keys | {"__value": value.cast("long")}).repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    shift, total = {}, 0
    for k, n in sorted(tuple(r) for r in ranged.groupBy("__range").agg(F.sum("__value")).collect()):
        shift[k], total = total, total + n
    before = F.sum("__value").over(Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    table = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv]) if shift else F.create_map(F.lit(0), F.lit(0))
    out = ranged.withColumn(name, (F.coalesce(before, F.lit(0)) + F.element_at(table, F.col("__range"))).cast("long"))
    return out.drop("__value", "__range", *keys)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``name``: the place of each row in this order, from 1."""
    return running_total(df, order, F.lit(1), name).withColumn(name, (F.col(name) + 1).cast("int"))
