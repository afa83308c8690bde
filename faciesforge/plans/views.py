"""Well-log views of the driver's tables, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WELLS = "wells AS (SELECT c_custkey AS well_id, 37.0 + ((c_custkey * 7919) % 30000) / 10000.0 AS lat, -102.0 + ((c_custkey * 104729) % 74000) / 10000.0 AS lon FROM customer)"
SERIES = """series AS (SELECT l_suppkey AS well_id, k, CAST(1000 + 0.5 * k AS DOUBLE) AS depth, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS value
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem))"""
SERIES_DUP = "series_dup AS (SELECT well_id, k, 1000 + 0.5 * floor(k / 2) AS depth, value FROM series)"
# Fixed values of the curve header view.
MNEMONIC_LIST = ["GR", "GAMMA RAY", "gr:1", "RHOZ", "PEF", "DTCO", "XYZ", "Gamma-Ray", " nphi ", "CALI", "ild"]
UNIT_LIST = ["GAPI", "G/C3", "USEC/FT", "%", "IN", "", "ohm.m", "NONE", "gm/cc"]


def _list_sql(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


HEADERS = f"""headers AS (SELECT p_partkey AS file, ({_list_sql(MNEMONIC_LIST)})[CAST(p_size % {len(MNEMONIC_LIST)} AS INTEGER) + 1] AS mnemonic,
({_list_sql(UNIT_LIST)})[CAST((p_size + p_partkey) % {len(UNIT_LIST)} AS INTEGER) + 1] AS unit, p_name AS descr FROM part)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def wells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("well_id"), (F.lit(37.0) + (k * 7919) % 30000 / 10000.0).alias("lat"), (F.lit(-102.0) + (k * 104729) % 74000 / 10000.0).alias("lon"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return wells(spark, d).withColumnRenamed("well_id", "id")


def series(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_linenumber", F.row_number().over(order).cast("long").alias("k"))
    return li.select(F.col("l_suppkey").alias("well_id"), "k", (F.lit(1000) + 0.5 * F.col("k")).alias("depth"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("value"))


def series_dup(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).withColumn("depth", F.lit(1000) + 0.5 * F.floor(F.col("k") / 2))


def headers(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda items, at: F.element_at(F.array(*[F.lit(x) for x in items]), (at % len(items) + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("file"), pick(MNEMONIC_LIST, F.col("p_size")).alias("mnemonic"), pick(UNIT_LIST, F.col("p_size") + F.col("p_partkey")).alias("unit"), F.col("p_name").alias("descr"))
