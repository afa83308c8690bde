"""Tables as folders of NumPy archives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from faciesforge.sources import npz

SCHEMA = "id long, name string, x array<double>, ii array<int>, flag boolean, depth double"


@pytest.fixture
def source(spark):
    spark.dataSource.register(npz.NpzDataSource)


def rows_of(df):
    key = lambda r: repr(r[0])
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_round_trip_in_many_archives(spark, source, tmp_path):
    n = 5_000
    df = spark.range(n).select("id", F.concat(F.lit("wéll "), "id").alias("name"), F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda k: k / 3 + F.col("id")).alias("x"), F.transform(F.sequence(F.lit(0), F.col("id") % 3), lambda k: k.cast("int")).alias("ii"), (F.col("id") % 2 == 0).alias("flag"), F.sqrt("id").alias("depth"))
    path = f"{tmp_path}/t"
    df.repartitionByRange(6, "id").sortWithinPartitions("id").write.format("npz").mode("overwrite").option("rows", 300).save(path)
    files = list((tmp_path / "t").glob("part-*.npz"))
    assert len(files) >= n // 300
    back = spark.read.format("npz").schema(SCHEMA).load(path)
    assert back.rdd.getNumPartitions() == len(files) and rows_of(back) == rows_of(df)
    assert spark.read.format("npz").schema("name string, depth double").load(path).agg(F.sum("depth")).first()[0] == pytest.approx(df.agg(F.sum("depth")).first()[0])
    df.limit(10).write.format("npz").mode("append").save(path)
    assert spark.read.format("npz").schema(SCHEMA).load(path).count() == n + 10
    df.limit(3).write.format("npz").mode("overwrite").save(path)
    assert spark.read.format("npz").schema(SCHEMA).load(path).count() == 3 and len(list((tmp_path / "t").glob("part-*.npz"))) <= 3


def test_missing_values_and_no_rows(spark, source, tmp_path):
    nan = float("nan")
    df = spark.createDataFrame([(1, "a\0", [1.0, nan], [1], True, 0.5), (None, None, None, None, None, None), (3, "", [], [], False, nan), (4, "\0\0", [2.0], [7, 8], True, -1.0)], SCHEMA)
    df.write.format("npz").mode("overwrite").save(f"{tmp_path}/n")
    assert [repr(r) for r in rows_of(spark.read.format("npz").schema(SCHEMA).load(f"{tmp_path}/n"))] == [repr(r) for r in rows_of(df)]
    df.limit(0).write.format("npz").mode("overwrite").save(f"{tmp_path}/e")
    assert spark.read.format("npz").schema(SCHEMA).load(f"{tmp_path}/e").count() == 0


def test_a_job_that_breaks_off_leaves_nothing_to_read(spark, source, tmp_path):
    path = f"{tmp_path}/b"
    good = spark.range(20)
    good.write.format("npz").mode("overwrite").save(path)
    broken = spark.range(0, 20, 1, 4).select(F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("npz").mode("append").save(path)
    assert spark.read.format("npz").schema("id long").load(path).count() == 20
    with pytest.raises(Exception, match="archive lacks"):
        spark.read.format("npz").schema("other long").load(path).count()
