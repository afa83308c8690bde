"""Merging of small bins and quotas on tables, held against the rules gone through one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from faciesforge.operators import grid, merging
from faciesforge.plans import kernel_queries

from conftest import SF_ORACLE

BINS = "id string, n long, lat double, lon double"


def merged(spark, bins, least, start_km=20.0):
    return {r["id"]: r["bin_id"] for r in merging.merged(spark.createDataFrame(bins, BINS), least, start_km).collect()}


def test_merging_is_that_of_one_by_one(spark):
    r = random.Random(1)
    crowd = [(f"b{i:02}", r.choice([1, 1, 2, 3, 5, 12]), r.uniform(37, 39), r.uniform(-102, -99)) for i in range(40)]
    assert merged(spark, crowd, 10, 100.0) == grid.merge_small_bins(crowd, 10)


def test_a_line_of_bins_that_wait_for_each_other(spark):
    line = [(f"b{i:02}", 1, 37.0, -100.0 + 0.1 * i * (1 + i / 50)) for i in range(8)]
    assert merged(spark, line, 4, 60.0) == grid.merge_small_bins(line, 4)


def test_one_bin_takes_all_others_in(spark):
    star = [("hub", 50, 38.0, -100.0)] + [(f"b{i:02}", 1 + i % 3, 38.0 + 0.3 * (1 if i % 2 else -1), -100.0 + 0.5 * (i - 7)) for i in range(14)]
    assert merged(spark, star, 40, 200.0) == grid.merge_small_bins(star, 40)


def test_bins_without_a_place_a_last_one_and_none(spark):
    assert merged(spark, [], 5) == {}
    assert merged(spark, [("a", 1, 37.0, -100.0)], 5) == {"a": "a"}
    assert merged(spark, [("a", 9, 37.0, -100.0), ("b", 9, 37.0, -100.0)], 5) == {"a": "a", "b": "b"}
    assert merged(spark, [("a", 1, 37.0, -100.0), ("b", 1, 37.0, -100.0), ("n", 1, None, -100.0), ("m", 1, float("nan"), 3.0)], 5) == {"a": "b", "b": "b", "n": "n", "m": "m"}
    assert merged(spark, [("a", 1, 10.0, 179.9), ("b", 7, 10.0, -179.9), ("c", 7, 10.0, 170.0)], 5) == {"a": "b", "b": "b", "c": "c"}


@pytest.mark.parametrize("mode", ["equal", "proportional"])
def test_quotas_are_those_of_one_by_one(spark, mode):
    for seed in range(2):
        r = random.Random(seed)
        caps = {f"c{i}": r.choice([1, 2, 3, 9, 50]) for i in range(r.randint(1, 40))}
        cells, n = spark.createDataFrame(sorted(caps.items()), "cell_id string, n long"), sum(caps.values())
        for total in (n // 3, n + 5):
            assert {c: q for c, q in merging.quotas(cells, total, mode).collect()} == grid.quotas(caps, total, mode)


def test_quotas_of_no_cells_and_of_no_mode(spark):
    cells = spark.createDataFrame([], "cell_id string, n long")
    assert merging.quotas(cells, 5).collect() == []
    assert merging.quotas(spark.createDataFrame([("a", 3)], "cell_id string, n long"), -2).collect()[0]["quota"] == 0
    with pytest.raises(ValueError):
        merging.quotas(cells, 5, "other")


@pytest.mark.parametrize("name", ["representative_quotas", "top_representatives"])
def test_sql_says_the_same(spark, duck, name):
    got = kernel_queries.QUERIES[name](spark, SF_ORACLE)
    want = duck.execute(kernel_queries.SQL[name]).fetchdf()
    columns = sorted(want.columns)
    rows = lambda frame: sorted(map(tuple, frame[columns].itertuples(index=False, name=None)))
    assert rows(got.select(*[F.col(c) for c in columns]).toPandas()) == rows(want)
