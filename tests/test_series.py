"""Windows over a well's samples: results at ends and gaps, and work that grows with the samples and not with their square."""

from __future__ import annotations

import pytest

from faciesforge.operators import series

ROWS = [(1, 1.0, None), (1, 2.0, 4.0), (1, 3.0, None), (1, 4.0, None), (1, 5.0, 10.0), (1, 6.0, None), (2, 1.0, None), (2, 2.0, None), (3, 1.0, 0.0), (3, 2.0, -1.0), (3, 3.0, 0.0), (3, 4.0, 2.0), (3, 5.0, 3.0), (3, 5.0, None)]


@pytest.fixture
def samples(spark):
    return spark.createDataFrame(ROWS, "well_id long, depth double, value double")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("well_id", "depth", "value").collect()]


def test_filled_on_lines_and_held_at_ends(samples):
    assert values(series.fill_linear(samples)) == [4.0, 4.0, 6.0, 8.0, 10.0, 10.0, None, None, 0.0, -1.0, 0.0, 2.0, 3.0, 3.0]
    assert values(series.fill_linear(samples.filter("well_id = 1"), 3)) == [None, 4.0, None, None, 10.0, None]


def test_gaps_and_signs(samples):
    assert values(series.imputed_mask(samples.filter("well_id < 3"), 2.0), "imputed") == [True, False, True, True, False, True, True, True]
    assert [(r["depth"], r["value"]) for r in series.zero_crossings(samples.filter("well_id = 3 and value is not null")).collect()] == [(4.0, 2.0)]


@pytest.mark.parametrize("made", [series.fill_linear, lambda s: series.imputed_mask(s, 1.0), series.zero_crossings])
def test_no_frame_is_gone_through_for_each_sample(samples, made):
    assert "currentrow$(), unboundedfollowing$()" not in made(samples)._jdf.queryExecution().toString().lower()
