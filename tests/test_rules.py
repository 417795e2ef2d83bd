"""Seasonal factors, expected revenue, severity: golden values and properties."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import grids
from revpulse import fixed
from revpulse.functions import seasonal
from revpulse.operators import baseline


def evaluate(spark, expression, column, values, kind):
    frame = spark.createDataFrame([(v,) for v in values], f"{column} {kind}")
    return [r[0] for r in frame.select(expression(F.col(column))).collect()]


def test_hour_factor(spark):
    hours = [0, 3, 5, 6, 8, 9, 11, 12, 13, 14, 17, 18, 20, 21, 23, 24, -1]
    want = [0.3, 0.3, 0.3, 0.7, 0.7, 1.2, 1.2, 1.4, 1.4, 1.1, 1.1, 1.3, 1.3, 0.6, 0.6, 0.6, 0.6]
    assert evaluate(spark, seasonal.hour_factor, "h", hours, "int") == want


def test_day_factor(spark):
    assert evaluate(spark, seasonal.day_factor, "d", [0, 1, 2, 3, 4, 5, 6, -1, 7], "int") == [
        0.9, 0.85, 0.9, 1.0, 1.15, 1.3, 1.2, 1.0, 1.0]


def test_severity_bounds(spark):
    ratios = [0.15, 0.19, 4.1, 5.0, 0.2, 0.35, 0.39, 3.0, 4.0, 0.4, 0.5, 1.0, 2.0, 2.5]
    want = ["critical"] * 4 + ["high"] * 5 + ["medium"] * 5
    assert evaluate(spark, seasonal.severity, "r", ratios, "double") == want


def metrics(spark, rows):
    return spark.createDataFrame(rows, "window_start timestamp, category string, region string, total_revenue double")


def test_expected_revenue(spark):
    rows = [
        (dt.datetime(2026, 3, 6, 12), "Electronics", "Delhi", 1352.4),      # Friday noon
        (dt.datetime(2026, 3, 3, 2), "Accessories", "West Bengal", 0.0),    # Tuesday night
        (dt.datetime(2026, 3, 5, 15), "Toys", "Goa", 99.0),                 # defaults
    ]
    out = baseline.engineer_features(metrics(spark, rows)).orderBy("total_revenue").collect()
    night, other, noon = out
    assert (night.expected_revenue, night.revenue_ratio) == (3.06, 0.0)
    assert (noon.expected_revenue, noon.revenue_ratio) == (1352.4, 1.0)
    assert (other.category_enc, other.region_enc, other.base_revenue, other.region_weight) == (-1, -1, 300.0, 0.15)


def test_rounding_is_half_even_on_the_double(spark):
    # 250 * 0.15 * 0.3 * 0.9 = 10.125 is a tie; 250 * 0.3 * 0.3 * 1.15 falls just below one.
    rows = [(dt.datetime(2026, 3, 2, 1), "Apparel", "Karnataka", 1.0), (dt.datetime(2026, 3, 6, 1), "Apparel", "Delhi", 2.0)]
    out = [r.expected_revenue for r in baseline.engineer_features(metrics(spark, rows)).orderBy("total_revenue").collect()]
    assert out == [10.12, 25.87]


def test_weights_sum_to_one():
    assert abs(sum(w for _, w in fixed.REGIONS.values()) - 1.0) < 0.01
    assert max(fixed.REGIONS, key=lambda r: fixed.REGIONS[r][1]) == "Delhi"
    assert len({c for c, _ in fixed.CATEGORIES.values()}) == len(fixed.CATEGORIES)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 10), min_size=1, max_size=50))
def test_every_ratio_has_a_severity(spark, ratios):
    for r, s in zip(ratios, evaluate(spark, seasonal.severity, "r", ratios, "double")):
        assert s == ("critical" if r < 0.2 or r > 4.0 else "high" if r < 0.4 or r > 2.5 else "medium")


@pytest.mark.parametrize("days", [1, 2])
def test_grid_size(spark, days):
    grid = grids.expected_grid(spark, dt.datetime(2025, 1, 1), days)
    row = grid.agg(F.count("*"), F.min("expected_revenue"), F.countDistinct("window_start", "category", "region")).first()
    assert row[0] == row[2] == days * 288 * 25 and row[1] > 0
