"""Expected revenue per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.functions import seasonal
from revpulse.plans.once import computed_once


def lookup_dims(df: DataFrame) -> DataFrame:
    """Codes, base revenue and weight of the row's category and region, with defaults.

    The dimensions are ten literals, so they are expressions in the same stage, not a join.
    """
    category, region = F.col("category"), F.col("region")
    return df.withColumns({
        "category_enc": seasonal.category_code(category),
        "region_enc": seasonal.region_code(region),
        "base_revenue": seasonal.base_revenue(category),
        "region_weight": seasonal.region_weight(region),
    })


def add_calendar(df: DataFrame) -> DataFrame:
    hour = F.hour("window_start")
    day = F.weekday("window_start")
    return df.withColumns({
        "hour": hour, "day_of_week": day,
        "hour_factor": seasonal.hour_factor(hour), "dow_factor": seasonal.day_factor(day),
    })


def engineer_features(metrics: DataFrame) -> DataFrame:
    """Adds calendar, codes, factors, expected revenue and the ratio of actual to expected."""
    wide = _with_expected(metrics)
    return computed_once(
        wide, "revenue_ratio", seasonal.revenue_ratio(F.col("total_revenue"), F.col("expected_revenue"))
    )


def _with_expected(df: DataFrame) -> DataFrame:
    wide = add_calendar(lookup_dims(df))
    factors = [F.col(c) for c in ("base_revenue", "region_weight", "hour_factor", "dow_factor")]
    return computed_once(wide, "expected_revenue", seasonal.expected_revenue(*factors))
