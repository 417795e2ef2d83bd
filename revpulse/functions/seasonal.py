"""Seasonal expected revenue and severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revpulse import fixed
from revpulse.functions.money import round_half_even


def _lookup(column: Column, values: dict, default) -> Column:
    found = None
    for key, value in values.items():
        found = F.when(column == key, F.lit(value)) if found is None else found.when(column == key, F.lit(value))
    return found.otherwise(F.lit(default))


def category_code(category: Column) -> Column:
    return _lookup(category, {k: v[0] for k, v in fixed.CATEGORIES.items()}, fixed.UNKNOWN_CODE)


def region_code(region: Column) -> Column:
    return _lookup(region, {k: v[0] for k, v in fixed.REGIONS.items()}, fixed.UNKNOWN_CODE)


def base_revenue(category: Column) -> Column:
    return _lookup(category, {k: v[1] for k, v in fixed.CATEGORIES.items()}, fixed.DEFAULT_BASE_REVENUE)


def region_weight(region: Column) -> Column:
    return _lookup(region, {k: v[1] for k, v in fixed.REGIONS.items()}, fixed.DEFAULT_REGION_WEIGHT)


def hour_factor(hour: Column) -> Column:
    """Half-open bands over 0..23; anything outside gets the default."""
    factor = F.lit(fixed.DEFAULT_HOUR_FACTOR)
    for first, value in fixed.HOUR_BANDS:
        factor = F.when(hour >= first, F.lit(value)).otherwise(factor)
    return F.when((hour >= 0) & (hour < 24), factor).otherwise(F.lit(fixed.DEFAULT_HOUR_FACTOR))


def day_factor(day_of_week: Column) -> Column:
    return _lookup(day_of_week, dict(enumerate(fixed.DAY_FACTORS)), fixed.DEFAULT_DAY_FACTOR)


def expected_revenue(base: Column, weight: Column, hour: Column, day: Column) -> Column:
    return round_half_even(base * weight * hour * day, 2)


def revenue_ratio(revenue: Column, expected: Column) -> Column:
    """Actual over expected at four decimals; 0 when nothing is expected."""
    return F.when(
        expected > 0, round_half_even(revenue.cast("double") / expected, 4)
    ).otherwise(F.lit(0.0))


def severity(ratio: Column) -> Column:
    graded = F.lit(fixed.SEVERITY_OTHERWISE)
    for name, below, above in reversed(fixed.SEVERITY_LIMITS):
        graded = F.when((ratio < below) | (ratio > above), F.lit(name)).otherwise(graded)
    return graded


def severity_rank(level: Column) -> Column:
    return _lookup(level, fixed.SEVERITY_ORDER, 3)


def pct_deviation(actual: Column, expected: Column) -> Column:
    """Signed deviation from expected in percent, 0 when nothing is expected."""
    return F.when(
        expected > 0, (actual.cast("double") / expected.cast("double") - 1.0) * 100.0
    ).otherwise(F.lit(0.0))


def direction(pct: Column) -> Column:
    return F.when(pct < 0, F.lit("DROP")).otherwise(F.lit("SPIKE"))


def trend_label(ratio: Column) -> Column:
    label = F.lit(fixed.TREND_OTHERWISE)
    for below, name in reversed(fixed.TREND_LABELS):
        label = F.when(ratio < below, F.lit(name)).otherwise(label)
    return label
