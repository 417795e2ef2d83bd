"""Windowed revenue and the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revpulse.functions.money import cents, from_cents, mean_of_cents

KEY = ["category", "region"]
FEATURE_COLUMNS = [
    "revenue_last_5m", "orders_last_5m",
    "revenue_last_15m", "orders_last_15m", "avg_order_value_last_15m",
    "revenue_last_60m", "orders_last_60m",
]
_STEP = 5
_STEPS = {"5m": 1, "15m": 3, "60m": 12}


def _windowed(events: DataFrame, size: str, slide: str | None) -> DataFrame:
    frame = F.window("event_timestamp", size, slide) if slide else F.window("event_timestamp", size)
    return events.groupBy(frame.alias("window"), *KEY).agg(
        F.count("order_id").alias("orders"), F.sum(cents("total_amount")).alias("cents")
    )


def revenue_metrics(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Orders, revenue and mean order value per tumbling window, category and region."""
    return _windowed(events, window, None).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *KEY,
        F.col("orders").alias("order_count"),
        from_cents("cents").alias("total_revenue"),
        mean_of_cents(F.col("cents"), F.col("orders")).alias("avg_order_value"),
    )


def features(events: DataFrame, window: str, slide: str = "5 minutes") -> DataFrame:
    """Sliding sums stamped with the window end, straight from the events.

    This form suits update-mode streams.  It copies every event into each window it belongs
    to; :func:`feature_store` avoids that.
    """
    return _windowed(events, window, None if window == slide else slide).select(
        F.col("window.end").alias("computed_at"), *KEY,
        from_cents("cents").alias("revenue"),
        F.col("orders").alias("orders"),
        mean_of_cents(F.col("cents"), F.col("orders")).alias("avg_order_value"),
    )


def trend_ratio(cents_5m: Column, cents_15m: Column) -> Column:
    """Last five minutes against the mean five minutes of the last fifteen; our definition.

    Whole cents, so that both ways to build the table round the same quotient.
    """
    return F.when(
        cents_15m > 0, F.round(cents_5m.cast("double") * 3.0 / cents_15m.cast("double"), 4)
    ).otherwise(F.lit(0.0))


def features_from_windows(metrics: DataFrame, legacy_trend: bool = False) -> DataFrame:
    """Feature rows from 5-minute windows.

    Each 5-minute partial counts in the 12 sliding windows that end up to an hour after it
    starts; sums and counts add up exactly, so nothing has to go back to the events.
    One grouping gives all three window sizes.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(_STEPS["60m"] - 1))).alias("step")
    spread = metrics.select(
        "window_end", *KEY, cents("total_revenue").alias("cents"), F.col("order_count").alias("orders"), steps,
    ).withColumn("computed_at", F.col("window_end") + F.make_dt_interval(mins=F.col("step") * _STEP))

    def within(column, size):
        return F.sum(F.when(F.col("step") < _STEPS[size], F.col(column)).otherwise(F.lit(0)))

    summed = spread.groupBy("computed_at", *KEY).agg(
        *[within("cents", s).alias(f"cents_{s}") for s in _STEPS],
        *[within("orders", s).alias(f"orders_{s}") for s in _STEPS],
    )
    ratio = F.lit(0.0) if legacy_trend else trend_ratio(F.col("cents_5m"), F.col("cents_15m"))
    return summed.select(
        "computed_at", *KEY,
        from_cents("cents_5m").alias("revenue_last_5m"), F.col("orders_5m").alias("orders_last_5m"),
        from_cents("cents_15m").alias("revenue_last_15m"), F.col("orders_15m").alias("orders_last_15m"),
        F.coalesce(mean_of_cents(F.col("cents_15m"), F.col("orders_15m")), F.lit(0).cast("decimal(20,2)"))
        .alias("avg_order_value_last_15m"),
        from_cents("cents_60m").alias("revenue_last_60m"), F.col("orders_60m").alias("orders_last_60m"),
        ratio.alias("revenue_trend_pct"),
    )


def merge_features(parts: list[DataFrame], legacy_trend: bool = False) -> DataFrame:
    """One row per (computed_at, category, region) from frames that each carry some of the
    feature columns; missing figures are 0.

    Equals a chain of full outer joins on the key, in one shuffle.
    """
    keys = ["computed_at", *KEY]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    merged = stacked.groupBy(*keys).agg(
        *[F.coalesce(F.max(c), F.lit(0).cast(stacked.schema[c].dataType)).alias(c) for c in FEATURE_COLUMNS]
    )
    ratio = F.lit(0.0) if legacy_trend else trend_ratio(cents("revenue_last_5m"), cents("revenue_last_15m"))
    return merged.withColumn("revenue_trend_pct", ratio)


def feature_store(events: DataFrame, *, two_level: bool = True, legacy_trend: bool = False) -> DataFrame:
    """The feature table.  ``two_level`` sums events once into 5-minute windows and slides over
    those; the direct form slides over the events.  Same rows."""
    if two_level:
        return features_from_windows(revenue_metrics(events), legacy_trend)

    def named(size, window, mean=False):
        part = features(events, window)
        columns = ["computed_at", *KEY, F.col("revenue").alias(f"revenue_last_{size}"), F.col("orders").alias(f"orders_last_{size}")]
        if mean:
            columns.append(F.col("avg_order_value").alias(f"avg_order_value_last_{size}"))
        return part.select(*columns)

    return merge_features(
        [named("5m", "5 minutes"), named("15m", "15 minutes", mean=True), named("60m", "60 minutes")], legacy_trend
    )
