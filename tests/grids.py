"""Made-up windows for the tests of training and of the expected revenue."""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revpulse import fixed
from revpulse.operators import baseline
from revpulse.operators.detect import WINDOW_KEY


def window_grid(spark: SparkSession, start: dt.datetime, days: int = 30) -> DataFrame:
    """Every 5-minute window of ``days`` days for every category and region.

    ``range`` hands each task its own part of the time line; the 25 combinations are exploded
    from literals, so there is no join.
    """
    first = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
    names = {"category": list(fixed.CATEGORIES), "region": list(fixed.REGIONS)}
    grid = spark.range(days * 24 * 12).select(
        (first + F.make_dt_interval(mins=F.col("id").cast("int") * 5)).alias("window_start")
    ).withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 5 MINUTES"))
    for column, values in names.items():
        grid = grid.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def expected_grid(spark: SparkSession, start: dt.datetime, days: int = 30) -> DataFrame:
    """The grid with its calendar and expected revenue."""
    return baseline._with_expected(window_grid(spark, start, days))


def build_training_grid(spark: SparkSession, days: int = 30, anomaly_rate: float = 0.05, seed: int = 42, start=None) -> DataFrame:
    """Labelled synthetic windows: ±15 % noise around the expected revenue, some drops and spikes.

    Randomness comes from a hash of the row's key, not from ``rand``: a recomputed partition
    then gives the same rows.
    """
    def draw(n: int) -> Column:
        h = F.xxhash64(*[F.col(c) for c in WINDOW_KEY], F.lit(seed), F.lit(n))
        return F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))

    def between(n, low, high):
        return F.lit(low) + draw(n) * F.lit(high - low)

    grid = expected_grid(spark, start or dt.datetime(2025, 1, 1), days)
    exact = F.col("base_revenue") * F.col("region_weight") * F.col("hour_factor") * F.col("dow_factor")
    hit = draw(1) < anomaly_rate
    factor = F.when(~hit, between(0, 0.85, 1.15)).when(draw(2) < 0.7, between(3, 0.05, 0.35)).otherwise(between(4, 2.5, 5.0))
    revenue = F.round(exact * factor, 2)
    orders = F.greatest(F.lit(1), (F.col("total_revenue") / (F.col("base_revenue") * 0.05)).cast("bigint"))
    rows = (
        grid.withColumn("total_revenue", revenue).withColumn("is_anomaly", hit.cast("int"))
        .withColumn("order_count", orders)
        .withColumn("avg_order_value", F.round(F.col("total_revenue") / F.col("order_count"), 2))
        .withColumn("revenue_ratio", F.when(exact > 0, F.round(F.col("total_revenue") / exact, 4)).otherwise(0.0))
    )
    return rows.select(*fixed.TRAINING_COLUMNS)
