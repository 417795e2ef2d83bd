"""Exact interpolated quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a group in one buffer.  Here the distinct
values are counted in parallel, cut into ranges by an approximate sketch (which only
balances the work), and only the ranges that hold a wanted rank are looked at further.  With more
values these ranges are cut again, until one holds about ``ROWS_PER_RANGE`` values; then it is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revpulse.sources.warehouse import use_shared_checkpoints

_RANGES = 64
ROWS_PER_RANGE = 1_000_000  # distinct values that one task sorts


def value_counts(df: DataFrame, value: str, by: Sequence[str], counts: Sequence[Column]) -> DataFrame:
    """Rows per ``by`` and distinct value, written to the checkpoint folder.

    The steps below read this table several times; without the cut each would run the
    caller's whole plan again.
    """
    use_shared_checkpoints(df.sparkSession)
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*counts).checkpoint()


def short_side(df: DataFrame, few_groups: bool) -> DataFrame:
    """A frame with one short row per group, to be joined to all values.

    With few groups for certain (a fixed list of measures) it is broadcast, and the values
    stay where they are.  Otherwise the join is left to Spark, which measures the side at run
    time and splits a group that is too large.
    """
    return F.broadcast(df) if few_groups else df


def quantiles_of_counts(
    counts: DataFrame, value: str, n: str, probs: Sequence[float], by: Sequence[str], few_groups: bool = False,
) -> DataFrame:
    """One row per ``by``: an array with one linearly interpolated quantile per probability, from
    distinct values and how often each occurs."""
    rows = counts.select(*by, F.col(value).alias("__v"), F.col(n).alias("__n"), F.lit(0).cast("bigint").alias("__range"))
    size = counts.count()
    levels = math.ceil(math.log(max(size / ROWS_PER_RANGE, 1), _RANGES))  # none while one range holds all
    positions = F.array(*[F.lit(float(p)) for p in probs])
    # Per group the ranges that hold wanted ranks: at first all values are one range.
    wanted = (
        rows.groupBy(*by).agg(F.sum("__n").alias("__total"))
        .withColumn("__at", F.transform(positions, lambda p: p * (F.col("__total") - 1)))
        .withColumn("__ranks", F.array_distinct(F.concat(
            F.transform("__at", lambda h: F.floor(h).cast("bigint")),
            F.transform("__at", lambda h: F.ceil(h).cast("bigint")),
        )))
        .select(*by, F.lit(0).cast("bigint").alias("__range"), F.lit(0).cast("bigint").alias("__before"), "__at", "__ranks")
    )
    keys = [*by, "__range"]
    # At most _RANGES rows per range in this window.
    upto = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(levels):
        inside = rows if level == 0 else rows.join(short_side(wanted.select(*keys), few_groups), keys)
        cuts = inside.groupBy(*keys).agg(
            F.percentile_approx("__v", [i / _RANGES for i in range(1, _RANGES)], 1000).alias("__cuts")
        )
        parted = inside.join(short_side(cuts, few_groups), keys).withColumn(
            "__part", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
        ).drop("__cuts")
        sums = parted.groupBy(*keys, "__part").agg(F.sum("__n").alias("__m"))
        counted = sums.withColumn("__below", F.sum("__m").over(upto) - F.col("__m"))
        finer = (F.col("__range") * _RANGES + F.col("__part")).alias("__range")
        wanted = (
            counted.join(short_side(wanted, few_groups), keys)
            .withColumn("__before", F.col("__before") + F.col("__below"))
            .withColumn("__ranks", F.filter("__ranks", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__m"))))
            .where(F.size("__ranks") > 0)
            .select(*by, finer, "__before", "__at", "__ranks")
        )
        rows = parted.select(*by, "__v", "__n", finer)
    inside = (
        Window.partitionBy(*keys).orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Two values per probability at most.
    picked = (
        rows.join(short_side(wanted, few_groups), keys)
        .withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
        .withColumn("__hit", F.filter("__ranks", lambda r: (r >= F.col("__end") - F.col("__n")) & (r < F.col("__end"))))
        .select(*by, "__at", "__v", F.explode("__hit").alias("__rank"))
        .groupBy(*by).agg(
            F.first("__at").alias("__at"),
            F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__value"),
        )
    )

    def interpolate(h: Column) -> Column:
        low = F.element_at(F.col("__value"), F.floor(h).cast("bigint"))
        high = F.element_at(F.col("__value"), F.ceil(h).cast("bigint"))
        return low + (high - low) * (h - F.floor(h))

    return picked.select(*by, F.transform("__at", interpolate).alias("quantiles"))


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], exact: bool = True, few_groups: bool = False,
) -> DataFrame:
    """One row per ``by`` (at least one column) with an array of quantiles; ``exact=False`` takes
    Spark's sketch."""
    if not exact:
        return df.groupBy(*by).agg(F.percentile_approx(value, list(probs), 10000).alias("quantiles"))
    counts = value_counts(df, value, by, [F.count("*").alias("__rows")])
    return quantiles_of_counts(counts, value, "__rows", probs, by, few_groups)
