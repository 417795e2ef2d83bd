"""First rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key.

    The remaining columns break ties, so the choice does not depend on row arrival.  Spark
    plans the rank filter as a group limit on the map side too, so at most ``n`` rows of a
    key leave each input partition, however many copies that key has.
    """
    ties = [F.col(c) for c in df.columns if c not in keys]
    if not order and not ties and n == 1:  # nothing but the key
        return df.distinct()
    ranked = Window.partitionBy(*keys).orderBy(*order, *ties)
    return df.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= n).drop("__rank")
