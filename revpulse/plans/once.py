"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column whose expression the optimizer will not copy.

    Filters are moved below projections by putting the expression in place of the column name,
    once per mention; with nested expressions that multiplies.  A one-element explode keeps
    its result.  Filters on the other columns still move below it.
    """
    return df.withColumn(name, F.explode(F.array(column)))
