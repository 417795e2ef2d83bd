"""Points in time.

Every operator that looks back takes ``as_of``: a datetime (or text), or a one-row,
one-column DataFrame such as ``latest(events, "event_timestamp")``.  The frame form
stays lazy: it becomes a scalar subquery whose value Spark pushes into the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AsOf = Union[dt.datetime, str, DataFrame]


def latest(df: DataFrame, column: str) -> DataFrame:
    """One row: the newest value of a time column."""
    return df.agg(F.max(column).alias("as_of"))


def moment(as_of: AsOf, like: DataFrame, column: str, shift: str | None = None) -> Column:
    """``as_of`` (optionally moved by a SQL interval such as ``-30 MINUTES``) in the type of
    ``like[column]``, so the comparison never casts the stored column."""
    kind = like.schema[column].dataType.simpleString()
    step = F.expr(f"INTERVAL {shift}") if shift else None
    if isinstance(as_of, DataFrame):
        value = F.col(as_of.columns[0])
        if as_of.schema[0].dataType.simpleString() != kind:
            value = value.cast(kind)
        return as_of.select((value + step if step is not None else value).alias("moment")).scalar()
    text = as_of.isoformat(sep=" ") if isinstance(as_of, dt.datetime) else as_of
    value = F.lit(text).cast(kind)
    return value + step if step is not None else value


def lookback(df: DataFrame, column: str, as_of: AsOf, span: str) -> DataFrame:
    """Rows with ``column >= as_of - span``; span is an interval text such as ``30 MINUTES``."""
    return df.where(F.col(column) >= moment(as_of, df, column, f"-{span}"))


def between_lookback(df: DataFrame, column: str, as_of: AsOf, older: str, newer: str) -> DataFrame:
    """Half-open slice ``as_of - older <= column < as_of - newer``."""
    return df.where(
        (F.col(column) >= moment(as_of, df, column, f"-{older}"))
        & (F.col(column) < moment(as_of, df, column, f"-{newer}"))
    )


def window_start(column, size: str) -> Column:
    """Start of the tumbling window a row falls in; keeps the column's own time type."""
    return F.window(column, size)["start"]


def seconds_between(earlier, later) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(earlier), F.col(later)) / F.lit(1e6)


def is_zoned(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.TimestampType)


def bounded(value: int, low: int, high: int) -> int:
    """The parameter, if it is in its allowed range; anything else is refused."""
    if not low <= value <= high:
        raise ValueError(f"{value} is not between {low} and {high}")
    return value
