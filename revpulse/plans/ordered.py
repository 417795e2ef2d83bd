"""Ordered scans over long series.

A plain ``lag`` or running sum puts a whole series into one task, which fails when one
series holds a third of all rows.  Here a series is cut into time slices: the scan runs
inside each (series, slice), the last row of every slice is scanned across slices, and the
two are combined.  The result equals the plain window function.

Both parts need the same shuffle and sort, so Spark reuses one exchange for them when they
need the same columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revpulse.functions.moments import window_start

# One struct column holds the series key and the slice.  Null key fields compare as equal in
# it, and a plain equality join on it reuses the partitioning of the window scan.
_PLACE = "__place"
_SLICE = "slice"


def _placed(df: DataFrame, keys: Sequence[str], order: str, span: str) -> DataFrame:
    series = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    return df.withColumn(_PLACE, F.struct(series.alias("series"), window_start(order, span).alias(_SLICE)))


def balanced_span(df: DataFrame, keys: Sequence[str], order: str, rows: int = 1_000_000, widest: int = 3600) -> str:
    """A slice length for the scans below: so short that about ``rows`` rows of the busiest series fall into one.

    One count per series and ``widest`` seconds, with map-side sums, decides; the time is not assumed to be spread evenly.
    """
    per = df.groupBy(*keys, window_start(order, f"{widest} seconds").alias("__slice")).agg(F.count("*").alias("n"))
    most = per.agg(F.max("n")).first()[0] or 1
    return f"{max(1, min(widest, widest * rows // most))} seconds"


def _windows(order, ties):
    inside = Window.partitionBy(_PLACE).orderBy(order, *ties)
    across = Window.partitionBy(f"{_PLACE}.series").orderBy(f"{_PLACE}.{_SLICE}")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    return inside, upto, across, before


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], *,
    ties: Sequence[str] = (), span: str = "1 hour",
) -> DataFrame:
    """Adds ``columns`` = {new name: source column} taken from the previous row of the series,
    plus ``has_previous``."""
    inside, _, across, _ = _windows(order, ties)
    held = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    scanned = _placed(df, keys, order, span).withColumns({
        "__prev": F.lag(held).over(inside), "__ends": F.lead(F.lit(True)).over(inside).isNull(),
    })
    carried = scanned.where("__ends").select(_PLACE, held.alias("__last")).select(
        _PLACE, F.lag("__last").over(across).alias("__carry")
    )
    joined = scanned.join(carried, _PLACE, "left")
    previous = F.coalesce(F.col("__prev"), F.col("__carry"))
    return joined.select(
        *df.columns,
        *[previous[new].alias(new) for new in columns],
        previous.isNotNull().alias("has_previous"),
    )


def running(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None, at_last: dict[str, tuple[str, Column]] | None = None, *,
    ties: Sequence[str] = (), span: str = "1 hour",
) -> DataFrame:
    """Adds running sums and running maxima over each series, current row included.

    ``at_last`` = {name: (sum, condition)} adds the value that a running sum had at the latest
    row where the condition held (null before the first such row).
    """
    sums, maxima, at_last = sums or {}, maxima or {}, at_last or {}
    inside, upto, _, before = _windows(order, ties)
    scanned = _placed(df, keys, order, span).withColumns({
        **{f"__run_{n}": F.sum(c).over(upto) for n, c in sums.items()},
        **{f"__run_{n}": F.max(c).over(upto) for n, c in maxima.items()},
        "__ends": F.lead(F.lit(True)).over(inside).isNull(),
    })
    if at_last:
        scanned = scanned.withColumns({
            f"__run_{n}": F.last(F.when(held, F.col(f"__run_{s}")), ignorenulls=True).over(upto)
            for n, (s, held) in at_last.items()
        })
    names = [*sums, *maxima, *at_last]
    ended = scanned.where("__ends").select(_PLACE, *[f"__run_{n}" for n in names])
    prefix = ended.select(
        _PLACE, *[f"__run_{n}" for n in at_last],
        *[F.sum(f"__run_{n}").over(before).alias(f"__pre_{n}") for n in sums],
        *[F.max(f"__run_{n}").over(before).alias(f"__pre_{n}") for n in maxima],
    )
    if at_last:
        prefix = prefix.select(
            _PLACE, *[f"__pre_{n}" for n in (*sums, *maxima)],
            *[F.last(F.coalesce(f"__pre_{s}", F.lit(0)) + F.col(f"__run_{n}"), ignorenulls=True).over(before).alias(f"__pre_{n}")
              for n, (s, _) in at_last.items()],
        )
    joined = scanned.join(prefix.select(_PLACE, *[f"__pre_{n}" for n in names]), _PLACE, "left")
    zero = F.lit(0)

    def pre(n):
        return F.col(f"__pre_{n}")

    def run(n):
        return F.col(f"__run_{n}")

    return joined.select(
        *df.columns,
        *[(F.coalesce(pre(n), zero) + F.coalesce(run(n), zero)).alias(n) for n in sums],
        *[F.greatest(pre(n), run(n)).alias(n) for n in maxima],
        *[F.coalesce(F.coalesce(pre(s), zero) + run(n), pre(n)).alias(n) for n, (s, _) in at_last.items()],
    )
