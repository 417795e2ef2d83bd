"""Has the data or the model's output moved?"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revpulse import fixed
from revpulse.functions.moments import AsOf, between_lookback, lookback, moment
from revpulse.operators.detect import WINDOW_KEY
from revpulse.plans.quantiles import quantiles, quantiles_of_counts, short_side, value_counts


def scored_windows(metrics: DataFrame, anomalies: DataFrame, as_of: AsOf, hours: int = 24) -> DataFrame:
    """Recent windows with their anomaly's score and severity; score 0 where there is none."""
    recent = lookback(metrics, "window_start", as_of, f"{hours} HOURS")
    found = lookback(anomalies, "window_start", as_of, f"{hours} HOURS").select(*WINDOW_KEY, "anomaly_score", "severity")
    return recent.join(found, WINDOW_KEY, "left").select(
        *WINDOW_KEY, "total_revenue", "order_count", "avg_order_value",
        F.coalesce(F.col("anomaly_score").cast("double"), F.lit(0.0)).alias("anomaly_score"), "severity",
    )


def score_stats(scored: DataFrame) -> DataFrame:
    score = F.col("anomaly_score")
    return scored.agg(
        F.count("*").alias("windows"),
        F.avg((score > 0.5).cast("double")).alias("anomaly_rate"),
        F.avg(score).alias("avg_score"),
        F.stddev_samp(score).alias("score_std"),
    )


def percentile_edges(values: DataFrame, col: str, bins: int = 10, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per ``by``: the distinct, ascending edges of ``bins`` equally filled bins."""
    keys = by or ["__all"]
    keyed = values if by else values.withColumn("__all", F.lit(1))
    edges = quantiles(keyed, col, _shares(bins), keys, exact, few_groups=not by)
    return edges.select(*(by or []), F.array_distinct("quantiles").alias("edges"))


def _shares(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def bin_index(value: Column, edges: Column) -> Column:
    """0-based bin; the last bin includes its right edge."""
    below = F.size(F.filter(edges, lambda e: e <= value))
    return F.least(below, F.size(edges) - 1) - 1


_SLICES = ("expected", "actual")


def _slice_counts(samples: DataFrame, by: list[str]) -> DataFrame:
    """Rows of both slices per distinct value of ``samples(by…, value, slice)``."""
    return value_counts(samples, "value", by, [
        F.count("*").alias("all_rows"), *[F.count_if(F.col("slice") == s).alias(f"{s}_rows") for s in _SLICES]
    ])


def _binned(counts: DataFrame, edges: DataFrame, by: list[str], few_groups: bool) -> DataFrame:
    return counts.join(short_side(edges, few_groups), by).groupBy(*by, bin_index(F.col("value"), F.col("edges")).alias("bin")).agg(
        *[F.sum(f"{s}_rows").alias(f"{s}_rows") for s in _SLICES]
    )


def _edges_of(counts: DataFrame, by: list[str], bins: int, exact: bool, few_groups: bool) -> DataFrame:
    if exact:
        found = quantiles_of_counts(counts, "value", "all_rows", _shares(bins), by, few_groups)
    else:
        found = counts.groupBy(*by).agg(F.percentile_approx("value", _shares(bins), 10000).alias("quantiles"))
    return found.select(*by, F.array_distinct("quantiles").alias("edges"))


def histogram(samples: DataFrame, by: list[str], bins: int = 10, exact: bool = True, few_groups: bool = False) -> DataFrame:
    """Rows per ``by`` and bin for ``samples(by…, value, slice)``, counted for the slices
    ``expected`` and ``actual`` over edges shared by both.  Bins without rows are there with 0."""
    return _histogram_of(_slice_counts(samples, by), by, bins, exact, few_groups)


def _histogram_of(counts: DataFrame, by: list[str], bins: int, exact: bool, few_groups: bool) -> DataFrame:
    edges = _edges_of(counts, by, bins, exact, few_groups)
    # A group of one value has one edge; its rows lie in bin 0, as bin_index has it.
    every = edges.select(*by, F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    filled = _binned(counts, edges, by, few_groups).withColumn("bin", F.greatest("bin", F.lit(0)))
    return every.join(filled, [*by, "bin"], "left").select(*by, "bin", *[F.coalesce(f"{s}_rows", F.lit(0)).alias(f"{s}_rows") for s in _SLICES])


def psi_by_measure(expected: DataFrame, actual: DataFrame, columns: list[str], bins: int = 10, exact: bool = True) -> DataFrame:
    """(measure, psi) for several columns in one pass.

    The edges are one short array per measure.  A bin empty in both slices adds nothing to
    the sum, so bins need not be completed.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("m")

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(pairs, F.lit(name).alias("slice")).select("m.*", "slice")

    return _psi_of(histogram(long(expected, "expected").unionByName(long(actual, "actual")), ["measure"], bins, exact, few_groups=True), ["measure"])


def _psi_of(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by…, psi) of a histogram."""
    whole = Window.partitionBy(*by)  # one row per bin

    def share(rows):
        return F.greatest(F.try_divide(F.col(rows), F.sum(rows).over(whole)), F.lit(fixed.PSI_FLOOR))

    shares = counts.select(*by, share("expected_rows").alias("e"), share("actual_rows").alias("a"))
    return shares.groupBy(*by).agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


def psi(expected: DataFrame, actual: DataFrame, col: str, bins: int = 10, exact: bool = True) -> DataFrame:
    """One row: the population stability index of a column between two samples."""
    return psi_by_measure(expected, actual, [col], bins, exact).select("psi")


def drift_report(
    metrics: DataFrame, anomalies: DataFrame, as_of: AsOf, hours: int = 24, baseline_days: int = 7, exact: bool = True,
    min_rows: int = fixed.DRIFT_MIN_ROWS,
) -> DataFrame:
    """One drift row.

    The whole baseline is used.  With fewer than ``min_rows`` recent windows the row says so and has no
    figures; with fewer baseline windows both stability indices are null.
    """
    scored = scored_windows(metrics, anomalies, as_of, hours)
    baseline = between_lookback(metrics, "window_start", as_of, f"{baseline_days} DAYS", f"{hours} HOURS")
    measures = psi_by_measure(baseline, scored, ["total_revenue", "order_count"], exact=exact)
    by_name = measures.agg(
        F.max(F.when(F.col("measure") == "total_revenue", F.col("psi"))).alias("revenue"),
        F.max(F.when(F.col("measure") == "order_count", F.col("psi"))).alias("orders"),
    ).select(F.struct("revenue", "orders").alias("psi")).scalar()
    enough = baseline.agg(F.count("*")).scalar() >= min_rows

    told = F.col("windows") >= min_rows
    return _told(score_stats(scored).withColumn("__psi", by_name).withColumns({
        "measured_at": moment(as_of, metrics, "window_start"), "window_hours": F.lit(hours), "__told": told, "__enough": enough}))


def _told(figures: DataFrame) -> DataFrame:
    """The drift row of its figures."""
    told, enough = F.col("__told"), F.col("__enough")
    report = figures.select(
        "measured_at", "window_hours",
        *[F.when(told, F.col(c)).alias(c) for c in ("anomaly_rate", "avg_score", "score_std")],
        F.when(told & enough, F.col("__psi.revenue")).alias("psi_revenue"),
        F.when(told & enough, F.col("__psi.orders")).alias("psi_order_count"),
        "__told",
    )

    rate, std = F.col("anomaly_rate"), F.col("score_std")
    wording = fixed.DRIFT_NOTES
    tests = [
        (F.col("psi_revenue") > fixed.DRIFT_PSI_LIMIT, F.format_string(wording["revenue"], F.col("psi_revenue"))),
        (F.col("psi_order_count") > fixed.DRIFT_PSI_LIMIT, F.format_string(wording["orders"], F.col("psi_order_count"))),
        (F.abs(rate - fixed.DRIFT_EXPECTED_RATE) > fixed.DRIFT_RATE_TOLERANCE,
         F.format_string(wording["rate"], rate * 100, F.lit(fixed.DRIFT_EXPECTED_RATE * 100))),
        (std < fixed.DRIFT_MIN_SCORE_STD, F.format_string(wording["collapse"], std)),
    ]
    found = F.concat_ws("; ", *[F.when(test, text) for test, text in tests])
    notes = F.when(~F.col("__told"), F.lit(fixed.TOO_FEW_WINDOWS)).when(found != "", found)
    return report.withColumns({"drift_flag": found != "", "notes": notes}).drop("__told")


_MEASURES = ["total_revenue", "order_count"]


def summarise(metrics: DataFrame) -> DataFrame:
    """(hour, measure, value, n): how many windows of an hour have a value.  Summaries of different windows add up."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in _MEASURES])).alias("m")
    hours = metrics.select(F.date_trunc("hour", "window_start").cast(metrics.schema["window_start"].dataType).alias("hour"), pairs)
    return hours.groupBy("hour", "m.measure", "m.value").agg(F.count("*").alias("n"))


def drift_reports(
    summaries: DataFrame, metrics: DataFrame, anomalies: DataFrame, as_of: dt.datetime, hours: Sequence[int] = (24, 48), baseline_days: int = 7,
    exact: bool = True, min_rows: int = fixed.DRIFT_MIN_ROWS,
) -> DataFrame:
    """A row of :func:`drift_report` per look-back, all from one pass over the hourly ``summaries``.

    Of ``metrics`` only the hours that a look-back cuts in two are read.  Scores come from the anomalies alone: a window without one
    scores 0.  Every anomaly's window has to be among the metrics.
    """
    start = as_of - dt.timedelta(days=baseline_days)
    lows = {h: as_of - dt.timedelta(hours=h) for h in hours}
    floor = lambda t: t.replace(minute=0, second=0, microsecond=0)
    cut = sorted({floor(t) for t in (start, *lows.values()) if t != floor(t)})
    kind = metrics.schema["window_start"].dataType
    at = lambda t: F.lit(str(t)).cast(kind)
    inner = summaries.where((F.col("hour") >= at(floor(start))) & ~F.col("hour").isin([at(t) for t in cut] or [F.lit(None).cast(kind)]) if cut else F.col("hour") >= at(floor(start)))
    edge = F.lit(False)
    for t in cut:
        edge = edge | ((F.col("window_start") >= at(t)) & (F.col("window_start") < at(t + dt.timedelta(hours=1))))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in _MEASURES])).alias("m")
    fringe = metrics.where(edge).select(F.col("window_start").alias("t"), pairs, F.lit(1).cast("long").alias("n")).select("t", "m.measure", "m.value", "n")
    rows = inner.select(F.col("hour").alias("t"), "measure", "value", "n").unionByName(fringe).where(F.col("t") >= at(start))
    spans = F.explode(F.array(*[F.struct(F.lit(h).alias("window_hours"), (F.col("t") >= at(low)).alias("late")) for h, low in lows.items()])).alias("s")
    rows = rows.select("measure", "value", "n", spans).select("s.window_hours", "measure", "value", F.when(F.col("s.late"), F.col("n")).otherwise(0).alias("a"),
                                                               F.when(F.col("s.late"), 0).otherwise(F.col("n")).alias("e"))
    by = ["window_hours", "measure"]
    counts = value_counts(rows, "value", by, [F.sum(F.col("a") + F.col("e")).alias("all_rows"), F.sum("e").alias("expected_rows"), F.sum("a").alias("actual_rows")])
    stability = _psi_of(_histogram_of(counts, by, 10, exact, few_groups=True), by).groupBy("window_hours").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("psi"))).alias(name) for m, name in zip(_MEASURES, ("revenue", "orders"))])
    sizes = counts.where(F.col("measure") == "order_count").groupBy("window_hours").agg(F.sum("actual_rows").alias("windows"), F.sum("expected_rows").alias("before"))
    score = F.col("anomaly_score").cast("double")
    seen = anomalies.where(F.col("window_start") >= at(min(lows.values()))).select(score.alias("s"), F.explode(F.array(
        *[F.struct(F.lit(h).alias("window_hours"), (F.col("window_start") >= at(low)).alias("late")) for h, low in lows.items()])).alias("x")).where("x.late")
    scores = seen.groupBy(F.col("x.window_hours").alias("window_hours")).agg(F.count_if(F.col("s") > 0.5).alias("hits"), F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    every = metrics.sparkSession.createDataFrame([(h,) for h in hours], "window_hours int")
    n = F.coalesce("windows", F.lit(0))
    some = lambda c: F.coalesce(c, F.lit(0.0))
    spread = F.sqrt(F.greatest(F.try_divide(some("s2") - F.try_divide(some("s1") * some("s1"), n), n - 1), F.lit(0.0)))
    joined = every.join(F.broadcast(sizes), "window_hours", "left").join(F.broadcast(stability), "window_hours", "left").join(F.broadcast(scores), "window_hours", "left")  # a row a look-back
    return _told(joined.select(
        at(as_of).alias("measured_at"), "window_hours", F.try_divide(some("hits"), n).alias("anomaly_rate"), F.try_divide(some("s1"), n).alias("avg_score"), spread.alias("score_std"),
        F.struct("revenue", "orders").alias("__psi"), (n >= min_rows).alias("__told"), (F.coalesce("before", F.lit(0)) >= min_rows).alias("__enough")))


def latest_drift(drift_log: DataFrame) -> DataFrame:
    """The newest drift row with a label for its revenue index."""
    index = F.col("psi_revenue")
    label = F.when(index > fixed.DRIFT_PSI_LIMIT, F.lit("High drift")).when(index > fixed.DRIFT_PSI_WATCH, F.lit("Monitor"))
    return drift_log.orderBy(F.desc("measured_at")).limit(1).select(
        "measured_at", "anomaly_rate", "avg_score", "score_std", "psi_revenue", "drift_flag", "notes",
        label.alias("psi_label"),
    )
