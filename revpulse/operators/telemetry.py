"""Rollups over counter samples and batch logs, and alert rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revpulse.functions.moments import window_start
from revpulse.plans.ordered import balanced_span, running, with_previous

SERIES = ["name", "label"]
_INF = float("inf")


def consecutive_failures(batch_log: DataFrame, threshold: int = 5) -> DataFrame:
    """Per batch of every sink: failures in a row up to here, failures and batches so far,
    failure rate, and whether the sink counts as healthy.

    Failures in a row = failures so far minus failures so far at the last success.
    """
    counted = running(
        batch_log, ["sink"], "finished_at",
        {"total_failures": F.col("failed").cast("bigint"), "total_batches": F.lit(1).cast("bigint")},
        at_last={"__base": ("total_failures", ~F.col("failed"))}, ties=["batch_id"], span="1 day",
    )
    row = F.col("total_failures") - F.coalesce("__base", F.lit(0))
    return counted.select(
        "sink", "batch_id", "finished_at", row.alias("consecutive_failures"), "total_failures", "total_batches",
        F.round(F.col("total_failures") / F.col("total_batches"), 4).alias("failure_rate"),
        (row < threshold).alias("healthy"),
    )


def counter_deltas(samples: DataFrame) -> DataFrame:
    """Growth of every counter since its previous sample; after a reset the new value counts."""
    span = balanced_span(samples, SERIES, "ts")
    before = with_previous(samples, SERIES, "ts", {"previous": "value"}, ties=["value"], span=span)
    grown = F.when(F.col("value") < F.col("previous"), F.col("value")).otherwise(F.col("value") - F.col("previous"))
    return before.where(F.col("has_previous")).select(*SERIES, "ts", grown.alias("delta"))


def counter_increase(samples: DataFrame, minutes: int, step: str | None = None) -> DataFrame:
    """Increase and per-second rate of each series over sliding windows of ``minutes``.

    Windows end every ``step`` (default: every minute).  The increase is the sum of the
    growth seen inside the window; nothing is extrapolated to its edges.
    """
    frame = F.window("ts", f"{minutes} minutes", step or "1 minute")
    # One row per series and minute first, so sliding does not copy every sample.
    per_minute = counter_deltas(samples).groupBy(*SERIES, window_start("ts", "1 minute").alias("ts")).agg(
        F.sum("delta").alias("delta")
    )
    return per_minute.groupBy(*SERIES, frame.alias("w")).agg(F.sum("delta").alias("increase")).select(
        *SERIES, F.col("w.end").alias("window_end"), "increase", (F.col("increase") / float(minutes * 60)).alias("rate")
    )


def events_per_minute(samples: DataFrame) -> DataFrame:
    """Counter growth per minute."""
    grown = counter_increase(samples, 1)
    return grown.select(*SERIES, "window_end", (F.col("rate") * 60.0).alias("events_per_minute"))


def bucket_histogram(df: DataFrame, col: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative counts per upper bound (the last is infinite), with sum and count.

    One pass with one counter per bound; rows are not multiplied.
    """
    by = by or []
    value = F.col(col).cast("double")
    edges = [*bounds, _INF]
    wide = df.where(value.isNotNull()).groupBy(*by).agg(
        *[F.count_if(value <= b).alias(f"__b{i}") for i, b in enumerate(edges)], F.sum(value).alias("__sum")
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"__b{i}").alias("cumulative")) for i, b in enumerate(edges)
    ])).alias("r")
    return wide.select(*by, rows, "__sum").select(*by, "r.le", "r.cumulative", F.col("__sum").alias("total_value"))


def histogram_quantile(h: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """Quantile estimate by straight lines inside the buckets.

    The lowest bucket starts at 0; a quantile in the infinite bucket is reported as the
    highest finite bound.  A series has as many rows as there are bounds.
    """
    by = by or []
    keyed = h if by else h.withColumn("__all", F.lit(1))
    keys = by or ["__all"]
    ordered = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    rows = keyed.select(
        *keys, "le", "cumulative",
        F.lag("le", 1).over(ordered).alias("low"),
        F.coalesce(F.lag("cumulative", 1).over(ordered), F.lit(0)).alias("below"),
        F.max("cumulative").over(whole).alias("total"),
    ).where(F.col("total") > 0)
    rank = F.col("total") * F.lit(float(q))
    low = F.coalesce("low", F.least(F.lit(0.0), F.col("le")))
    inside = F.col("cumulative") - F.col("below")
    value = F.when(F.col("le") == _INF, F.col("low")).otherwise(
        low + (F.col("le") - low) * F.coalesce(F.try_divide(rank - F.col("below"), inside), F.lit(1.0))
    )
    hit = rows.where(F.col("cumulative") >= rank).groupBy(*keys).agg(F.min_by(value, F.col("le")).alias("quantile"))
    return hit.select(*by, "quantile")


def anomaly_rate_alert(
    events: DataFrame, anomalies: DataFrame, ratio: float = 0.2, window: str = "5 minutes", clamp_min: float = 1.0,
) -> DataFrame:
    """Anomalies per second over events per second for each window, and whether it is too high.

    The event rate counts as at least ``clamp_min`` per second.
    """
    def per_window(df, column, name):
        other = "anomalies" if name == "events" else "events"
        return df.where(F.col(column).isNotNull()).groupBy(F.window(column, window).alias("w")).agg(
            F.count("*").alias(name)
        ).withColumn(other, F.lit(0).cast("bigint"))

    both = per_window(events, "event_timestamp", "events").unionByName(per_window(anomalies, "detected_at", "anomalies"))
    rows = both.groupBy("w").agg(F.sum("events").alias("events"), F.sum("anomalies").alias("anomalies"))
    seconds = F.timestamp_diff("SECOND", F.col("w.start"), F.col("w.end")).cast("double")
    value = (F.col("anomalies") / seconds) / F.greatest(F.col("events") / seconds, F.lit(float(clamp_min)))
    return rows.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "anomalies",
        value.alias("anomaly_rate"), (value > ratio).alias("breach"),
    )


def sustained_breach(cond: DataFrame, duration: str, *, step: str = "5 minutes", by: list[str] | None = None) -> DataFrame:
    """Adds ``active_since`` and ``firing`` to rows ``(by…, window_start, breach)``.

    A breach fires once it has held without a break for ``duration``.  A false row breaks it,
    and so does a missing one (a distance above ``step``).
    """
    by = by or []
    keyed = cond if by else cond.withColumn("__all", F.lit(1))
    keys = by or ["__all"]
    span = balanced_span(keyed, keys, "window_start", widest=86_400)
    before = with_previous(keyed, keys, "window_start", {"__was": "breach", "__at": "window_start"}, span=span)
    on = F.coalesce("breach", F.lit(False))
    goes_on = F.coalesce(
        F.col("__was") & (F.col("__at") + F.expr(f"INTERVAL {step}") >= F.col("window_start")), F.lit(False)
    )
    started = F.when(on & ~goes_on, F.col("window_start"))
    runs = running(before, keys, "window_start", maxima={"active_since": started}, span=span)
    held = F.col("active_since") + F.expr(f"INTERVAL {duration}") <= F.col("window_start")
    return runs.select(
        *cond.columns, F.when(on, F.col("active_since")).alias("active_since"),
        (on & F.coalesce(held, F.lit(False))).alias("firing"),
    )


def error_spike_alert(samples: DataFrame, minutes: int = 15, more_than: float = 3.0) -> DataFrame:
    """Series and times at which a counter grew by more than the limit."""
    return counter_increase(samples, minutes).withColumn("breach", F.col("increase") > more_than)


def total_alert(samples: DataFrame, more_than: float) -> DataFrame:
    """The newest value of every counter, and whether it is above the limit."""
    newest = samples.groupBy(*SERIES).agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("sampled_at"))
    return newest.withColumn("breach", F.col("value") > more_than)


def value_breaches(samples: DataFrame, more_than: float) -> DataFrame:
    """(label, at, breach): whether a counter stood above the limit at each of its samples."""
    return samples.groupBy("label", F.col("ts").alias("at")).agg((F.max("value") > more_than).alias("breach"))


def alert_states(rules: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """The state of every alert and series at its last evaluation: (alert, label, state, active_since, evaluated_at).

    ``rules`` names for each alert its expression as rows (label, at, breach), how long it must hold, and the longest gap between two
    evaluations that counts as unbroken.  An alert is pending until its expression has held for that long, then firing.
    """
    parts = []
    for name, (rows, duration, step) in rules.items():
        held = sustained_breach(rows.withColumnRenamed("at", "window_start"), duration, step=step, by=["label"])
        state = F.when(F.col("firing"), F.lit("firing")).when(F.coalesce("breach", F.lit(False)), F.lit("pending")).otherwise(F.lit("inactive"))
        last = held.groupBy("label").agg(F.max_by(F.struct(state.alias("state"), "active_since"), F.col("window_start")).alias("s"), F.max("window_start").alias("evaluated_at"))
        parts.append(last.select(F.lit(name).alias("alert"), "label", "s.state", "s.active_since", "evaluated_at"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def alert_step(prior: DataFrame | None, rules: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """As :func:`alert_states`, from the states of the evaluation before (the result of this function, None at first) and the rows
    that have come since: only these are read.  Also gives ``breach``, the last value of each expression.

    A run that was open goes on with its old ``active_since``; a series without new rows keeps its state.
    """
    parts = []
    for name, (rows, duration, step) in rules.items():
        new = rows.select("label", "at", "breach", F.lit(None).cast("timestamp").alias("since"))
        if prior is not None:
            mine = prior.where(F.col("alert") == name)
            new = new.join(mine.select("label", "evaluated_at"), "label", "left").where(F.col("evaluated_at").isNull() | (F.col("at") > F.col("evaluated_at"))).drop("evaluated_at")
            new = new.unionByName(mine.select("label", F.col("evaluated_at").alias("at"), "breach", F.col("active_since").cast("timestamp").alias("since")))
        held = sustained_breach(new.withColumnRenamed("at", "window_start"), duration, step=step, by=["label"])
        last = held.groupBy("label").agg(
            F.max_by(F.struct("breach", "active_since"), F.col("window_start")).alias("s"), F.max("window_start").alias("evaluated_at"),
            F.max(F.struct("since", F.col("window_start").alias("at"))).alias("old"))
        goes_on = F.col("old.since").isNotNull() & (F.col("s.active_since") == F.col("old.at"))
        since = F.when(goes_on, F.col("old.since")).otherwise(F.col("s.active_since"))
        on = F.coalesce("s.breach", F.lit(False))
        long = F.coalesce(since + F.expr(f"INTERVAL {duration}") <= F.col("evaluated_at"), F.lit(False))
        state = F.when(on & long, F.lit("firing")).when(on, F.lit("pending")).otherwise(F.lit("inactive"))
        parts.append(last.select(F.lit(name).alias("alert"), "label", state.alias("state"), F.when(on, since).alias("active_since"), "evaluated_at", F.col("s.breach").alias("breach")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
