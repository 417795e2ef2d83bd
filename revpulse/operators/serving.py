"""Views that a dashboard or an API shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse import fixed
from revpulse.functions import seasonal
from revpulse.functions.moments import AsOf, bounded, lookback, moment, seconds_between, window_start
from revpulse.functions.money import cents, from_cents, mean_of_cents

_NEVER = "9999-12-31 00:00:00"


def _fallback_events(events: DataFrame, primary: DataFrame, as_of: AsOf, minutes: int) -> DataFrame:
    """Recent raw events if ``primary`` is empty, otherwise none.

    The choice is a scalar subquery that yields the lower time bound, so it reaches the
    Parquet scan: when the metrics are there, no row group of the events is read.
    """
    kind = events.schema["event_timestamp"].dataType
    bound = primary.agg(F.count("*").alias("n")).select(
        F.when(F.col("n") > 0, F.lit(_NEVER).cast(kind))
        .otherwise(moment(as_of, events, "event_timestamp", f"-{minutes} MINUTES")).alias("bound")
    ).scalar()
    return events.where(F.col("event_timestamp") >= bound)


def _revenue_view(metrics, events, as_of, minutes, metric_key, event_key, name, value) -> DataFrame:
    recent = lookback(metrics, "window_start", as_of, f"{minutes} MINUTES")
    raw = _fallback_events(events, recent, as_of, minutes)
    main = recent.groupBy(metric_key.alias(name)).agg(F.sum(cents("total_revenue")).alias("c")).withColumn("fallback", F.lit(False))
    spare = raw.groupBy(event_key.alias(name)).agg(F.sum(cents("total_amount")).alias("c")).withColumn("fallback", F.lit(True))
    return main.unionByName(spare).select(name, from_cents("c").alias(value), "fallback")


def revenue_trend(metrics: DataFrame, events: DataFrame, as_of: AsOf, minutes: int = 30) -> DataFrame:
    """Revenue per 5-minute window; from raw events while there are no metrics."""
    return _revenue_view(
        metrics, events, as_of, minutes, F.col("window_start"), window_start("event_timestamp", "5 minutes"),
        "window_start", "total_rev",
    ).orderBy("window_start")


def category_revenue(metrics: DataFrame, events: DataFrame, as_of: AsOf, minutes: int = 30) -> DataFrame:
    return _revenue_view(
        metrics, events, as_of, minutes, F.col("category"), F.col("category"), "category", "rev"
    ).orderBy(F.desc("rev"), "category")


def regional_revenue(metrics: DataFrame, events: DataFrame, as_of: AsOf, minutes: int = 30) -> DataFrame:
    return _revenue_view(
        metrics, events, as_of, minutes, F.col("region"), F.col("region"), "region", "rev"
    ).orderBy(F.desc("rev"), "region")


def _open_count(anomalies: DataFrame):
    return anomalies.agg(F.count_if(F.col("status") == "open")).scalar()


def _rows(df: DataFrame):
    return df.agg(F.count("*")).scalar()


def kpis_api(metrics: DataFrame, anomalies: DataFrame, reports: DataFrame, as_of: AsOf, minutes: int = 30) -> DataFrame:
    """One row of headline figures over the last 1 to 1440 minutes."""
    minutes = bounded(minutes, 1, 1440)
    recent = lookback(metrics, "window_end", as_of, f"{minutes} MINUTES")
    return recent.agg(
        F.coalesce(F.sum("order_count"), F.lit(0)).alias("orders"),
        from_cents(F.coalesce(F.sum(cents("total_revenue")), F.lit(0))).alias("revenue"),
    ).select(
        F.lit(minutes).alias("lookback_minutes"), "orders", "revenue",
        _open_count(anomalies).alias("open_anomalies"), _rows(reports).alias("total_reports"),
    )


def kpis_dashboard(
    metrics: DataFrame, events: DataFrame, anomalies: DataFrame, reports: DataFrame, as_of: AsOf, minutes: int = 30,
) -> DataFrame:
    """As :func:`kpis_api`, but both figures come from raw events while there are no metrics."""
    recent = lookback(metrics, "window_end", as_of, f"{minutes} MINUTES")
    raw = _fallback_events(events, recent, as_of, minutes).agg(
        F.count("*").alias("orders"), F.coalesce(F.sum(cents("total_amount")), F.lit(0)).alias("cents")
    ).select(F.struct("orders", "cents").alias("raw")).scalar()
    main = recent.agg(F.sum("order_count").alias("orders"), F.sum(cents("total_revenue")).alias("cents"))
    there = F.col("orders").isNotNull() & F.col("cents").isNotNull()
    return main.withColumn("raw", raw).select(
        F.when(there, F.col("orders")).otherwise(F.col("raw.orders")).alias("orders"),
        from_cents(F.when(there, F.col("cents")).otherwise(F.col("raw.cents"))).alias("revenue"),
        _open_count(anomalies).alias("open_anomalies"), _rows(reports).alias("total_reports"),
    )


def metrics_summary(anomalies: DataFrame, as_of: AsOf, hours: int = 24) -> DataFrame:
    """Counts by severity and status of recent anomalies and the last detection."""
    return lookback(anomalies, "detected_at", as_of, f"{hours} HOURS").agg(
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
        F.count_if(F.col("status") == "open").alias("open_count"),
        F.max("detected_at").alias("last_detected"),
    )


def anomaly_freshness(anomalies: DataFrame, as_of: AsOf, hours: int = 24) -> DataFrame:
    recent = anomalies.where(F.col("detected_at") > moment(as_of, anomalies, "detected_at", f"-{hours} HOURS"))
    return recent.agg(
        F.count("*").alias("total_anomalies"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("status") == "acknowledged").alias("acknowledged"),
        F.max("detected_at").alias("latest_detection"),
    )


def dlq_stats(dlq: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """Depth of the dead-letter table, with both ends of its time range."""
    pending = ~F.col("resolved")
    return dlq.agg(
        F.count("*").alias("total"), F.count_if(pending).alias("pending"),
        F.count_if(pending & (F.col("retry_count") >= max_retries)).alias("exhausted"),
        F.min("first_failed").alias("oldest"), F.max("first_failed").alias("newest"),
    )


_FIRST = "0001-01-01 00:00:00"  # before every event


def _bound(row: DataFrame, test, df: DataFrame, column: str, if_so, otherwise):
    """One of two times by a test on a one-row frame; reaches the scan as a pushed filter."""
    kind = df.schema[column].dataType
    as_time = lambda x: (F.lit(x) if isinstance(x, str) else x).cast(kind)
    return row.select(F.when(test, as_time(if_so)).otherwise(as_time(otherwise))).scalar()


def throughput(events: DataFrame, as_of: AsOf, minutes: int = 5) -> DataFrame:
    """Events per minute over the last minutes, and the newest arrival of all."""
    since = moment(as_of, events, "ingested_at", f"-{minutes} MINUTES")
    recent = events.where(F.col("ingested_at") >= since).agg(
        F.count("*").alias("n"), F.max("ingested_at").alias("last"),
    )
    # Only when nothing arrived lately does this scan find any row group to read.
    older = events.where(F.col("ingested_at") < _bound(recent, F.col("n") > 0, events, "ingested_at", _FIRST, since)).agg(F.max("ingested_at")).scalar()
    return recent.select(F.round(F.col("n") / float(minutes), 1).alias("events_per_minute"), F.coalesce("last", older).alias("last_ingested"))


def ingest_latency(events: DataFrame, n: int = 100, as_of: AsOf | None = None, minutes: int = 60) -> DataFrame:
    """Mean seconds from event to arrival over the latest ``n`` arrivals.

    With ``as_of`` the last ``minutes`` are read first, and the rest only if they hold fewer than ``n`` arrivals.
    """
    if as_of is not None:
        since = moment(as_of, events, "ingested_at", f"-{minutes} MINUTES")
        near = events.where(F.col("ingested_at") >= since).agg(F.count("*").alias("n"))
        events = events.where(F.col("ingested_at") >= _bound(near, F.col("n") >= n, events, "ingested_at", since, _FIRST))
    newest = events.select("ingested_at", "event_timestamp", "event_id").orderBy(F.desc("ingested_at"), "event_id").limit(n)
    return newest.agg(F.round(F.avg(seconds_between("event_timestamp", "ingested_at")), 2).alias("latency_seconds"))


def system_health(events: DataFrame, anomalies: DataFrame | str | None, as_of: AsOf) -> DataFrame:
    """One row: throughput, latency, last detection and what they mean for the feed and scans.

    Instead of the anomalies the time of the last detection may be given, such as a stored table's newest time, which needs no read.
    """
    if isinstance(anomalies, DataFrame):
        last = anomalies.agg(F.max("detected_at")).scalar()
    else:
        last = F.lit(anomalies).cast(events.schema["ingested_at"].dataType)
    now = moment(as_of, events, "ingested_at")
    row = throughput(events, as_of).select(
        "*", F.coalesce(ingest_latency(events, as_of=as_of).scalar(), F.lit(0.0)).alias("latency_seconds"),
        last.alias("last_detection"), now.alias("__now"),
    )
    age = seconds_between("last_ingested", "__now")
    scan_age = seconds_between("last_detection", "__now")
    return row.select(
        "events_per_minute", "latency_seconds", "last_ingested", "last_detection",
        F.coalesce(age <= 600, F.lit(False)).alias("connected"),
        F.coalesce(age > 120, F.lit(False)).alias("stalled"),
        F.coalesce(scan_age > 300, F.lit(False)).alias("stale_scan"),
    )


def category_revenue_1h(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Last-hour rollup per category; a batch job overwrites the stored copy every run."""
    recent = events.where(F.col("event_timestamp") > moment(as_of, events, "event_timestamp", "-1 HOURS"))
    return recent.groupBy("category").agg(
        F.sum(cents("total_amount")).alias("c"), F.count("*").alias("order_count_1h")
    ).select(
        "category", from_cents("c").alias("revenue_1h"), "order_count_1h",
        mean_of_cents(F.col("c"), F.col("order_count_1h")).alias("avg_order_value"),
    )


def _anomalies_by(anomalies: DataFrame, column: str, window: str | None) -> DataFrame:
    keys = [column] if window is None else [window_start("detected_at", window).alias("window_start"), column]
    return anomalies.groupBy(*keys).agg(F.count("*").alias("anomalies"))


def anomalies_by_category(anomalies: DataFrame, window: str | None = None) -> DataFrame:
    return _anomalies_by(anomalies, "category", window)


def anomalies_by_severity(anomalies: DataFrame, window: str | None = None) -> DataFrame:
    return _anomalies_by(anomalies, "severity", window)


MAX_OFFSET = 10_000


def page_after(df: DataFrame, newest: str, key: str, limit: int, last: tuple[str, str] | None = None) -> DataFrame:
    """The next ``limit`` rows after ``last`` = (time, id) of the page before, newest first.

    The time is pushed into the scan, and no task keeps more than ``limit`` rows, however deep the page.
    """
    rows = df
    if last is not None:
        at = F.lit(last[0]).cast(df.schema[newest].dataType)
        rows = rows.where(F.col(newest) <= at).where((F.col(newest) < at) | (F.col(key) > last[1]))
    return rows.orderBy(F.desc(newest), key).limit(bounded(limit, 1, 100))


def page(df: DataFrame, newest: str, key: str, limit: int, offset: int) -> DataFrame:
    """A page, newest first, with the number of all rows on each row.

    An offset keeps all the rows before it in every task, so it is refused beyond ``MAX_OFFSET``; deeper pages
    go by key (:func:`page_after`).
    """
    limit, offset = bounded(limit, 1, 100), bounded(offset, 0, MAX_OFFSET)
    shown = df.orderBy(F.desc(newest), key).offset(offset).limit(limit)
    return shown.withColumn("total", _rows(df))


def page_anomalies(anomalies: DataFrame, limit: int = 10, offset: int = 0, status: str | None = None) -> DataFrame:
    if status is not None and status not in ("open", "acknowledged"):
        raise ValueError("status is open or acknowledged")
    rows = anomalies if status is None else anomalies.where(F.col("status") == status)
    return page(rows, "detected_at", "anomaly_id", limit, offset)


def page_reports(reports: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    return page(reports, "created_at", "anomaly_id", limit, offset)


def anomaly_feed(anomalies: DataFrame, n: int = 5) -> DataFrame:
    """The latest anomalies with the drop relative to the expected revenue."""
    actual, expected = F.col("actual_revenue").cast("double"), F.col("expected_revenue").cast("double")
    drop = F.when(expected > 0, (expected - actual) / expected * 100.0).otherwise(F.lit(0.0))
    return anomalies.orderBy(F.desc("detected_at"), "anomaly_id").limit(n).withColumns({
        "drop_pct": F.round(F.abs(drop), 1), "direction": F.when(actual < expected, F.lit("DROP")).otherwise(F.lit("SPIKE")),
    })


def report_feed(reports: DataFrame, n: int = 10) -> DataFrame:
    """The latest reports with a confidence band and the loss as part of the expected revenue."""
    sure, expected = F.col("confidence").cast("double"), F.col("expected_revenue").cast("double")
    band = F.when(sure < 0.4, F.lit("low")).when(sure < 0.7, F.lit("medium")).otherwise(F.lit("high"))
    share = F.when(expected > 0, F.round(F.col("estimated_loss").cast("double") / expected * 100.0, 1))
    return reports.orderBy(F.desc("created_at"), "anomaly_id").limit(n).withColumns({
        "confidence_band": band, "loss_pct": share,
    })


def read_since(anomalies: DataFrame, last_key: tuple[str, str] | None, n: int = 50) -> DataFrame:
    """The next ``n`` rows after ``last_key`` = (detected_at, anomaly_id), oldest first."""
    rows = anomalies
    if last_key is not None:
        at = F.lit(last_key[0]).cast(anomalies.schema["detected_at"].dataType)
        # The first test alone can be pushed into the scan.
        rows = rows.where(F.col("detected_at") >= at).where(
            (F.col("detected_at") > at) | (F.col("anomaly_id") > last_key[1])
        )
    return rows.orderBy("detected_at", "anomaly_id").limit(n)


def rollup_step(stored: DataFrame | None, entering: DataFrame, leaving: DataFrame, key: str = "category") -> DataFrame:
    """(key, cents, orders): the running sums after events enter and leave the last hour; keys without any go."""
    moves = entering.select(key, cents("total_amount").alias("cents"), F.lit(1).cast("long").alias("orders")).unionByName(
        leaving.select(key, (-cents("total_amount")).alias("cents"), F.lit(-1).cast("long").alias("orders")))
    moved = moves.groupBy(key).agg(F.sum("cents").alias("cents"), F.sum("orders").alias("orders"))
    whole = moved if stored is None else stored.select(key, "cents", "orders").unionByName(moved).groupBy(key).agg(F.sum("cents").alias("cents"), F.sum("orders").alias("orders"))
    return whole


def rollup_rows(sums: DataFrame, key: str = "category") -> DataFrame:
    """Revenue, orders and mean order value of the running sums, as ``category_revenue_1h`` has them."""
    return sums.where("orders > 0").select(key, from_cents("cents").alias("revenue_1h"), F.col("orders").alias("order_count_1h"),
                                           mean_of_cents(F.col("cents"), F.col("orders")).alias("avg_order_value"))
