"""Every operator as a query over the test tables.

``QUERIES`` maps a name to a function of (spark, sf_dir).  Results are brought to plain
types: decimals as doubles, times without zone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpulse import fixed
from revpulse.functions import seasonal
from revpulse.functions.moments import between_lookback, latest, lookback, window_start
from revpulse.operators import (
    baseline, deadletter, detect, drift, ingest, investigate, lifecycle, ml, serving, tables, telemetry, windows,
)
from revpulse.sources import keyed, letters, models, orders, retention, rollup, warehouse
from revpulse.sources.views import Views
from revpulse.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Callable[[Views], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(Views(spark, sf_dir)))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# --- ingest --------------------------------------------------------------------------

@query
def parse_order_events(v):
    return orders.parse_order_events(v.order_wire).drop("value").withColumn(
        "_corrupt_record", F.col("_corrupt_record").isNotNull()
    ).withColumnRenamed("_corrupt_record", "corrupt")


def _checked(v):
    return ingest.validate_events(orders.parse_order_events(v.order_wire))


@query
def validate_events(v):
    return _checked(v).groupBy(F.array_join("failed_checks", ",").alias("failed_checks")).agg(F.count("*").alias("messages"))


@query
def route_good_events(v):
    good, _ = ingest.route_dead_letters(_checked(v))
    return good


@query
def route_dead_letters(v):
    _, dead = ingest.route_dead_letters(_checked(v))
    return dead.select("dlq_id", "event_data", "error", "retry_count", "resolved")


@query
def dedup_events(v):
    return ingest.dedup_events(v.order_lines)


@query
def partition_by_region(v):
    return orders.partition_by_region(v.order_events).select("region", "event_timestamp", "event_id", "total_amount")


@query
def shard_of(v):
    zones = {"Delhi": "North-India", "Karnataka": "South-India", "Maharashtra": "West-India", "West Bengal": "East-India"}
    zone = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in zones.items() for x in p]), F.col("region")), F.lit("elsewhere"))
    return v.order_events.groupBy(orders.shard_of(zone).alias("shard")).agg(F.count("*").alias("events"))


# --- windows -------------------------------------------------------------------------

@query
def revenue_metrics(v):
    return v.revenue_metrics


@query
def revenue_metrics_daily_lines(v):
    return windows.revenue_metrics(v.order_lines.withColumn("order_id", F.col("event_id")), "1 day")


@query
def features_5m(v):
    return windows.features(v.order_events, "5 minutes").drop("avg_order_value")


@query
def features_15m(v):
    return windows.features(v.order_events, "15 minutes")


@query
def features_60m(v):
    return windows.features(v.order_events, "60 minutes").drop("avg_order_value")


@query
def feature_store(v):
    return v.feature_store


@query
def merge_features(v):
    return windows.feature_store(v.order_events, two_level=False)


# --- keyed tables ---------------------------------------------------------------------

def _halves(v, df, column):
    """Older and newer part of a table, overlapping by a week."""
    older = df.where(F.col(column) < _point(v, df, column, "-10 DAYS"))
    newer = lookback(df, column, v.as_of, "17 DAYS")
    return older, newer


def _point(v, df, column, shift):
    from revpulse.functions.moments import moment

    return moment(v.as_of, df, column, shift)


@query
def upsert(v):
    older, newer = _halves(v, v.revenue_metrics, "window_start")
    changed = newer.withColumn("order_count", F.col("order_count") + 1)
    return tables.upsert(older, changed, ["window_start", "window_end", "category", "region"],
                         ["order_count", "total_revenue", "avg_order_value"], newest=[])


@query
def upsert_partial(v):
    older, newer = _halves(v, v.feature_store, "computed_at")
    part = newer.select("computed_at", "category", "region", F.col("revenue_last_5m") * 2, F.col("orders_last_5m"))
    part = part.toDF("computed_at", "category", "region", "revenue_last_5m", "orders_last_5m")
    return tables.upsert(older, part, ["computed_at", "category", "region"], ["revenue_last_5m", "orders_last_5m"], newest=[],
                         defaults={c: 0 for c in (*windows.FEATURE_COLUMNS, "revenue_trend_pct")})


@query
def insert_if_absent(v):
    older, newer = _halves(v, v.anomalies, "window_start")
    return tables.insert_if_absent(older, newer, detect.WINDOW_KEY)


def _stored(v, rows, keys, time):
    table = keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "keyed"), keys, time=time)
    table.insert(keyed.held(rows))
    return table


@query
def upsert_table(v):
    """As ``upsert``, on a stored table of which only the touched days are read."""
    older, newer = _halves(v, v.revenue_metrics, "window_start")
    table = _stored(v, older, ["window_start", "window_end", "category", "region"], "window_start")
    changed = keyed.held(newer.withColumn("order_count", F.col("order_count") + 1))
    table.upsert(changed, ["order_count", "total_revenue", "avg_order_value"])
    return table.read()


@query
def upsert_partial_table(v):
    older, newer = _halves(v, v.feature_store, "computed_at")
    keys = ["computed_at", "category", "region"]
    table = _stored(v, older, keys, "computed_at")
    part = keyed.held(newer.select(*keys, (F.col("revenue_last_5m") * 2).alias("revenue_last_5m"), "orders_last_5m"))
    table.upsert(part, ["revenue_last_5m", "orders_last_5m"], defaults={c: 0 for c in (*windows.FEATURE_COLUMNS, "revenue_trend_pct")})
    return table.read()


@query
def insert_table(v):
    older, newer = _halves(v, v.anomalies, "window_start")
    table = _stored(v, older, detect.WINDOW_KEY, "window_start")
    table.insert(keyed.held(newer))
    return table.read()


@query
def archive_table(v):
    """As ``archive_events``, on stored tables: put into the archive, removed from the table."""
    table = _stored(v, v.order_events, ["event_id"], "event_timestamp")
    archive = keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "archive"), ["event_id"], time="event_timestamp")
    table.move_older(_cutoff(v), archive)
    kept, moved = table.read(), archive.read()
    return _sides(["kept", "archived"], (kept, kept.limit(0) if moved is None else moved), ["event_id", "event_timestamp"])


@query
def archive_anomalies_table(v):
    """As ``archive_anomalies``, on stored tables."""
    table = keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "anomalies"), detect.WINDOW_KEY, time="detected_at")
    archive = keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "archive"), detect.WINDOW_KEY, time="detected_at")
    reports = keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "reports"), ["anomaly_id", "created_at"], time="created_at")
    table.insert(keyed.held(v.anomalies))
    reports.insert(keyed.held(v.copilot_reports))
    retention.archive_anomalies(table, archive, reports, _cutoff(v))
    return _sides(["kept", "archived", "reports"], (table.read(), archive.read(), reports.read()), ["anomaly_id", "category", "region"])


def _cutoff(v):
    return v.as_of.select((F.col(v.as_of.columns[0]) - F.expr("INTERVAL 12 DAYS")).cast("string")).first()[0]


@query
def append_rows(v):
    path = warehouse.fresh_path(v.spark, "append")
    older, newer = _halves(v, v.copilot_reports, "created_at")
    warehouse.append_rows(older, path)
    warehouse.append_rows(newer, path)
    return warehouse.read_warehouse(v.spark, path)


@query
def read_warehouse(v):
    lines = warehouse.read_warehouse(v.spark, f"{v.sf_dir}/lineitem.parquet")
    return lines.groupBy("l_returnflag").agg(
        F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")), 2).alias("revenue")
    )


@query
def training_csv(v):
    rows = ml.label_windows(v.revenue_metrics, v.anomalies, v.as_of, v.days)
    path = warehouse.fresh_path(v.spark, "training-csv")
    warehouse.write_training_csv(baseline.engineer_features(rows), path)
    return warehouse.read_training_csv(v.spark, path)


@query
def write_monthly(v):
    path = warehouse.fresh_path(v.spark, "monthly")
    warehouse.write_monthly(v.order_lines, path)
    return v.spark.read.parquet(path).select(*v.order_lines.columns, "event_month")


@query
def prune_months(v):
    rows = warehouse.with_month(v.order_lines)
    return warehouse.prune_months(rows, "1997-03-15 00:00:00", "1998-02-10 00:00:00").groupBy("event_month").agg(
        F.count("*").alias("rows")
    )


@query
def read_since(v):
    return serving.read_since(v.anomalies, ("2024-01-15 12:00:00", ""))


# --- baseline and detection ---------------------------------------------------------------

@query
def engineer_features(v):
    return v.engineered


@query
def unscored_windows(v):
    return detect.unscored_windows(v.revenue_metrics, v.anomalies, v.as_of, v.minutes)


@query
def unscored_windows_newest(v):
    return detect.unscored_windows(v.revenue_metrics, v.anomalies, v.as_of, v.minutes, limit=500)


@query
def rule_anomalies(v):
    return v.anomalies


@query
def detection_job(v):
    known = v.anomalies.where(F.col("status") == "acknowledged")
    return detect.detection_job(v.revenue_metrics, known, v.as_of, minutes=v.minutes)


@query
def critical_alerts(v):
    return detect.critical_alerts(v.anomalies)


@query
def severity_rank(v):
    return v.anomalies.groupBy(seasonal.severity_rank(F.col("severity")).alias("severity_rank"), "severity").agg(
        F.count("*").alias("anomalies")
    )


@query
def status_domain(v):
    return v.anomalies.groupBy("status").agg(
        F.count_if(ingest.status_in_domain(F.col("status"))).alias("valid"), F.count("*").alias("rows")
    )


# --- training ----------------------------------------------------------------------------

def _labelled(v):
    return ml.label_windows(v.revenue_metrics, v.anomalies, v.as_of, v.days)


@query
def label_windows(v):
    return _labelled(v)


@query
def class_balance(v):
    return ml.class_balance(_labelled(v))


@query
def classification_report(v):
    rows = baseline.engineer_features(_labelled(v)).select(
        F.col("is_anomaly").alias("label"),
        F.when(seasonal.severity(F.col("revenue_ratio")) == "critical", F.lit(1)).otherwise(F.lit(0)).alias("prediction"),
    )
    return ml.classification_report(rows)


@query
def score_windows(v):
    """Windows held back from the training, scored by the model as it was saved."""
    labelled = baseline.engineer_features(_labelled(v))
    model, _ = ml.train(labelled, trees=10)
    path = warehouse.fresh_path(v.spark, "models")
    model.write().save(path)
    saved = type(model).load(path)
    return detect.score_windows(saved, ml.split(labelled)[1]).select(
        *detect.METRIC_COLUMNS, "expected_revenue", "revenue_ratio", "anomaly_score", "severity"
    )


@query
def data_fingerprint(v):
    return ml.data_fingerprint(_labelled(v))


def _candidate(v):
    newest = v.model_registry.orderBy(F.desc("version")).limit(1)
    return v.model_registry.join(newest.select("version"), "version", "left_anti").select(*v.model_registry.columns), newest


@query
def promotion_gate(v):
    former, newest = _candidate(v)
    return ml.promotion_gate(former, newest, min_samples=100)


@query
def rollback(v):
    return ml.rollback(v.model_registry, "20240112_000000")


@query
def model_versions(v):
    return ml.model_versions(v.model_registry)


@query
def registry_cycle(v):
    """The stored registry: every model is saved and offered for production in turn, then the last promotion is rolled back."""
    registry = models.ModelRegistry(v.spark, warehouse.fresh_path(v.spark, "registry"))
    rows = keyed.held(v.model_registry)
    registry.add(rows)
    for r in rows.select("version").orderBy("version").collect():
        registry.promote(r["version"], min_samples=100)
    registry.rollback()
    return registry.rows().select("version", "f1", "status")


# --- drift ---------------------------------------------------------------------------------

@query
def scored_windows(v):
    return drift.scored_windows(v.revenue_metrics, v.anomalies, v.as_of, v.days * 24)


@query
def score_stats(v):
    row = drift.score_stats(drift.scored_windows(v.revenue_metrics, v.anomalies, v.as_of, v.days * 24))
    return row.select("windows", *[F.round(c, 8).alias(c) for c in ("anomaly_rate", "avg_score", "score_std")])


def _two_slices(v):
    older = between_lookback(v.revenue_metrics, "window_start", v.as_of, f"{v.days} DAYS", "10 DAYS")
    return older, lookback(v.revenue_metrics, "window_start", v.as_of, "10 DAYS")


@query
def percentile_edges(v):
    rows = v.revenue_metrics.withColumn("total_revenue", F.col("total_revenue").cast("double"))
    edges = drift.percentile_edges(rows, "total_revenue")
    return edges.select(F.posexplode("edges").alias("position", "edge")).withColumn("edge", F.round("edge", 6))


@query
def histogram(v):
    older, newer = _two_slices(v)

    def long(df, name):
        return df.select("category", F.col("total_revenue").cast("double").alias("value"), F.lit(name).alias("slice"))

    samples = long(older, "expected").unionByName(long(newer, "actual"))
    return drift.histogram(samples, ["category"])


@query
def psi(v):
    return drift.psi(*_two_slices(v), "total_revenue").select(F.round("psi", 6).alias("psi"))


@query
def psi_by_measure(v):
    return drift.psi_by_measure(*_two_slices(v), ["total_revenue", "order_count", "avg_order_value"]).select(
        "measure", F.round("psi", 6).alias("psi")
    )


@query
def drift_report(v):
    row = drift.drift_report(v.revenue_metrics, v.anomalies, v.as_of)
    digits = {"anomaly_rate": 8, "avg_score": 8, "score_std": 8, "psi_revenue": 6, "psi_order_count": 6}
    return row.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _drift_log(v):
    per_day = v.anomalies.groupBy(F.date_format("window_start", "yyyyMMdd").alias("day")).agg(
        F.max("window_end").alias("measured_at"), F.avg("anomaly_score").alias("avg_score"),
        F.avg((F.col("severity") == "critical").cast("double")).alias("anomaly_rate"),
        F.stddev_samp("anomaly_score").alias("score_std"),
    )
    return per_day.select(
        "measured_at", *[F.round(c, 4).alias(c) for c in ("anomaly_rate", "avg_score", "score_std")],
        F.round(F.col("anomaly_rate") / 4, 4).alias("psi_revenue"), (F.col("anomaly_rate") > 0.5).alias("drift_flag"),
        F.concat(F.lit("day "), "day").alias("notes"),
    )


@query
def drift_reports_stored(v):
    """The rows for 24 and 48 hours from the stored hourly summaries, of which each half was added apart."""
    table = keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "summaries"), ["hour", "measure", "value"], time="hour")
    for half in _halves_of_days(v.revenue_metrics):
        table.put(keyed.held(drift.summarise(half)))
    as_of = v.as_of.first()[0]
    stored = table.read(lambda day: day >= str(as_of - dt.timedelta(days=8))[:10])
    row = drift.drift_reports(stored, v.revenue_metrics, v.anomalies, as_of)
    digits = {"anomaly_rate": 8, "avg_score": 8, "score_std": 8, "psi_revenue": 6, "psi_order_count": 6}
    return row.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _halves_of_days(metrics):
    odd = F.dayofmonth("window_start") % 2 == 1
    return metrics.where(odd), metrics.where(~odd)


@query
def latest_drift(v):
    return drift.latest_drift(_drift_log(v))


@query
def log_drift(v):
    path = warehouse.fresh_path(v.spark, "drift-log")
    for hours in (24, 48):
        warehouse.append_rows(drift.drift_report(v.revenue_metrics, v.anomalies, v.as_of, hours), path)
    return warehouse.read_warehouse(v.spark, path).select("measured_at", "window_hours", "drift_flag", "notes")


# --- investigation ----------------------------------------------------------------------------

@query
def uninvestigated_anomalies(v):
    return investigate.uninvestigated_anomalies(v.anomalies, v.copilot_reports)


@query
def uninvestigated_anomalies_all(v):
    return investigate.uninvestigated_anomalies(v.anomalies, v.copilot_reports, limit=None)


@query
def open_anomalies(v):
    return investigate.open_anomalies(v.anomalies).withColumn("pct_deviation", F.round("pct_deviation", 4))


@query
def anomaly_context(v):
    return investigate.anomaly_context(v.anomalies).select(
        "anomaly_id", "loss", F.round("pct_deviation", 4).alias("pct_deviation"), "direction"
    )


@query
def revenue_by_category(v):
    return investigate.revenue_by_category(v.revenue_metrics, "Electronics", v.as_of, v.minutes)


@query
def revenue_by_region(v):
    return investigate.revenue_by_region(v.revenue_metrics, "Delhi", v.as_of, v.minutes)


@query
def product_order_volume(v):
    return investigate.product_order_volume(v.order_events, "Footwear", v.as_of, v.minutes)


@query
def product_order_volume_all(v):
    return investigate.product_order_volume(v.order_events, None, v.as_of, v.minutes)


@query
def order_trend(v):
    return investigate.order_trend(v.order_events, v.as_of, v.minutes, widest=v.minutes)


@query
def payment_breakdown(v):
    return investigate.payment_breakdown(v.order_events, v.as_of, v.minutes)


@query
def feature_snapshot(v):
    return investigate.feature_snapshot(v.feature_store)


@query
def investigation_bundle(v):
    return investigate.investigation_bundle(
        v.anomalies, v.copilot_reports, v.revenue_metrics, v.order_events, v.feature_store, v.as_of,
        limit=None, minutes=v.minutes, trend_minutes=v.minutes, widest=v.minutes,
    )


@query
def parse_reports(v):
    prose = v.table("documents").select(F.concat(F.lit("doc "), "doc_id").alias("anomaly_id"), F.col("text").alias("report_text"))
    return investigate.parse_reports(v.report_texts.unionByName(prose), v.anomalies).drop("full_report")


@query
def apply_reports(v):
    rows, _ = investigate.apply_reports(v.anomalies, investigate.parse_reports(v.report_texts, v.anomalies))
    return rows


@query
def acknowledged_anomalies(v):
    parsed = v.copilot_reports.where(F.col("confidence") > 0.5)
    reopened = v.anomalies.withColumn("status", F.lit("open"))
    _, marked = investigate.apply_reports(reopened, parsed.withColumns({
        "root_cause": F.lit(""), "recommended_action": F.lit(""), "full_report": F.lit(""),
    }).select("anomaly_id", "confidence", "estimated_loss", "root_cause", "recommended_action", "full_report"))
    return marked.groupBy("status", "region").agg(F.count("*").alias("anomalies"))


# --- serving ---------------------------------------------------------------------------------

def _no_metrics(v):
    """Metrics from before the streams started: none of them is recent."""
    return v.revenue_metrics.where(F.col("window_end") < F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query
def revenue_trend(v):
    return serving.revenue_trend(v.revenue_metrics, v.order_events, v.as_of, v.minutes)


@query
def revenue_trend_fallback(v):
    return serving.revenue_trend(_no_metrics(v), v.order_events, v.as_of, v.minutes)


@query
def category_revenue(v):
    return serving.category_revenue(v.revenue_metrics, v.order_events, v.as_of, v.minutes)


@query
def category_revenue_fallback(v):
    return serving.category_revenue(_no_metrics(v), v.order_events, v.as_of, v.minutes)


@query
def regional_revenue(v):
    return serving.regional_revenue(v.revenue_metrics, v.order_events, v.as_of, v.minutes)


@query
def kpis_api(v):
    return serving.kpis_api(v.revenue_metrics, v.anomalies, v.copilot_reports, v.as_of, 1440)


@query
def kpis_dashboard(v):
    return serving.kpis_dashboard(v.revenue_metrics, v.order_events, v.anomalies, v.copilot_reports, v.as_of, v.minutes)


@query
def kpis_dashboard_fallback(v):
    return serving.kpis_dashboard(_no_metrics(v), v.order_events, v.anomalies, v.copilot_reports, v.as_of, v.minutes)


@query
def metrics_summary(v):
    return serving.metrics_summary(v.anomalies, v.as_of)


@query
def anomaly_freshness(v):
    return serving.anomaly_freshness(v.anomalies, v.as_of)


@query
def dlq_stats(v):
    return serving.dlq_stats(v.dlq_events)


@query
def throughput(v):
    return serving.throughput(v.order_events, v.as_of, 60)


@query
def ingest_latency(v):
    return serving.ingest_latency(v.order_events, as_of=v.as_of)


@query
def system_health(v):
    return serving.system_health(v.order_events, v.anomalies, v.as_of)


@query
def system_health_stored(v):
    """The newest detection from the version file of the stored anomalies; none of them is read."""
    table = keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "anomalies"), detect.WINDOW_KEY, time="detected_at")
    table.insert(keyed.held(v.anomalies))
    return serving.system_health(v.order_events, table.stats()["newest"], v.as_of)


@query
def rollup_refresh(v):
    """``category_revenue_1h`` as a stored table, moved forward in ten steps of 25 minutes."""
    events = v.order_events
    now = v.as_of.first()[0]
    kept = rollup.Rollup(keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "rollup"), ["category"], buckets=1))
    for step in range(9, -1, -1):
        kept.refresh(events, now - dt.timedelta(minutes=25 * step))
    return kept.rows()


@query
def category_revenue_1h(v):
    return serving.category_revenue_1h(v.order_events, v.as_of)


@query
def anomalies_by_category(v):
    return serving.anomalies_by_category(v.anomalies)


@query
def anomalies_by_severity(v):
    return serving.anomalies_by_severity(v.anomalies, "1 hour")


@query
def page_anomalies(v):
    return serving.page_anomalies(v.anomalies, 25, 10, "open")


@query
def page_reports(v):
    return serving.page_reports(v.copilot_reports, 10, 5)


@query
def anomaly_feed(v):
    return serving.anomaly_feed(v.anomalies)


@query
def report_feed(v):
    return serving.report_feed(v.copilot_reports)


# --- retention and data quality -----------------------------------------------------------------

def _sides(names, frames, columns):
    parts = [df.select(F.lit(name).alias("side"), *columns) for name, df in zip(names, frames)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def archive_events(v):
    return _sides(["kept", "archived"], lifecycle.archive_events(v.order_events, v.as_of, 12), ["event_id", "event_timestamp"])


@query
def archive_anomalies(v):
    parts = lifecycle.archive_anomalies(v.anomalies, v.copilot_reports, v.as_of, 12)
    return _sides(["kept", "archived", "reports"], parts, ["anomaly_id", "category", "region"])


@query
def drop_month_folder(v):
    """The same on a stored monthly table: the month's folder goes, and no row is read."""
    path = warehouse.fresh_path(v.spark, "monthly")
    warehouse.write_monthly(v.order_lines, path, mode="overwrite")
    newest = latest(v.order_lines, "event_timestamp")
    gone = newest.select(lifecycle.month_name(F.add_months(F.col(newest.columns[0]), -6))).first()[0]
    warehouse.drop_month(v.spark, path, gone)
    return lifecycle.partition_report(v.spark.read.parquet(path))


@query
def partition_bytes(v):
    """Which months have files, from listings alone; sizes depend on the writer."""
    path = warehouse.fresh_path(v.spark, "monthly")
    warehouse.write_monthly(v.order_lines, path, mode="overwrite")
    return lifecycle.partition_bytes(v.spark, path).select("event_month", (F.col("bytes") > 0).alias("stored"))


@query
def drop_old_month(v):
    lines = v.order_lines
    kept = lifecycle.drop_old_month(lines, latest(lines, "event_timestamp"), 6)
    return lifecycle.partition_report(kept)


@query
def purge_features(v):
    return lifecycle.purge_features(v.feature_store, latest(v.feature_store, "computed_at"), 240)


@query
def partition_report(v):
    return lifecycle.partition_report(v.order_lines)


@query
def next_partition_bounds(v):
    return lifecycle.next_partition_bounds(v.spark, v.as_of)


@query
def window_gaps(v):
    return lifecycle.window_gaps(v.revenue_metrics)


@query
def window_gaps_filled(v):
    return lifecycle.window_gaps(v.revenue_metrics, 48, fill=True)


def _tables(v, anomalies=None):
    return {
        "order_events": v.order_events, "revenue_metrics": v.revenue_metrics,
        "anomalies": v.anomalies if anomalies is None else anomalies, "copilot_reports": v.copilot_reports,
    }


@query
def table_counts(v):
    return lifecycle.table_counts(_tables(v))


@query
def stored_counts(v):
    """Rows of the stored tables, from the footers of their files."""
    return lifecycle.stored_counts(v.spark, {name: f"{v.sf_dir}/{name}.parquet" for name in ("events", "orders", "lineitem", "customer")})


@query
def latest_by_table(v):
    return lifecycle.latest_by_table({
        "Latest order event": (v.order_events, "event_timestamp"),
        "Latest anomaly": (v.anomalies, "detected_at"), "Latest report": (v.copilot_reports, "created_at"),
    })


def _after_purge(v):
    return lookback(v.anomalies, "detected_at", v.as_of, "12 DAYS")


@query
def orphaned_reports(v):
    return lifecycle.orphaned_reports(v.copilot_reports, _after_purge(v)).select("anomaly_id", "created_at", "category", "region")


@query
def integrity_checks(v):
    return lifecycle.integrity_checks(_tables(v, _after_purge(v)))


@query
def config_audit(v):
    return lifecycle.config_audit(v.config_versions)


@query
def config_audit_feed(v):
    """The audit of the last three days' settings from the change feed of the stored configuration."""
    table = keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "config"), ["key"], buckets=1)
    rows = keyed.held(v.config_versions)
    for day in sorted(r[0] for r in rows.select("updated_at").distinct().orderBy(F.desc("updated_at")).limit(3).collect()):
        table.upsert(rows.where(F.col("updated_at") == F.lit(day)), feed=True)
    return lifecycle.config_audit_from(table.changes())


@query
def current_config(v):
    return lifecycle.current_config(v.config_versions)


@query
def mask_secrets(v):
    return lifecycle.mask_secrets(v.table("documents").select("doc_id", "text"), "text")


# --- dead letters ----------------------------------------------------------------------------------

@query
def dlq_retry_batch(v):
    return deadletter.dlq_retry_batch(v.dlq_events).select("dlq_id", "retry_count", "first_failed")


@query
def retry_dead_letters(v):
    _, after = deadletter.retry_dead_letters(v.dlq_events, v.as_of)
    return after.drop("event_data")


@query
def recovered_dead_letters(v):
    recovered, _ = deadletter.retry_dead_letters(v.dlq_events, v.as_of)
    return recovered


@query
def dead_letter_cycle(v):
    """Three rounds of the retry on stored tables: the letters afterwards, with whether their event has landed."""
    folder = warehouse.fresh_path(v.spark, "letters")
    table = keyed.StoredTable(v.spark, f"{folder}/letters", ["dlq_id"], time="first_failed")
    events = keyed.StoredTable(v.spark, f"{folder}/orders", ["event_id"], time="event_timestamp")
    letters.store_letters(table, v.dlq_events)
    for batch_id in range(3):
        letters.retry_stored(table, events, batch_id, v.as_of)
    n = F.col("dlq_id").cast("long").cast("string")
    landed = events.read().select(F.col("event_id").alias("id"), F.lit(True).alias("here"))
    return table.read().join(landed, n == F.col("id"), "left").select("dlq_id", "retry_count", "resolved", F.coalesce("here", F.lit(False)).alias("landed"))


@query
def exhausted_dead_letters(v):
    return deadletter.exhausted_dead_letters(v.dlq_events).select("dlq_id", "retry_count", "first_failed")


# --- telemetry ---------------------------------------------------------------------------------------

@query
def consecutive_failures(v):
    return telemetry.consecutive_failures(v.batch_log, threshold=2)


@query
def counter_increase(v):
    return telemetry.counter_increase(v.metric_samples, 15, "5 minutes").withColumn("rate", F.round("rate", 6))


@query
def events_per_minute(v):
    return telemetry.events_per_minute(v.metric_samples).withColumn("events_per_minute", F.round("events_per_minute", 6))


_VALUE_BOUNDS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]


@query
def bucket_histogram(v):
    rows = telemetry.bucket_histogram(v.table("events"), "value", fixed.REPORT_BOUNDS, ["event_type"])
    return rows.withColumn("total_value", F.round("total_value", 2)).withColumn(
        "le", F.when(F.col("le") == float("inf"), F.lit("+Inf")).otherwise(F.format_string("%.1f", F.col("le")))
    )


@query
def histogram_quantile(v):
    buckets = telemetry.bucket_histogram(v.table("events"), "value", fixed.REPORT_BOUNDS, ["event_type"])
    return telemetry.histogram_quantile(buckets, 0.95, ["event_type"]).withColumn("quantile", F.round("quantile", 6))


@query
def anomaly_rate_alert(v):
    return telemetry.anomaly_rate_alert(v.order_events, v.anomalies, clamp_min=0.01).withColumn(
        "anomaly_rate", F.round("anomaly_rate", 6)
    )


@query
def sustained_breach(v):
    cond = v.revenue_metrics.groupBy("category", "window_start").agg(
        F.sum("order_count").alias("orders")
    ).select("category", "window_start", (F.col("orders") < 2).alias("breach"))
    return telemetry.sustained_breach(cond, "10 MINUTES", by=["category"])


@query
def error_spike_alert(v):
    return telemetry.error_spike_alert(v.metric_samples, 15, 40.0).drop("rate")


@query
def total_alert(v):
    return telemetry.total_alert(v.metric_samples, 250.0)


@query
def counter_increase_5m(v):
    return telemetry.counter_increase(v.metric_samples, 5).drop("rate")


@query
def windowed_quantile(v):
    """The 95th percentile of every hour, from the buckets of that hour."""
    events = v.table("events").withColumn("hour", window_start("ts", "1 hour"))
    buckets = telemetry.bucket_histogram(events, "value", fixed.REPORT_BOUNDS, ["event_type", "hour"])
    return telemetry.histogram_quantile(buckets, 0.95, ["event_type", "hour"]).withColumn("quantile", F.round("quantile", 6))


@query
def alert_states(v):
    rate = telemetry.anomaly_rate_alert(v.order_events, v.anomalies, clamp_min=0.01).select(
        F.lit("all").alias("label"), F.col("window_start").alias("at"), "breach")
    spikes = telemetry.error_spike_alert(v.metric_samples, 15, 40.0).select("label", F.col("window_end").alias("at"), "breach")
    return telemetry.alert_states({
        "produce_errors": (telemetry.value_breaches(v.metric_samples, 250.0), "1 MINUTE", "1 HOUR"),
        "anomaly_rate": (rate, "5 MINUTES", "5 MINUTES"),
        "reconnects": (telemetry.value_breaches(v.metric_samples, 0.0), "1 MINUTE", "1 HOUR"),
        "error_spike": (spikes, "1 HOUR", "1 MINUTE"),
    })


@query
def alert_state_steps(v):
    """The states of two alerts, carried through ten evaluations of which each reads only the samples since the one before."""
    samples = v.metric_samples
    low, high = samples.agg(F.min("ts"), F.max("ts")).first()
    table = keyed.StoredTable(v.spark, warehouse.fresh_path(v.spark, "alerts"), ["alert", "label"], buckets=1)
    for step in range(10):
        since, until = low + (high - low) * step / 10, low + (high - low) * (step + 1) / 10
        new = samples.where((F.col("ts") > F.lit(since) if step else F.lit(True)) & (F.col("ts") <= F.lit(until) if step < 9 else F.lit(True)))
        rules = {"produce_errors": (telemetry.value_breaches(new, 250.0), "1 MINUTE", "1 HOUR"), "reconnects": (telemetry.value_breaches(new, 0.0), "1 MINUTE", "1 HOUR")}
        table.put(keyed.held(telemetry.alert_step(table.read(), rules)))
    return table.read().drop("breach")


# --- streaming: the same tables through Structured Streaming ----------------------------------------

SLICES, FILES = 10, 2  # micro-batches of a test feed, and the least files of each
FILE_ROWS = 100_000  # from here on a micro-batch has more files


def _write_feed(v, write):
    """Hands ``write`` the events in time-ordered slices, one after the other: with repeats inside a slice, and with repeats
    of rows two slices old, which are too late for any watermark.  Returns the number of files of a slice, the same for all.

    The events are read once and put down by slice, so a slice costs what lies in it.
    """
    events = v.table("events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / SLICES
    number = F.lit(SLICES - 1)
    for i in reversed(range(SLICES - 1)):
        number = F.when(F.col("ts") < F.lit(low + (i + 1) * step), i).otherwise(number)
    path = warehouse.fresh_path(v.spark, "slices")
    events.where("ts is not null").withColumn("__slice", number).write.partitionBy("__slice").parquet(path)
    stored = v.spark.read.schema(T.StructType([*events.schema.fields, T.StructField("__slice", T.IntegerType())])).parquet(path)
    sizes = {r["__slice"]: r["count"] for r in stored.groupBy("__slice").count().collect()}
    files = max(FILES, min(sizes.get(i, 0) for i in range(SLICES)) // FILE_ROWS)
    for i in range(SLICES):
        def between(a):
            return stored.where(F.col("__slice") == a).drop("__slice")

        part = between(i)
        part = part.unionByName(part.where("event_id % 50 = 0"))
        if i > 1:
            part = part.unionByName(between(i - 2).where("event_id % 70 = 0"))
        write(part.repartition(files))
    return files


def _drain(v, start):
    """Runs one streaming query over the feed to its end; returns its sink folder."""
    folder = warehouse.fresh_path(v.spark, "stream")
    files = _write_feed(v, lambda part: part.write.mode("append").parquet(f"{folder}/feed"))
    events = v.spark.readStream.schema(v.table("events").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/feed")
    clean = streams.clean_events(v.orders_from(events).drop("ingested_at"))
    streams.await_streams([start(clean, f"{folder}/tables", f"{folder}/checkpoints", {"availableNow": True})])
    return f"{folder}/tables"


def _message_feed(v, folder):
    def write(part):
        v.wire_of(part).select("value").write.mode("append").text(f"{folder}/messages")

    return _write_feed(v, write)


@query
def stream_dead_letters(v):
    folder = warehouse.fresh_path(v.spark, "stream")
    v.order_wire.select("value").write.text(f"{folder}/messages")
    checked = ingest.validate_events(orders.parse_order_events(orders.read_order_stream(v.spark, f"{folder}/messages")))
    _, dead = ingest.route_dead_letters(checked)
    streams.await_streams([streams.start_dead_letters(dead, f"{folder}/tables", f"{folder}/checkpoints", {"availableNow": True})])
    return warehouse.read_warehouse(v.spark, f"{folder}/tables/dlq_events").select("dlq_id", "event_data", "error", "retry_count", "resolved")


@query
def stream_revenue_metrics(v):
    return streams.current_metrics(v.spark, _drain(v, streams.start_revenue_metrics))


@query
def stream_feature_store(v):
    return streams.current_features(v.spark, _drain(v, streams.start_revenue_metrics))


@query
def stream_order_events(v):
    return streams.current_orders(v.spark, _drain(v, streams.start_order_events)).drop("ingested_at")


@query
def stream_detection(v):
    """Windows graded once each, when the watermark closes them."""
    return streams.current_anomalies(v.spark, _drain(v, streams.start_detection))


@query
def supervised_batches(v):
    """The log of a sink that fails four times on its third batch, and is restarted each time."""
    folder = warehouse.fresh_path(v.spark, "batches")
    files = _write_feed(v, lambda part: part.write.mode("append").parquet(f"{folder}/feed"))
    feed = v.spark.readStream.schema(v.table("events").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/feed")
    left = [4]

    def sink(batch, batch_id):
        if batch_id == 2 and left[0]:
            left[0] -= 1
            raise ValueError("the third batch fails")
        batch.write.format("noop").mode("overwrite").save()

    def start():
        return feed.writeStream.foreachBatch(sink).queryName("shaky").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

    with streams.BatchLog(v.spark, f"{folder}/log", ["shaky"]):
        streams.supervise({"shaky": start}, backoff=0.1)
    return streams.batch_log(v.spark, f"{folder}/log").select("sink", "batch_id", "input_rows", "failed")


@query
def run_streams(v):
    """All three queries on one source of messages; rows of the tables they keep."""
    folder = warehouse.fresh_path(v.spark, "streams")
    files = _message_feed(v, folder)
    tables_at = f"{folder}/tables"
    streams.await_streams(streams.run_streams(
        v.spark, f"{folder}/messages", tables_at, f"{folder}/checkpoints", {"availableNow": True}, max_per_trigger=files))
    dead = warehouse.read_warehouse(v.spark, f"{tables_at}/dlq_events")
    return lifecycle.table_counts({
        "order_events": streams.current_orders(v.spark, tables_at), "revenue_metrics": streams.current_metrics(v.spark, tables_at),
        "feature_store": streams.current_features(v.spark, tables_at), "dlq_events": dead.select("dlq_id").distinct(),
    })


@query
def batch_log(v):
    """The log of a stream whose third batch fails."""
    folder = warehouse.fresh_path(v.spark, "batches")
    files = _write_feed(v, lambda part: part.write.mode("append").parquet(f"{folder}/feed"))
    feed = v.spark.readStream.schema(v.table("events").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/feed")

    def sink(batch, batch_id):
        if batch_id == 2:
            raise ValueError("the third batch fails")
        batch.write.format("noop").mode("overwrite").save()

    with streams.BatchLog(v.spark, f"{folder}/log", ["failing"]):
        failing = feed.writeStream.foreachBatch(sink).queryName("failing").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        try:
            failing.awaitTermination()
        except StreamingQueryException:
            pass  # it is meant to fail; the log tells of it
    return streams.batch_log(v.spark, f"{folder}/log").select("sink", "batch_id", "input_rows", "failed")
