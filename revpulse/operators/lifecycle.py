"""Retention, layout and audit of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revpulse.functions import text
from revpulse.functions.moments import AsOf, lookback, moment, window_start
from revpulse.plans.ordered import with_previous
from revpulse.sources.warehouse import with_month


def split_by_age(df: DataFrame, column: str, as_of: AsOf, span: str) -> tuple[DataFrame, DataFrame]:
    """(kept, older); every row is in exactly one, rows without a time are kept."""
    old = F.coalesce(F.col(column) < moment(as_of, df, column, f"-{span}"), F.lit(False))
    return df.where(~old), df.where(F.col(column) < moment(as_of, df, column, f"-{span}"))


def archive_events(events: DataFrame, as_of: AsOf, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) order events."""
    return split_by_age(events, "event_timestamp", as_of, f"{days} DAYS")


def cascade_delete(reports: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The reports whose anomaly is still there."""
    return reports.join(anomalies.select("anomaly_id"), "anomaly_id", "left_semi").select(*reports.columns)


def archive_anomalies(anomalies: DataFrame, reports: DataFrame, as_of: AsOf, days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept anomalies, archived anomalies, reports of the kept ones)."""
    kept, archived = split_by_age(anomalies, "detected_at", as_of, f"{days} DAYS")
    return kept, archived, cascade_delete(reports, kept)


def month_name(moment_column: Column) -> Column:
    return F.date_format(moment_column, "yyyy_MM")


def drop_old_month(events: DataFrame, as_of: AsOf, months: int = 6) -> DataFrame:
    """All rows but those of the one calendar month ``months`` back.

    On the monthly layout this is a folder predicate.
    """
    stored = "event_month" in events.columns
    rows = events if stored else with_month(events)
    gone = month_name(F.add_months(moment(as_of, events, "event_timestamp"), -months))
    kept = rows.where(F.col("event_month") != gone)
    return kept if stored else kept.drop("event_month")


def purge_features(feature_store: DataFrame, as_of: AsOf, hours: int = 2) -> DataFrame:
    return lookback(feature_store, "computed_at", as_of, f"{hours} HOURS")


def partition_report(events: DataFrame) -> DataFrame:
    """Rows and time range per month."""
    rows = events if "event_month" in events.columns else with_month(events)
    return rows.groupBy("event_month").agg(
        F.count("*").alias("rows"), F.min("event_timestamp").alias("first_event"), F.max("event_timestamp").alias("last_event")
    ).orderBy("event_month")


def partition_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per month folder of a monthly table, from file listings alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet"
    ).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"event_month=([^/]+)/", 1).alias("event_month")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    ).orderBy(F.desc("bytes"))


def next_partition_bounds(spark: SparkSession, as_of: AsOf) -> DataFrame:
    """Name and half-open range of the month after ``as_of``."""
    if isinstance(as_of, DataFrame):
        now = as_of.select(F.col(as_of.columns[0]).alias("now"))
    else:
        now = spark.range(1).select(F.lit(str(as_of)).cast("timestamp").alias("now"))
    start = F.trunc(F.add_months("now", 1), "MM")
    return now.select(
        F.concat(F.lit("order_events_"), month_name(start)).alias("partition_name"),
        start.cast("string").alias("start_date"), F.add_months(start, 1).cast("string").alias("end_date"),
    )


def window_gaps(metrics: DataFrame, hours: int = 24, fill: bool = False) -> DataFrame:
    """Metric rows per hour, the newest ``hours`` hours that have any.

    With ``fill`` the last ``hours`` clock hours are listed instead, empty ones with 0.
    """
    counted = metrics.groupBy(window_start("window_start", "1 hour").alias("hour")).agg(F.count("*").alias("windows"))
    if not fill:
        return counted.orderBy(F.desc("hour")).limit(hours)
    newest = counted.agg(F.max("hour").alias("last"))
    spine = newest.select(F.explode(F.sequence(
        F.col("last") - F.make_dt_interval(hours=F.lit(hours - 1)), F.col("last"), F.expr("INTERVAL 1 HOUR")
    )).alias("hour"))
    return spine.join(counted, "hour", "left").select("hour", F.coalesce("windows", F.lit(0)).alias("windows")).orderBy(F.desc("hour"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return _stack(parts)


def stored_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows per stored Parquet table, from the files' footers: no row group is read.

    Pushing the count down takes the newer Parquet reader, which is set for these reads only, in a session of their own."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return table_counts({name: own.read.parquet(path) for name, path in paths.items()})


def latest_by_table(columns: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Newest time per table, as text."""
    parts = [
        df.agg(F.max(c).cast("string").alias("latest")).select(F.lit(name).alias("check_type"), "latest")
        for name, (df, c) in columns.items()
    ]
    return _stack(parts)


def orphaned_reports(reports: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Reports that name an anomaly which does not exist."""
    return reports.where(F.col("anomaly_id").isNotNull()).join(anomalies.select("anomaly_id"), "anomaly_id", "left_anti")


def integrity_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """(check_name, value) over ``order_events``, ``revenue_metrics``, ``anomalies``, ``copilot_reports``.

    One pass over each table gives its rows and its newest time; the orphans take a join.
    """
    times = {"order_events": ("order event", "event_timestamp"), "anomalies": ("anomaly", "detected_at"), "copilot_reports": ("report", "created_at")}
    passes = []
    for name, df in tables.items():
        label, column = times.get(name, (None, None))
        checks = [F.struct(F.lit(f"rows: {name}").alias("check_name"), F.count("*").cast("string").alias("value"))]
        if label:
            checks.append(F.struct(F.lit(f"latest: {label}").alias("check_name"), F.max(column).cast("string").alias("value")))
        passes.append(df.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).select("c.*"))
    lost = orphaned_reports(tables["copilot_reports"], tables["anomalies"]).agg(
        F.count("*").cast("string").alias("value")
    ).select(F.lit("orphaned reports").alias("check_name"), "value")
    return _stack([*passes, lost])


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def config_audit(versions: DataFrame) -> DataFrame:
    """A row for every change of a key's value; the first value and repeated values give none."""
    changes = with_previous(versions, ["key"], "updated_at", {"old_value": "value"}, ties=["value"], span="30 days")
    return changes.where(F.col("has_previous") & ~F.col("old_value").eqNullSafe(F.col("value"))).select(
        "key", "old_value", F.col("value").alias("new_value"), F.col("updated_at").alias("changed_at")
    )


def config_audit_from(changes: DataFrame) -> DataFrame:
    """The same rows from the change feed of a stored table (key, value, updated_at): its updates, less those that repeat a value."""
    return changes.where((F.col("kind") == "update") & ~F.col("before.value").eqNullSafe(F.col("after.value"))).select(
        "key", F.col("before.value").alias("old_value"), F.col("after.value").alias("new_value"), F.col("after.updated_at").alias("changed_at")
    )


def current_config(versions: DataFrame) -> DataFrame:
    """The value in force per key."""
    return versions.groupBy("key").agg(
        F.max_by("value", F.struct("updated_at", "value")).alias("value"), F.max("updated_at").alias("updated_at")
    )


def mask_secrets(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, text.masked(F.col(col)))
