"""The retail tables, derived from the test tables.

The warehouse tables of a real installation are written by the streams.  Here the same
tables are views over ``events`` and the order tables, so every query starts from data on
disk and its work grows with it.
"""

from __future__ import annotations

import time
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revpulse.functions.moments import latest, window_start
from revpulse.functions.text import rupees
from revpulse.operators import detect
from revpulse.operators.baseline import engineer_features
from revpulse.operators.windows import feature_store, revenue_metrics


def _choice(key, values, otherwise):
    out = None
    for match, value in values.items():
        out = F.when(key == match, value) if out is None else out.when(key == match, value)
    return out.otherwise(otherwise)


#: Folder of stored base tables by test folder, if :func:`store` wrote them.
STORED: dict[str, str] = {}
BASE = ("order_events", "revenue_metrics", "feature_store", "anomalies", "copilot_reports")


def _derived(fn) -> cached_property:
    """A base table: derived from the test tables, or read if it has been stored."""
    def get(self):
        folder = STORED.get(self.sf_dir)
        return fn(self) if folder is None else self.spark.read.parquet(f"{folder}/{fn.__name__}")

    get.__name__, get.__doc__ = fn.__name__, fn.__doc__
    return cached_property(get)


def store(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, float]:
    """Writes the base tables, as the streams of an installation would have; returns the seconds each took.

    From then on the views of this folder read them, and a query's time is that of its operator.
    """
    seconds = {}
    for name in BASE:
        begin = time.monotonic()
        getattr(Views(spark, sf_dir), name).write.parquet(f"{folder}/{name}")
        seconds[name] = round(time.monotonic() - begin, 3)
    STORED[sf_dir] = folder
    return seconds


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- orders ---------------------------------------------------------------------

    def orders_from(self, events: DataFrame) -> DataFrame:
        """Order events from event rows; works on a stream of them as well."""
        n = F.col("event_id")
        price = F.col("value").cast("decimal(10,2)")
        quantity = (n % 5 + 1).cast("int")
        return events.select(
            n.cast("string").alias("event_id"), F.lit("order_placed").alias("event_type"),
            F.col("ts").alias("event_timestamp"),
            F.concat(F.lit("ORD-"), F.lpad(n.cast("string"), 8, "0")).alias("order_id"),
            F.concat(F.lit("SKU-"), (n % 30 + 1001).cast("string")).alias("product_id"),
            F.concat(F.lit("Product "), (n % 30 + 1001).cast("string")).alias("product_name"),
            _choice(F.col("event_type"), {
                "click": F.lit("Electronics"), "view": F.lit("Footwear"), "signup": F.lit("Apparel"), "purchase": F.lit("Home"),
            }, F.lit("Accessories")).alias("category"),
            quantity.alias("quantity"), price.alias("unit_price"),
            (price * quantity).cast("decimal(10,2)").alias("total_amount"),
            _choice(F.col("user_id") % 5, {
                0: F.lit("Delhi"), 1: F.lit("Maharashtra"), 2: F.lit("Karnataka"), 3: F.lit("Tamil Nadu"),
            }, F.lit("West Bengal")).alias("region"),
            _choice(n % 4, {0: F.lit("credit_card"), 1: F.lit("debit_card"), 2: F.lit("digital_wallet")},
                    F.lit("buy_now_pay_later")).alias("payment_method"),
            (F.col("ts") + F.make_dt_interval(secs=(n % 7).cast("decimal(18,6)"))).alias("ingested_at"),
        )

    @_derived
    def order_events(self) -> DataFrame:
        return self.orders_from(self.table("events"))

    @cached_property
    def as_of(self) -> DataFrame:
        return latest(self.table("events").withColumnRenamed("ts", "event_timestamp"), "event_timestamp")

    @cached_property
    def days(self) -> int:
        """Days that the events span, begun ones included: look-backs of so many days cover the table."""
        low, high = self.table("events").agg(F.min("ts"), F.max("ts")).first()
        return (high - low).days + 2 if low else 1

    @property
    def minutes(self) -> int:
        return self.days * 24 * 60

    @cached_property
    def order_wire(self) -> DataFrame:
        """Every event as the JSON text it would arrive as.  Messages of ``error`` events are
        broken, in four ways: cut off, no id, no readable time, wrong total."""
        return self.wire_of(self.table("events"))

    def wire_of(self, events: DataFrame) -> DataFrame:
        broken = F.when(F.col("source_type") == "error", F.col("n") % 4)
        orders = self.orders_from(events).select(
            "*", F.col("event_id").cast("bigint").alias("n"),
        ).withColumn("source_type", F.when(F.col("category") == "Accessories", F.lit("error")).otherwise(F.lit("ok")))
        stamp = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        message = F.to_json(F.struct(
            F.when(broken == 1, F.lit(None)).otherwise(F.col("event_id")).alias("event_id"), "event_type",
            F.when(broken == 2, F.lit("not a time")).otherwise(stamp).alias("timestamp"),
            "order_id", "product_id", "product_name", "category", "quantity",
            F.col("unit_price").cast("double").alias("unit_price"),
            (F.col("total_amount") + F.when(broken == 3, F.lit(1)).otherwise(F.lit(0))).cast("double").alias("total_amount"),
            "region", "payment_method",
        ))
        return orders.select(
            F.when(broken == 0, F.substring(message, 1, 60)).otherwise(message).alias("value"),
            "n", "event_timestamp", "source_type",
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        """Wide order rows from the star tables; ids repeat, times are whole days."""
        t = self.table
        joined = (
            t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        )
        return joined.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"),
            F.col("l_shipdate").alias("event_timestamp"), F.col("p_type").alias("category"), F.col("r_name").alias("region"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("total_amount"),
            F.col("o_orderpriority").alias("payment_method"),
        )

    # --- metric tables ------------------------------------------------------------------

    @_derived
    def revenue_metrics(self) -> DataFrame:
        return revenue_metrics(self.order_events)

    @_derived
    def feature_store(self) -> DataFrame:
        return feature_store(self.order_events)

    @cached_property
    def engineered(self) -> DataFrame:
        return engineer_features(self.revenue_metrics)

    @_derived
    def anomalies(self) -> DataFrame:
        hour = F.hour("window_start")
        status = F.when((F.col("severity") == "critical") & (hour % 3 == 0), F.lit("acknowledged")).when(
            (F.col("severity") == "high") & (hour % 3 == 1), F.lit("false_positive")
        ).otherwise(F.lit("open"))
        return detect.as_anomalies(detect.rule_anomalies(self.engineered)).withColumn("status", status)

    @cached_property
    def report_texts(self) -> DataFrame:
        """A report about every acknowledged anomaly, written in a different way per category."""
        a = self.anomalies.where(F.col("status") == "acknowledged")
        actual, expected = F.col("actual_revenue").cast("double"), F.col("expected_revenue")
        where = F.concat(F.col("category"), F.lit(" in "), F.col("region"))
        cause = F.concat(F.lit("Revenue of "), where, F.lit(" was "), rupees(actual), F.lit(" against\n"), rupees(expected), F.lit(" expected."))
        full = F.concat(
            F.lit("ANOMALY_REPORT_START\nEstimated Loss: ₹ "), F.format_number(F.abs(expected - actual), 2),
            F.lit("\nConfidence: 85\nRoot Cause: "), cause, F.lit("\nRecommended Action: Check stock of "), where,
            F.lit(".\nANOMALY_REPORT_END\nDone."),
        )
        no_loss = F.concat(F.lit("Confidence: 0.90\nRoot Cause: "), cause, F.lit("\nRecommended Action: Inspect  further."))
        no_confidence = F.concat(F.lit("Root Cause Analysis:\n"), cause, F.lit(" It should be checked soon.\nRecommended Action: Count stock."))
        wild = F.concat(
            F.lit("Estimated Loss: "), F.format_number(expected * 1000.0 + 5000.0, 2),
            F.lit("\nConfidence = 0.99\nRoot cause: A drop.\nRecommended Action: Wait."),
        )
        prose = F.concat(F.lit("Short.\n\n  "), cause, F.lit("  \n\nEnd."))
        text = _choice(F.col("category"), {
            "Electronics": full, "Footwear": no_loss, "Apparel": no_confidence, "Home": wild,
        }, prose)
        return a.select("anomaly_id", text.alias("report_text"))

    @_derived
    def copilot_reports(self) -> DataFrame:
        actual, expected = F.col("actual_revenue").cast("double"), F.col("expected_revenue")
        return self.anomalies.where(F.col("status") == "acknowledged").select(
            "anomaly_id", (F.col("detected_at") + F.expr("INTERVAL 90 SECONDS")).alias("created_at"),
            "severity", "category", "region", "actual_revenue", "expected_revenue",
            F.when(F.col("region") == "Delhi", F.lit(0.35)).when(F.col("region") == "Karnataka", F.lit(0.6)).otherwise(F.lit(0.85)).alias("confidence"),
            F.round(F.greatest(expected - actual, F.lit(0.0)), 2).alias("estimated_loss"),
        )

    # --- operations tables ----------------------------------------------------------------

    @cached_property
    def dlq_events(self) -> DataFrame:
        """The messages of ``error`` events; some have been retried, some resolved before."""
        n = F.col("n")
        return self.order_wire.where(F.col("source_type") == "error").select(
            F.lpad(n.cast("string"), 12, "0").alias("dlq_id"),
            F.when(n % 3 == 0, F.replace("value", F.lit("not a time"), F.lit("2024-01-31T00:00:00Z"))).otherwise(F.col("value")).alias("event_data"),
            F.lit("rejected").alias("error"), (n % 7).cast("int").alias("retry_count"),
            F.col("event_timestamp").alias("first_failed"),
            F.lit(None).cast(self.order_events.schema["event_timestamp"].dataType).alias("last_retried"),
            (n % 5 == 0).alias("resolved"),
        )

    @cached_property
    def config_versions(self) -> DataFrame:
        """Daily settings per event type."""
        day = window_start("ts", "1 day")
        per_day = self.table("events").groupBy(day.alias("updated_at"), "event_type").agg(F.count("*").alias("n"))
        return per_day.select(
            F.concat(F.lit("simulate_"), "event_type").alias("key"),
            F.when(F.col("n") % 3 == 0, F.lit("true")).otherwise(F.lit("false")).alias("value"), "updated_at",
        )

    @cached_property
    def metric_samples(self) -> DataFrame:
        """Counter samples per event type: the value grows with the event id and restarts
        every 500 ids."""
        return self.table("events").select(
            F.lit("orders_total").alias("name"), F.col("event_type").alias("label"), "ts",
            (F.col("event_id") % 500).cast("double").alias("value"),
        )

    @cached_property
    def batch_log(self) -> DataFrame:
        """One batch per hour and event type; it failed when its row count divides by three."""
        hour = window_start("ts", "1 hour")
        return self.table("events").groupBy(F.col("event_type").alias("sink"), hour.alias("started")).agg(
            F.count("*").alias("input_rows")
        ).select(
            "sink", F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("started")).alias("batch_id"),
            (F.col("started") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"), "input_rows",
            (F.col("input_rows") % 3 == 0).alias("failed"),
        )

    @cached_property
    def model_registry(self) -> DataFrame:
        """One model version per day of metrics."""
        per_day = self.engineered.groupBy(F.date_format("window_start", "yyyyMMdd").alias("day")).agg(
            F.min("window_start").alias("trained_at"), F.count("*").alias("num_samples"),
            F.count_if((F.col("revenue_ratio") < 0.2) | (F.col("revenue_ratio") > 4.0)).alias("num_anomalies"),
        )
        return per_day.select(
            F.concat("day", F.lit("_000000")).alias("version"), "trained_at",
            F.round(F.col("num_anomalies") / F.col("num_samples"), 4).alias("f1"),
            "num_samples", "num_anomalies", F.col("day").alias("data_hash"),
            F.when(F.substring("day", 7, 2) == "05", F.lit("production")).otherwise(F.lit("candidate")).alias("status"),
        )
