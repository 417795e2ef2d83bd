"""Context for anomalies and the reports written about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revpulse import fixed
from revpulse.functions import seasonal, text
from revpulse.functions.moments import AsOf, bounded, lookback, window_start
from revpulse.functions.money import cents, from_cents
from revpulse.operators.windows import KEY
from revpulse.plans.per_key import first_per_key
from revpulse.sources.warehouse import use_shared_checkpoints


def by_urgency() -> list[Column]:
    """Severity first, then recency; the id makes the order total."""
    return [seasonal.severity_rank(F.col("severity")), F.desc("detected_at"), F.col("anomaly_id")]


def uninvestigated_anomalies(anomalies: DataFrame, reports: DataFrame, limit: int | None = 5) -> DataFrame:
    """Open anomalies without a report, most urgent first."""
    waiting = anomalies.where(F.col("status") == "open").join(
        reports.where(F.col("anomaly_id").isNotNull()).select("anomaly_id"), "anomaly_id", "left_anti"
    ).select(*anomalies.columns)
    return waiting if limit is None else waiting.orderBy(*by_urgency()).limit(limit)


def anomaly_context(anomalies: DataFrame) -> DataFrame:
    """Adds lost revenue, deviation in percent and its direction."""
    pct = seasonal.pct_deviation(F.col("actual_revenue"), F.col("expected_revenue"))
    loss = F.col("expected_revenue").cast("double") - F.col("actual_revenue").cast("double")
    return anomalies.withColumns({
        "loss": F.round(F.greatest(loss, F.lit(0.0)), 2), "pct_deviation": pct, "direction": seasonal.direction(pct),
    })


def open_anomalies(anomalies: DataFrame, limit: int = 20) -> DataFrame:
    """The most urgent open anomalies with deviation and direction."""
    return anomaly_context(anomalies.where(F.col("status") == "open")).orderBy(*by_urgency()).limit(limit)


def _one_side(metrics: DataFrame, column: str, value: str, other: str, as_of: AsOf, minutes: int) -> DataFrame:
    rows = lookback(metrics, "window_start", as_of, f"{minutes} MINUTES").where(F.col(column) == value)
    return rows.select("window_start", other, "order_count", "total_revenue", "avg_order_value").orderBy(
        F.desc("window_start"), other
    )


def revenue_by_category(metrics: DataFrame, category: str, as_of: AsOf, minutes: int = 30) -> DataFrame:
    """Recent windows of one category, newest first."""
    return _one_side(metrics, "category", category, "region", as_of, minutes)


def revenue_by_region(metrics: DataFrame, region: str, as_of: AsOf, minutes: int = 30) -> DataFrame:
    """Recent windows of one region, newest first."""
    return _one_side(metrics, "region", region, "category", as_of, minutes)


def _volume(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("order_count"), F.sum(F.col("quantity").cast("bigint")).alias("total_units"),
        F.sum(cents("total_amount")).alias("cents"),
    ).withColumn("total_revenue", from_cents("cents")).drop("cents")


def product_order_volume(events: DataFrame, category: str | None, as_of: AsOf, minutes: int = 30) -> DataFrame:
    """Orders, units and revenue per product, best seller first; ``category=None`` for all."""
    recent = lookback(events, "event_timestamp", as_of, f"{minutes} MINUTES")
    if category is not None:
        return _volume(recent.where(F.col("category") == category), ["product_id", "product_name"]).orderBy(
            F.desc("total_revenue"), "product_id"
        )
    return _volume(recent, ["category", "product_id", "product_name"]).orderBy(
        "category", F.desc("total_revenue"), "product_id"
    )


def order_trend(events: DataFrame, as_of: AsOf, minutes: int = 15, widest: int = 60) -> DataFrame:
    """Orders and revenue per minute over the last 1 to ``widest`` minutes."""
    recent = lookback(events, "event_timestamp", as_of, f"{bounded(minutes, 1, widest)} MINUTES")
    return recent.groupBy(window_start("event_timestamp", "1 minute").alias("minute")).agg(
        F.count("*").alias("orders"), F.sum(cents("total_amount")).alias("cents")
    ).select("minute", "orders", from_cents("cents").alias("revenue")).orderBy(F.desc("minute"))


def payment_breakdown(events: DataFrame, as_of: AsOf, minutes: int = 30) -> DataFrame:
    recent = lookback(events, "event_timestamp", as_of, f"{minutes} MINUTES")
    return _volume(recent, ["payment_method"]).drop("total_units").orderBy(F.desc("total_revenue"), "payment_method")


def feature_snapshot(feature_store: DataFrame, n: int = 3) -> DataFrame:
    """The newest ``n`` feature rows of every category and region, with a trend label."""
    newest = first_per_key(feature_store, KEY, [F.desc("computed_at")], n)
    return newest.withColumn("trend", seasonal.trend_label(F.col("revenue_trend_pct")))


def investigation_bundle(
    anomalies: DataFrame, reports: DataFrame, metrics: DataFrame, events: DataFrame, feature_store: DataFrame,
    as_of: AsOf, *, limit: int | None = 5, minutes: int = 30, trend_minutes: int = 15, widest: int = 60,
) -> DataFrame:
    """All evidence for the next anomalies (``limit=None``: for all), one line per row: (section, category, region, position, line).

    Evidence that anomalies share is told once: a line belongs to every anomaly of its category and region, and null in
    either stands for all of them (:func:`evidence_for`).  The first section lists the anomalies.  So the bundle grows
    with the anomalies plus the evidence, not with their product, and no side has to be small.
    """
    use_shared_checkpoints(anomalies.sparkSession)
    # Needed by every section: found once.
    chosen = uninvestigated_anomalies(anomalies, reports, limit).select("anomaly_id", *KEY).checkpoint()
    recent = lookback(metrics, "window_start", as_of, f"{minutes} MINUTES")

    def stamp(c):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    def metric_line(other):
        return F.concat_ws(
            " | ", stamp("window_start"), F.col(other),
            F.concat(F.lit("orders="), F.col("order_count")),
            F.concat(F.lit("revenue="), text.rupees(F.col("total_revenue"))),
            F.concat(F.lit("avg="), text.rupees(F.col("avg_order_value"))),
        )

    def section(name, rows, own, place, line):
        keys = [(F.col(k) if k in own else F.lit(None).cast("string")).alias(k) for k in KEY]
        return rows.select(F.lit(name).alias("section"), *keys, place.alias("position"), line.alias("line"))

    def of_chosen(rows, keys):
        return rows.join(chosen.select(*keys).distinct(), keys, "left_semi")

    products = _volume(
        lookback(events, "event_timestamp", as_of, f"{minutes} MINUTES"), ["category", "product_id", "product_name"]
    )
    snapshot = feature_snapshot(feature_store)
    trend = order_trend(events, as_of, trend_minutes, widest)
    payments = payment_breakdown(events, as_of, minutes)
    total = F.concat(F.lit("revenue="), text.rupees(F.col("total_revenue")))

    names = fixed.SECTIONS
    parts = [
        section(fixed.SECTION_ANOMALIES, chosen, KEY, F.col("anomaly_id"), F.concat_ws(" | ", "anomaly_id", *KEY)),
        section(names[0], of_chosen(recent, ["category"]), ["category"],
                F.concat_ws("|", stamp("window_start"), "region"), metric_line("region")),
        section(names[1], of_chosen(recent, ["region"]), ["region"],
                F.concat_ws("|", stamp("window_start"), "category"), metric_line("category")),
        section(names[2], of_chosen(products, ["category"]), ["category"], F.col("product_id"),
                F.concat_ws(" | ", F.concat_ws(" ", "product_id", "product_name"),
                            F.concat(F.lit("orders="), F.col("order_count"), F.lit(" units="), F.col("total_units")), total)),
        section(names[3], of_chosen(snapshot, KEY), KEY, stamp("computed_at"), F.concat_ws(
            " | ", stamp("computed_at"),
            F.concat(F.lit("rev 5m="), text.rupees(F.col("revenue_last_5m")),
                     F.lit(" 15m="), text.rupees(F.col("revenue_last_15m")),
                     F.lit(" 60m="), text.rupees(F.col("revenue_last_60m"))),
            F.concat(F.lit("orders 5m="), F.col("orders_last_5m"), F.lit(" 15m="), F.col("orders_last_15m"),
                     F.lit(" 60m="), F.col("orders_last_60m")),
            F.concat(F.lit("avg="), text.rupees(F.col("avg_order_value_last_15m"))),
            F.concat(F.lit("trend="), F.format_string("%.2f", F.col("revenue_trend_pct")), F.lit(" ("), F.col("trend"), F.lit(")")),
        )),
        section(names[4], trend, [], stamp("minute"), F.concat_ws(
            " | ", stamp("minute"), F.concat(F.lit("orders="), F.col("orders")),
            F.concat(F.lit("revenue="), text.rupees(F.col("revenue"))))),
        section(names[5], payments, [], F.col("payment_method"), F.concat_ws(
            " | ", F.rpad("payment_method", 25, " "), F.concat(F.lit("orders="), F.col("order_count")), total)),
    ]
    bundle = parts[0]
    for part in parts[1:]:
        bundle = bundle.unionByName(part)
    return bundle


def evidence_for(bundle: DataFrame, anomaly_id: str, category: str, region: str) -> DataFrame:
    """The lines of one anomaly: (section, position, line)."""
    mine = (F.col("category").isNull() | (F.col("category") == category)) & (F.col("region").isNull() | (F.col("region") == region))
    other = (F.col("section") == fixed.SECTION_ANOMALIES) & (F.col("position") != anomaly_id)
    return bundle.where(mine & ~other).select("section", "position", "line")


def parse_reports(texts: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Fields of report texts ``(anomaly_id, report_text)``.

    Missing parts fall back: loss to the anomaly's own figures, cause to the last long
    paragraph, confidence to what the cause's length supports.  A loss far beyond the
    expected revenue and a high confidence on a thin cause are corrected when the anomaly
    is known.
    """
    if anomalies is None:
        known = texts.withColumns({
            "actual_revenue": F.lit(None).cast("double"), "expected_revenue": F.lit(None).cast("double"),
            "__known": F.lit(False),
        })
    else:
        facts = anomalies.select(
            "anomaly_id", F.col("actual_revenue").cast("double").alias("actual_revenue"),
            F.col("expected_revenue").cast("double").alias("expected_revenue"), F.lit(True).alias("__is"),
        )
        known = texts.join(facts, "anomaly_id", "left").withColumn("__known", F.col("__is").isNotNull()).drop("__is")

    body = known.withColumn("__body", text.report_body(F.col("report_text")))
    read = body.withColumns({
        "__cause": text.report_cause(F.col("__body")),
        "__action": text.report_action(F.col("__body")),
        "__confidence": text.report_confidence(F.col("__body")),
        "__loss": text.report_loss(F.col("__body")),
    }).withColumn(
        "__cause", F.when(F.col("__cause") != "", F.col("__cause")).otherwise(text.last_long_paragraph(F.col("report_text")))
    )

    fallback = F.greatest(F.coalesce(F.col("expected_revenue") - F.col("actual_revenue"), F.lit(0.0)), F.lit(0.0))
    supported = F.when(F.length(text.strip(F.col("__cause"))) >= 50, F.lit(0.55)).otherwise(F.lit(0.15))
    stated = read.withColumns({
        "__loss": F.coalesce("__loss", fallback), "__confidence": F.coalesce("__confidence", supported),
    })
    sane = F.greatest(F.col("expected_revenue"), F.lit(1000.0)) * 1.5
    loss = F.when(F.col("__known") & (F.col("__loss") > sane), fallback).otherwise(F.col("__loss"))
    thin = F.length("__cause") < 100
    confidence = F.when(F.col("__known") & (F.col("__confidence") > 0.9) & thin, F.lit(0.7)).otherwise(F.col("__confidence"))
    cause, action = text.strip(F.col("__cause")), F.col("__action")
    return stated.select(
        "anomaly_id",
        F.when(cause != "", cause).otherwise(F.lit(fixed.NO_CAUSE)).alias("root_cause"),
        F.when(action != "", action).otherwise(F.lit(fixed.NO_ACTION)).alias("recommended_action"),
        F.bround(confidence, 2).alias("confidence"), F.bround(loss, 2).alias("estimated_loss"),
        F.col("report_text").alias("full_report"),
    )


def apply_reports(anomalies: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report rows to append, anomalies with the reported ones acknowledged)."""
    facts = ["anomaly_id", "severity", *KEY, "actual_revenue", "expected_revenue"]
    rows = parsed.join(anomalies.select(*facts), "anomaly_id").select(
        *facts, "confidence", "estimated_loss", "root_cause", "recommended_action", "full_report"
    )
    done = parsed.select("anomaly_id").distinct().withColumn("__done", F.lit(True))
    marked = anomalies.join(done, "anomaly_id", "left").withColumn(
        "status", F.when(F.col("__done").isNotNull(), F.lit("acknowledged")).otherwise(F.col("status"))
    )
    return rows, marked.select(*anomalies.columns)
