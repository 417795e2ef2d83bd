"""From metric windows to anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revpulse import fixed
from revpulse.functions import seasonal
from revpulse.functions.moments import AsOf, lookback, moment
from revpulse.functions.money import round_half_even
from revpulse.operators.baseline import engineer_features
from revpulse.operators.tables import insert_if_absent
from revpulse.operators.windows import KEY

WINDOW_KEY = ["window_start", *KEY]
METRIC_COLUMNS = ["window_start", "window_end", *KEY, "order_count", "total_revenue", "avg_order_value"]
_RULE_SCORE = {"critical": 0.95, "high": 0.75}


def anomaly_id(window_start: Column, category: Column, region: Column) -> Column:
    """The natural key as text.  It sorts by window, so files sorted by it skip well."""
    return F.concat_ws("|", F.date_format(window_start, "yyyyMMddHHmm"), category, region)


def recent_windows(metrics: DataFrame, as_of: AsOf, minutes: int = 10, closed_only: bool = True) -> DataFrame:
    """Windows of the last minutes.  With ``closed_only`` a window still filling is left out;
    scored too early it would look like a drop and be kept that way."""
    recent = lookback(metrics, "window_start", as_of, f"{minutes} MINUTES")
    return recent.where(F.col("window_end") <= moment(as_of, metrics, "window_end")) if closed_only else recent


def unscored_windows(
    metrics: DataFrame, anomalies: DataFrame, as_of: AsOf, minutes: int = 10, limit: int | None = None,
    closed_only: bool = True,
) -> DataFrame:
    """Recent windows without an anomaly row, all of them, or with ``limit`` the newest."""
    known = lookback(anomalies, "window_start", as_of, f"{minutes} MINUTES").select(*WINDOW_KEY)
    left = recent_windows(metrics, as_of, minutes, closed_only).join(known, WINDOW_KEY, "left_anti")
    left = left.select(*METRIC_COLUMNS)
    if limit is None:
        return left
    return left.orderBy(F.desc("window_start"), *KEY).limit(limit)


def as_anomalies(scored: DataFrame) -> DataFrame:
    """Anomaly rows; the window end is the earliest time a complete window can be seen."""
    return scored.select(
        anomaly_id(F.col("window_start"), F.col("category"), F.col("region")).alias("anomaly_id"),
        F.col("window_end").alias("detected_at"),
        "window_start", "window_end", *KEY,
        F.col("total_revenue").alias("actual_revenue"), "expected_revenue",
        "anomaly_score", "severity", F.lit("open").alias("status"),
    )


def rule_anomalies(features: DataFrame) -> DataFrame:
    """Windows whose ratio alone grades above medium, with a score per grade."""
    graded = features.withColumn("severity", seasonal.severity(F.col("revenue_ratio")))
    score = F.lit(0.0)
    for name, value in _RULE_SCORE.items():
        score = F.when(F.col("severity") == name, F.lit(value)).otherwise(score)
    return graded.where(F.col("severity") != fixed.SEVERITY_OTHERWISE).withColumn("anomaly_score", score)


def score_windows(model, features: DataFrame) -> DataFrame:
    """Windows the model takes for anomalies, with P(anomaly) and severity."""
    from pyspark.ml.functions import vector_to_array

    from revpulse.operators.ml import feature_vector

    predicted = model.transform(feature_vector(features)).where(F.col("prediction") == 1.0)
    return predicted.withColumn(
        "anomaly_score", round_half_even(vector_to_array("probability")[1], 4)
    ).withColumn("severity", seasonal.severity(F.col("revenue_ratio"))).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def detection_job(
    metrics: DataFrame, anomalies: DataFrame, as_of: AsOf, model=None, *, minutes: int = 10, closed_only: bool = True,
) -> DataFrame:
    """New anomaly rows of one scan, over all recent windows.

    Known windows are taken out after grading: only the flagged rows, not every window, then
    have to be shuffled against the anomaly table.
    """
    wide = engineer_features(recent_windows(metrics, as_of, minutes, closed_only))
    found = rule_anomalies(wide) if model is None else score_windows(model, wide)
    known = lookback(anomalies, "window_start", as_of, f"{minutes} MINUTES")
    return insert_if_absent(known, as_anomalies(found), WINDOW_KEY)


def critical_alerts(anomalies: DataFrame) -> DataFrame:
    """One message per critical anomaly."""
    figures = [F.col(c).cast("double") for c in ("actual_revenue", "expected_revenue", "anomaly_score")]
    message = F.format_string(fixed.ALERT_TEXT, F.col("category"), F.col("region"), *figures)
    return anomalies.where(F.col("severity") == "critical").select("anomaly_id", "detected_at", message.alias("text"))
