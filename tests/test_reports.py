"""Report texts, secrets, and applying reports."""

import re

import pytest
from pyspark.sql import functions as F

from revpulse.operators import investigate, lifecycle

PERFECT = """
ANOMALY_REPORT_START
Anomaly ID: 123
Severity: critical
Estimated Loss: 1540.50
Confidence: 0.85
Root Cause: There appears to be a sudden drop in Electronics sales in Delhi.
Recommended Action: Check inventory levels for stockouts.
ANOMALY_REPORT_END
        """
CURRENCY = "\nEstimated Loss: ₹ 1,540.50\nConfidence: 85\nRoot Cause: A drop.\nRecommended Action: Fix it.\n"
NO_LOSS = "\nConfidence: 0.90\nRoot Cause: We matched the pattern.\nRecommended Action: Inspect further.\n"
NO_CONFIDENCE = (
    "\nRoot Cause Analysis:\nThis is a very long and detailed analysis of the anomaly. The numbers dropped.\n"
    "This suggests a potential stockout or pricing error.\nRecommended Action: Review the counts.\n"
)


def parse(spark, text, anomaly=None):
    texts = spark.createDataFrame([("x", text)], "anomaly_id string, report_text string")
    known = None
    if anomaly:
        known = spark.createDataFrame([("x", *anomaly)], "anomaly_id string, actual_revenue double, expected_revenue double")
    return investigate.parse_reports(texts, known).first()


@pytest.mark.parametrize("text, anomaly, loss, confidence", [
    (PERFECT, None, 1540.5, 0.85),
    (CURRENCY, None, 1540.5, 0.85),
    (NO_LOSS, (500.0, 2500.0), 2000.0, 0.90),
    (NO_CONFIDENCE, None, 0.0, 0.55),
    ("Bad", None, 0.0, 0.15),
    ("Estimated Loss: 99,999\nConfidence: 0.95\nRoot Cause: Thin.", (100.0, 300.0), 200.0, 0.7),
    ("Estimated Loss: --5\nConfidence: 140", (300.0, 100.0), 0.0, 0.7),
])
def test_figures(spark, text, anomaly, loss, confidence):
    row = parse(spark, text, anomaly)
    assert (row.estimated_loss, row.confidence) == (loss, confidence)


def test_texts(spark):
    row = parse(spark, PERFECT)
    assert row.root_cause == "There appears to be a sudden drop in Electronics sales in Delhi."
    assert row.recommended_action == "Check inventory levels for stockouts."
    row = parse(spark, "Bad")
    assert row.root_cause == "Unable to determine root cause."
    assert row.recommended_action == "Manual investigation recommended."
    row = parse(spark, NO_CONFIDENCE)
    assert row.root_cause.endswith("pricing error.") and "\n" not in row.root_cause


def test_last_long_paragraph(spark):
    long, longer = "a" * 41, "b" * 700
    assert parse(spark, f"{long}\n\nshort\n\n  {longer}  \n\nend").root_cause == "b" * 500


def test_masking_is_one_pass(spark):
    texts = ["password: abc user@host", "postgres://me:pw1@db", "API_KEY='x y", "x:password=abc", "token:' a@b", "nothing here", "auth=\"q\":z@h"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r.text for r in lifecycle.mask_secrets(frame, "text").orderBy("id").collect()]
    pattern = re.compile(r"(password|secret|key|token|auth)['\"]?\s*[:=]\s*['\"]?([^'\"\s,]+)['\"]?|(:[^:/@]+@)", re.I)
    want = [pattern.sub(lambda m: m.group(1) + ": [REDACTED]" if m.group(1) else ":[REDACTED]@", t) for t in texts]
    assert got == want


def test_apply_reports(spark, views):
    chosen = investigate.uninvestigated_anomalies(views.anomalies, views.copilot_reports).select("anomaly_id")
    texts = chosen.withColumn("report_text", F.lit(PERFECT))
    rows, after = investigate.apply_reports(views.anomalies, investigate.parse_reports(texts, views.anomalies))
    assert rows.count() == 5
    assert after.join(chosen, "anomaly_id").select("status").distinct().collect()[0][0] == "acknowledged"
    assert after.count() == views.anomalies.count()
