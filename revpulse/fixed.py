"""Fixed values.

Everything in this file is given from outside: results are only right when these
values are exactly the ones below.  They are stated plainly and used everywhere else.
"""

# --- Category: (code, expected revenue of a 5-minute window) ---------------------
CATEGORIES = {
    "Electronics": (0, 2800.0),
    "Footwear": (1, 400.0),
    "Apparel": (2, 250.0),
    "Home": (3, 600.0),
    "Accessories": (4, 120.0),
}
UNKNOWN_CODE = -1
DEFAULT_BASE_REVENUE = 300.0

# --- Region: (code, share of the market) ----------------------------------------
REGIONS = {
    "Delhi": (0, 0.30),
    "Maharashtra": (1, 0.25),
    "Karnataka": (2, 0.15),
    "Tamil Nadu": (3, 0.20),
    "West Bengal": (4, 0.10),
}
DEFAULT_REGION_WEIGHT = 0.15

# --- Hour of day: (first hour, factor), each band runs up to the next one -----------
HOUR_BANDS = [(0, 0.3), (6, 0.7), (9, 1.2), (12, 1.4), (14, 1.1), (18, 1.3), (21, 0.6)]
DEFAULT_HOUR_FACTOR = 0.6

# --- Day of week, Monday first ---------------------------------------------------
DAY_FACTORS = [0.9, 0.85, 0.9, 1.0, 1.15, 1.3, 1.2]
DEFAULT_DAY_FACTOR = 1.0

PAYMENT_METHODS = ["credit_card", "debit_card", "digital_wallet", "buy_now_pay_later"]

# --- Severity from actual / expected revenue: (name, below, above) ---------------
SEVERITY_LIMITS = [("critical", 0.2, 4.0), ("high", 0.4, 2.5)]
SEVERITY_OTHERWISE = "medium"
SEVERITY_ORDER = {"critical": 1, "high": 2}
STATUSES = ["open", "acknowledged", "false_positive", "confirmed"]

# --- Model inputs, in order, and training settings ----------------------------------
FEATURES = [
    "hour", "day_of_week", "category_enc", "region_enc",
    "order_count", "total_revenue", "avg_order_value",
    "expected_revenue", "revenue_ratio",
]
TRAINING_COLUMNS = [
    "window_start", "window_end", "category", "region", "hour", "day_of_week",
    "order_count", "total_revenue", "avg_order_value",
    "expected_revenue", "revenue_ratio", "is_anomaly",
]

# --- Drift limits ------------------------------------------------------------------
DRIFT_MIN_ROWS = 50
DRIFT_PSI_LIMIT = 0.2
DRIFT_PSI_WATCH = 0.1
DRIFT_EXPECTED_RATE = 0.05
DRIFT_RATE_TOLERANCE = 0.15
DRIFT_MIN_SCORE_STD = 0.01
PSI_FLOOR = 1e-6

# --- Trend labels of a feature snapshot: ratio below -> label -----------------------
TREND_LABELS = [(0.6, "DECLINING"), (1.4, "STABLE")]
TREND_OTHERWISE = "SURGING"

# --- Investigation report text ------------------------------------------------------
REPORT_BLOCK = r"ANOMALY_REPORT_START(.*?)ANOMALY_REPORT_END"
REPORT_CONFIDENCE = r"[Cc]onfidence\s*[:=]\s*([\d]*\.?[\d]+)"
REPORT_LOSS = r"[Ee]stimated\s*[Ll]oss\s*[:=]\s*[₹$Rs.\s]*([-\d,]*\.?\d+)"
REPORT_CAUSE = (
    r"[Rr]oot\s*[Cc]ause(?:\s*[Aa]nalysis)?\s*[:=]\s*(.+?)"
    r"(?:\n\s*(?:[Rr]ecommended|ANOMALY_REPORT_END)|$)"
)
REPORT_ACTION = r"[Rr]ecommended\s*[Aa]ction\s*[:=]\s*(.+?)(?:\n\s*ANOMALY_REPORT_END|$)"
NO_CAUSE = "Unable to determine root cause."
NO_ACTION = "Manual investigation recommended."

# --- Secrets in log text --------------------------------------------------------------
# Group 1 is the word before a secret, group 2 the colon before a password in an address.
SECRETS = r"""(password|secret|key|token|auth)['"]?\s*[:=]\s*['"]?[^'"\s,]+['"]?|(:)[^:/@]+@"""

# --- Dead letters ------------------------------------------------------------------
MAX_RETRIES = 5

# --- Histogram bounds, in seconds -----------------------------------------------------
PRODUCE_BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]
SCORING_BOUNDS = [0.01, 0.05, 0.1, 0.5, 1.0, 5.0]
REPORT_BOUNDS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]
BATCH_BOUNDS = [0.1, 0.5, 1.0, 5.0, 10.0, 30.0]

# --- Where the orders of a zone are kept; anything else goes to the default ---------------
REGION_SHARDS = {
    "North-India": "postgres-east",
    "South-India": "postgres-south",
    "West-India": "postgres-west",
    "East-India": "postgres-east2",
    "Central-India": "postgres-central",
}
DEFAULT_SHARD = "postgres"

# --- Wording that readers of alerts, drift notes and evidence rely on ---------------------
ALERT_TEXT = (
    "🚨 *CRITICAL ANOMALY DETECTED*\n"
    "Category: %s | Region: %s\n"
    "Actual: ₹%.2f vs Expected: ₹%.2f\n"
    "Score: %.3f\n"
)
DRIFT_NOTES = {
    "revenue": "Revenue distribution shift: PSI=%.3f",
    "orders": "Order count distribution shift: PSI=%.3f",
    "rate": "Anomaly rate %.1f%% far from expected %.1f%%",
    "collapse": "Score distribution collapsed: std=%.4f",
}
SECTIONS = [
    "Revenue by Category", "Revenue by Region", "Product Order Volume",
    "Feature Snapshot", "Recent Order Trend", "Payment Breakdown",
]

# A report without a stated cause shows the start of its last long paragraph.
PARAGRAPH_MIN, PARAGRAPH_SHOWN = 40, 500

TOO_FEW_WINDOWS = "not enough windows"

SECTION_ANOMALIES = "Anomalies"
