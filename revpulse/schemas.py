"""Schemas of the tables and of the order message."""

from pyspark.sql import types as T

_TEXT, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TIME, _FLAG = T.TimestampType(), T.BooleanType()
_PRICE, _MONEY = T.DecimalType(10, 2), T.DecimalType(20, 2)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# The JSON order message; every field is text except the three figures.
ORDER_SCHEMA = _struct(
    event_id=_TEXT, event_type=_TEXT, timestamp=_TEXT, order_id=_TEXT, product_id=_TEXT, product_name=_TEXT,
    category=_TEXT, quantity=_INT, unit_price=_DOUBLE, total_amount=_DOUBLE, region=_TEXT, payment_method=_TEXT,
)

ORDER_EVENTS = _struct(
    event_id=_TEXT, event_type=_TEXT, event_timestamp=_TIME, order_id=_TEXT, product_id=_TEXT, product_name=_TEXT,
    category=_TEXT, quantity=_INT, unit_price=_PRICE, total_amount=_PRICE, region=_TEXT, payment_method=_TEXT,
    ingested_at=_TIME,
)

REVENUE_METRICS = _struct(
    window_start=_TIME, window_end=_TIME, category=_TEXT, region=_TEXT,
    order_count=_LONG, total_revenue=_MONEY, avg_order_value=_MONEY,
)

FEATURE_STORE = _struct(
    computed_at=_TIME, category=_TEXT, region=_TEXT,
    revenue_last_5m=_MONEY, orders_last_5m=_LONG,
    revenue_last_15m=_MONEY, orders_last_15m=_LONG, avg_order_value_last_15m=_MONEY,
    revenue_last_60m=_MONEY, orders_last_60m=_LONG, revenue_trend_pct=_DOUBLE,
)

ANOMALIES = _struct(
    anomaly_id=_TEXT, detected_at=_TIME, window_start=_TIME, window_end=_TIME, category=_TEXT, region=_TEXT,
    actual_revenue=_MONEY, expected_revenue=_DOUBLE, anomaly_score=_DOUBLE, severity=_TEXT, status=_TEXT,
)

DLQ_EVENTS = _struct(
    dlq_id=_TEXT, event_data=_TEXT, error=_TEXT, retry_count=_INT, first_failed=_TIME, last_retried=_TIME, resolved=_FLAG,
)

MODEL_REGISTRY = _struct(
    version=_TEXT, trained_at=_TIME, f1=_DOUBLE, num_samples=_LONG, num_anomalies=_LONG, data_hash=_TEXT, status=_TEXT,
)

BATCH_LOG = _struct(
    sink=_TEXT, batch_id=_LONG, finished_at=_TIME, duration_ms=_LONG, input_rows=_LONG, late_rows=_LONG, failed=_FLAG,
)

TRAINING = _struct(
    window_start=_TIME, window_end=_TIME, category=_TEXT, region=_TEXT, hour=_INT, day_of_week=_INT, order_count=_LONG,
    total_revenue=_DOUBLE, avg_order_value=_DOUBLE, expected_revenue=_DOUBLE, revenue_ratio=_DOUBLE, is_anomaly=_INT,
)
