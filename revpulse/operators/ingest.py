"""From parsed messages to clean order events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revpulse import fixed, schemas
from revpulse.functions.moments import AsOf, moment
from revpulse.plans.per_key import first_per_key

REQUIRED = [c for c in schemas.ORDER_EVENTS.names if c != "ingested_at"]
WIRE_COLUMNS = REQUIRED


def _failed(name: str, test: Column) -> Column:
    return F.when(test, F.lit(name))


def validate_events(events: DataFrame) -> DataFrame:
    """Adds ``failed_checks``: names of missing required fields, ``malformed`` for text that is
    not JSON, ``amount_mismatch`` when the total is not price times quantity."""
    checks = [_failed(f"missing_{c}", F.col(c).isNull()) for c in REQUIRED if c in events.columns]
    if "_corrupt_record" in events.columns:
        checks.insert(0, _failed("malformed", F.col("_corrupt_record").isNotNull()))
    expected = F.round(F.col("unit_price") * F.col("quantity"), 2)
    checks.append(_failed("amount_mismatch", F.col("total_amount") != expected))
    return events.withColumn("failed_checks", F.array_compact(F.array(*checks)))


def status_in_domain(status: Column) -> Column:
    return status.isin(*fixed.STATUSES)


def dead_letter_id(payload: Column, position: Sequence[str] = ()) -> Column:
    """Dead letters have no key of their own (the event id may be what is missing).  With the columns of their place in the
    source two identical messages get two ids, and a replayed one the same again."""
    place = [F.col(c).cast("string") for c in position]
    return F.substring(F.sha2(F.concat_ws("|", payload, *place) if place else payload, 256), 1, 32)


def route_dead_letters(checked: DataFrame, as_of: AsOf | None = None, position: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(good events, dead letters) of validated events.  ``position`` names columns that tell a message's place in the
    source; they end here.

    The dead letter keeps the message as it came in (``value``), or the columns as JSON when
    the raw text is not at hand.
    """
    failing = F.size("failed_checks") > 0
    good = checked.where(~failing).drop("failed_checks", "_corrupt_record", "value", *position)
    fields = [c for c in checked.columns if c not in ("failed_checks", "_corrupt_record", "value", *position)]
    payload = F.col("value") if "value" in checked.columns else F.to_json(F.struct(*fields))
    if as_of is None:
        now = F.current_timestamp()
    else:
        now = F.lit(as_of).cast("timestamp") if not isinstance(as_of, DataFrame) else as_of.scalar()
    dead = checked.where(failing).select(
        dead_letter_id(payload, position).alias("dlq_id"),
        payload.alias("event_data"),
        F.array_join("failed_checks", ",").alias("error"),
        F.lit(0).alias("retry_count"),
        now.alias("first_failed"),
        F.lit(None).cast("timestamp").alias("last_retried"),
        F.lit(False).alias("resolved"),
    )
    return good, dead


def with_event_time(events: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Watermark on the event time; the stateful operators drop what arrives later."""
    zoned = events.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    return zoned.withWatermark("event_timestamp", delay)


def dedup_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per event.  A stream keeps the first arrival within the watermark; a table keeps
    the newest row, ties broken by all columns."""
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark([key])
    return first_per_key(events, [key], [F.desc("event_timestamp")])
