"""The dead-letter table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse import fixed
from revpulse.functions.moments import AsOf, moment
from revpulse.operators.ingest import validate_events
from revpulse.sources.orders import parse_order_events


def pending(dlq: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    return dlq.where(~F.col("resolved") & (F.col("retry_count") < max_retries))


def dlq_retry_batch(dlq: DataFrame, n: int = 100, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """The ``n`` oldest dead letters that may still be retried."""
    return pending(dlq, max_retries).orderBy("first_failed", "dlq_id").limit(n)


def judged(letters: DataFrame, as_of: AsOf, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """(good, event, after) of every letter: whether it passes the checks now, the event it holds, and the letter after the try.

    Good ones are resolved; the rest count one more retry and keep the new error."""
    whole = letters.select(F.struct(*[F.col(c) for c in letters.columns]).alias("letter"), F.col("event_data").alias("value"))
    parsed = validate_events(parse_order_events(whole, keep=["letter"]))
    good = F.size("failed_checks") == 0
    fields = {c: F.col(f"letter.{c}") for c in letters.columns}
    fields["resolved"] = F.when(good, F.lit(True)).otherwise(fields["resolved"])
    fields["retry_count"] = F.when(~good, fields["retry_count"] + 1).otherwise(fields["retry_count"])
    fields["last_retried"] = F.when(~good, moment(as_of, letters, "last_retried")).otherwise(fields["last_retried"])
    fields["error"] = F.when(~good, F.array_join("failed_checks", ",")).otherwise(fields["error"])
    event = [c for c in parsed.columns if c not in ("letter", "failed_checks", "_corrupt_record", "value")]
    return parsed.select(good.alias("good"), F.struct(*event).alias("event"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("after"))


def retry_dead_letters(dlq: DataFrame, as_of: AsOf, max_retries: int = fixed.MAX_RETRIES) -> tuple[DataFrame, DataFrame]:
    """(recovered events, dead-letter table after the retry).

    Pending letters are parsed and checked again in one pass; the others go through as they are.
    """
    open_rows = ~F.col("resolved") & (F.col("retry_count") < max_retries)
    tried = judged(dlq.where(open_rows), as_of, max_retries)
    return tried.where("good").select("event.*"), tried.select("after.*").unionByName(dlq.where(~F.coalesce(open_rows, F.lit(False))))


def exhausted_dead_letters(dlq: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """Unresolved letters that will not be retried any more."""
    return dlq.where(~F.col("resolved") & (F.col("retry_count") >= max_retries))
