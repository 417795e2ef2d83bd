"""Tables on shared storage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revpulse import schemas
from revpulse.functions.moments import moment
from revpulse.plans.per_key import first_per_key
from revpulse.sources.files import Folder


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Only a session of one process, which has no executors elsewhere, may leave it unset; it
    gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="revpulse-")


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Points ``checkpoint()`` and iterative training at the shared folder if nothing is set yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_warehouse(spark: SparkSession, source: str, **jdbc) -> DataFrame:
    """A Parquet table, or with ``url=`` a JDBC table.

    JDBC reads take ``predicates`` (one per task) so that one connection never reads a
    whole table; filters and columns are pushed down by Spark.
    """
    if "url" not in jdbc:
        return spark.read.parquet(source)
    url, predicates = jdbc.pop("url"), jdbc.pop("predicates", None)
    properties = jdbc.pop("properties", {})
    if predicates:
        return spark.read.jdbc(url, source, predicates=predicates, properties=properties)
    return spark.read.options(**jdbc).jdbc(url, source, properties=properties)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


# --- monthly layout ----------------------------------------------------------------

def with_month(df: DataFrame, column: str = "event_timestamp") -> DataFrame:
    """Adds the layout column; rows without a time go to the ``default`` month."""
    return df.withColumn("event_month", F.coalesce(F.date_format(column, "yyyy_MM"), F.lit("default")))


def write_monthly(events: DataFrame, path: str, column: str = "event_timestamp", mode: str = "append") -> None:
    """Month folders, files sorted by the usual filter columns so that row-group min/max skip.

    Rows meet by month, and adaptive execution splits a busy month into files of the advisory
    size.  Unlike range partitioning this needs no sampling pass over the input.
    """
    rows = with_month(events, column).hint("rebalance", "event_month")
    ordered = rows.sortWithinPartitions("event_month", "category", "region", column)
    ordered.write.mode(mode).partitionBy("event_month").parquet(path)


def prune_months(df: DataFrame, low, high, column: str = "event_timestamp") -> DataFrame:
    """``low <= column < high`` plus the month predicate that lets Spark skip folders."""
    month = "yyyy_MM"
    start, end = moment(low, df, column), moment(high, df, column)
    return df.where(
        (F.col(column) >= start) & (F.col(column) < end)
        & (F.col("event_month") >= F.date_format(start, month))
        & (F.col("event_month") <= F.date_format(end, month))
    )


def drop_month(spark: SparkSession, path: str, month: str) -> bool:
    """Removes one month's folder of a monthly table; whether there was one.  No row is read."""
    folder = Folder(spark, path)
    name = f"event_month={month}"
    if name not in folder.names():
        return False
    folder.remove(name)
    spark.catalog.refreshByPath(path)
    return True


# --- keyed tables fed by micro-batches ------------------------------------------------

def write_batch(batch: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """One folder per micro-batch.  A replayed batch overwrites its own folder as a whole, nothing else; in the dynamic mode
    of the session, months that only the failed attempt had would stay."""
    writer = batch.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/batch_id={batch_id}")


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current rows of a table written by :func:`write_batch`: the newest batch wins per key."""
    rows = spark.read.parquet(path)
    return first_per_key(rows, keys, [F.desc("batch_id")]).drop("batch_id")


def compact_batches(spark: SparkSession, path: str, new_path: str, keys: Sequence[str], keep: Column | None = None) -> None:
    """Rewrites the current rows in a new place; readers switch to it afterwards.

    ``keep`` drops expired rows on the way, such as feature rows older than two hours.
    """
    rows = spark.read.parquet(path)
    newest = first_per_key(rows, keys, [F.desc("batch_id")])
    if keep is not None:
        newest = newest.where(keep)
    newest.write.mode("errorifexists").partitionBy("batch_id").parquet(new_path)


# --- training data as CSV ------------------------------------------------------------

def write_training_csv(df: DataFrame, path: str) -> None:
    df.select(*schemas.TRAINING.names).write.mode("errorifexists").csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss")


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schemas.TRAINING, header=True)
