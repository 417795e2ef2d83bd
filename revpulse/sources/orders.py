"""The order message stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpulse import fixed, schemas
from revpulse.plans.once import computed_once

POSITION = ["partition", "offset"]
_RELAXED = ("development", "local", "test")


def kafka_options(servers: str, topic: str = "order_events", *, env: str = "development",
                  starting: str | None = None, max_per_trigger: int = 10000) -> dict[str, str]:
    """Reader options.  Outside development a new query starts at the end of the topic and
    lost offsets are an error."""
    relaxed = env.strip().lower() in _RELAXED
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting or ("earliest" if relaxed else "latest"),
        "failOnDataLoss": "false" if relaxed else "true",
        "maxOffsetsPerTrigger": str(max_per_trigger),
    }


def read_order_stream(spark: SparkSession, source: str | Mapping[str, str], *,
                      starting: str = "earliest", max_per_trigger: int = 10000) -> DataFrame:
    """Raw messages with a string column ``value``; those of Kafka also with their place (``POSITION``).

    ``source`` is a mapping of Kafka options (see :func:`kafka_options`) or a folder of
    newline-delimited JSON files; for files the admission limit counts files.
    """
    if isinstance(source, Mapping):
        options = {"startingOffsets": starting, "maxOffsetsPerTrigger": str(max_per_trigger), **source}
        raw = spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.col("value").cast("string").alias("value"), *POSITION)
    return (
        spark.readStream.option("maxFilesPerTrigger", max_per_trigger)
        .option("latestFirst", "false").text(source).select("value")
    )


def parse_order_events(raw: DataFrame, schema=schemas.ORDER_SCHEMA, keep: Sequence[str] = ()) -> DataFrame:
    """JSON text to typed columns.  Text that is not a valid message leaves null columns and
    stays in ``_corrupt_record``; nothing is dropped here.  ``keep`` names further input columns."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    data = F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"})
    flat = computed_once(raw.select("value", *keep), "data", data).select("data.*", "value", *keep)
    return flat.select(
        "event_id", "event_type",
        F.try_to_timestamp("timestamp").alias("event_timestamp"),
        "order_id", "product_id", "product_name", "category", "quantity",
        F.col("unit_price").try_cast("decimal(10,2)").alias("unit_price"),
        F.col("total_amount").try_cast("decimal(10,2)").alias("total_amount"),
        "region", "payment_method", "_corrupt_record", "value", *keep,
    )


def partition_by_region(events: DataFrame) -> DataFrame:
    """Rows in event order within each region.

    Hash partitioning would put the busiest region into one task.  Ranges of (region, time)
    keep each region's rows in order from one partition to the next and split a busy one, at
    the price of a sampling pass over the input.
    """
    order = ["region", "event_timestamp", "event_id"]
    return events.repartitionByRange(*order).sortWithinPartitions(*order)


def shard_of(region: Column, shards: Mapping[str, str] = fixed.REGION_SHARDS, default: str = fixed.DEFAULT_SHARD) -> Column:
    """Name of the store that holds a region."""
    pairs = [F.lit(x) for pair in shards.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), region), F.lit(default))
