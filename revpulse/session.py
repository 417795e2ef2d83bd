"""Session settings this package is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH = {
    "spark.sql.session.timeZone": "UTC",
    # Sizes, not counts: AQE merges small shuffle partitions and splits skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "134217728",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
STREAMING = {
    # Window and dedup state can outgrow the heap; RocksDB keeps it on local disk with
    # changelog checkpoints on shared storage.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "50",
    "spark.sql.streaming.schemaInference": "false",
}


def builder(app: str = "revpulse", shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """A builder with these settings.  The number of shuffle partitions is fixed into a stream's
    checkpoint at its first start, so choose it for the final size of the state."""
    b = SparkSession.builder.appName(app)
    for key, value in {**BATCH, **STREAMING}.items():
        b = b.config(key, value)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return b
