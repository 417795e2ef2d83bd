"""Shards along a Hilbert curve over several metadata columns.

Each column is quantised to a few bits by quantiles over all rows (text columns by the place of their distinct values, counted
and sorted in Spark).  The Hilbert index of the cell orders the rows; runs of equal length of this order are the
shards.  Neighbours on the curve are neighbours in every column, so the files of a shard span a narrow range of each and
a reader skips files by any of them.

The order is global without one task seeing it all: range partitions are sorted apart, and a row's place is its place
in the partition plus the rows of the partitions before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpulse.llm.components import cut

BITS = 5
_ROW = (1 << 33) - 1  # low bits of monotonically_increasing_id


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``cells`` (rows, dimensions), values below 2**bits."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the finer levels, from the coarsest on
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType))


def _number(df: DataFrame, name: str) -> Column:
    """The column as a number of the same order."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return F.unix_seconds(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _text_cell(df: DataFrame, name: str, bits: int) -> Column:
    """Cell of a text column: 2**bits times the share of rows with a smaller value, null before all.

    Distinct values are counted and range-partitioned; only the smallest value of each cell reaches the driver."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = df.where(F.length(f"`{name}`") > 0).groupBy(F.col(f"`{name}`").alias("v")).agg(F.count("*").alias("n"))
    placed = cut(values.repartitionByRange(tasks, "v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()))
    sums = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row per range partition
    total, starts = sum(n for _, n in sums), []
    rest = df.count() - total
    before = rest  # null and empty ones
    for part, n in sums:
        starts.append((part, before))
        before += n
    running = F.sum("n").over(Window.partitionBy("part").orderBy("v")) - F.col("n")
    within = placed.withColumn("before", running).join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")
    cell = F.expr(f"(before + start) * {1 << bits} div {max(total + rest, 1)}")
    firsts = within.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).orderBy("cell").collect()  # 2**bits rows at most
    out = F.lit(0)
    for r in firsts:
        out = F.when(F.col(f"`{name}`") >= F.lit(r["v"]), r["cell"]).otherwise(out)
    return out.cast("double")


def curve_order(df: DataFrame, dims: Sequence[str], bits: int = BITS) -> DataFrame:
    """``df`` with ``hilbert`` (long).  A null, NaN or empty value lies in the lowest cell of its column."""
    texts = [_is_text(df, d) for d in dims]
    coded = df.withColumns({f"__dim{i}": _text_cell(df, d, bits) if text else _number(df, d) for i, (d, text) in enumerate(zip(dims, texts))})
    cuts = coded.agg(*[
        F.percentile_approx(F.when(~F.isnan(f"__dim{i}"), F.col(f"__dim{i}")), [j / (1 << bits) for j in range(1, 1 << bits)], 10_000).alias(f"c{i}")
        for i in range(len(dims)) if not texts[i]
    ], F.count("*")).first()
    steps = [np.arange(1 << bits)[:-1] + 0.5 if text else np.unique(np.array(cuts[f"c{i}"] or [], float)) for i, text in enumerate(texts)]
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.searchsorted(s, np.nan_to_num(pc.fill_null(batch[f"__dim{i}"], float("-inf")).to_numpy(zero_copy_only=False), nan=-np.inf), side="left") for i, s in enumerate(steps)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(hilbert_index(np.stack(cells, axis=1), bits))], names=[*names, "hilbert"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "hilbert long"])
    return coded.mapInArrow(run, schema)


def with_rank(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """(``df`` with ``rank`` from 0 in the order of the columns, number of rows)."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for p, n in counts:  # one row per range partition
        rows.append((p, before))
        before += n
    starts = spark.createDataFrame(rows, "__part long, __before long")
    ranked = placed.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(starts), "__part")
    return ranked.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(_ROW)).drop("__at", "__part", "__before"), before


def assign_shards(docs: DataFrame, dims: Sequence[str] = ("lang", "source", "n_chars"), shards: int = 16, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, hilbert, shard, slot) for every row of ``docs``; counts of shards differ by one at most.

    Rows of one cell are ordered by the checksum of the text and the id, so equal texts with equal metadata lie
    side by side.  A null text has size 1 and the checksum of the empty text; a null id comes first; repeated rows get
    a place each.  Dimensions that ``docs`` lacks are left out; other columns are ignored.
    """
    dims = [d for d in dims if d in docs.columns]
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
                       *[F.col(f"`{d}`").alias(f"dim_{i}") for i, d in enumerate(dims)])
    ordered = curve_order(rows, [f"dim_{i}" for i in range(len(dims))], bits) if dims else rows.withColumn("hilbert", F.lit(0).cast("long"))
    ranked, n = with_rank(ordered.select("doc_id", "size", "text_crc32", "hilbert"), ["hilbert", "text_crc32", "doc_id"])
    shard = F.expr(f"rank * {shards} div {max(n, 1)}")
    return ranked.withColumn("__s", shard).select(
        "doc_id", "size", "text_crc32", "hilbert", F.col("__s").cast("int").alias("shard"),
        (F.col("rank") - F.expr(f"(__s * {n} + {shards - 1}) div {shards}")).alias("slot"))


def write_shards(docs: DataFrame, path: str, dims: Sequence[str] = ("lang", "source", "n_chars"), shards: int = 16, bits: int = BITS) -> None:
    """Writes ``docs`` as Parquet below ``path``/shard=N, each file a run of the curve.  A column named ``shard`` is replaced."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    copy = F.row_number().over  # repeated rows take their places one by one
    own = docs.drop("shard").withColumns({"__crc": F.crc32(raw), "__copy": copy(Window.partitionBy("doc_id", F.crc32(raw)).orderBy("doc_id"))})
    placed = assign_shards(docs, dims, shards, bits).select(
        F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__sum"), F.col("slot").alias("__slot"), F.col("shard").alias("shard"),
        copy(Window.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot")).alias("__nth"))
    joined = own.join(placed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__crc") == F.col("__sum")) & (F.col("__copy") == F.col("__nth")))
    out = joined.drop("__id", "__sum", "__crc", "__copy", "__nth")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(max(tasks, shards), "shard", "__slot").sortWithinPartitions("shard", "__slot").drop("__slot").write.partitionBy("shard").parquet(path)
