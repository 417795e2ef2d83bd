"""A Bloom filter over ids, to drop most rows before a shuffle.  Its size is bounded: past the bound
it lets more rows through, and the exact join that follows removes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.llm.words import mix

MOST_BITS = 27  # 16 MB
_SEEDS = (np.uint64(0x51ED270B), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47))


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(ids.astype(np.int64).view(np.uint64) ^ s) >> np.uint64(64 - bits) for s in _SEEDS]


def bloom_of(ids: DataFrame, column: str, rows: int) -> tuple[np.ndarray, int]:
    """(words of 64 bits, log2 of the number of bits) for about ``rows`` whole-number ids."""
    bits = int(np.clip(np.ceil(np.log2(16 * rows + 1)), 12, MOST_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for p in _places(batch[column].to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(filled, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(filled)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(filled[at].view(np.int64))], names=["at", "w"])

    rows_of = ids.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "at long, w long").groupBy("at").agg(
        F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows_of["at"].to_numpy()] = rows_of["w"].to_numpy().view(np.uint64)
    return out, bits


def may_hold(filled: np.ndarray, bits: int, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for p in _places(ids, bits):
        ok &= (filled[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok
