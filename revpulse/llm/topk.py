"""Exact inner-product top k by the threshold algorithm over sorted per-dimension lists.

Vectors are packed into blocks; a block's values are sorted per dimension once.  For a query every
list is read from the end that its weight prefers, all lists to the same depth.  Vectors met for the first time are scored
in full.  What lies deeper scores at most the sum of the weighted values at the current depth, so reading stops
when that bound is below the kth score so far; scores equal to the kth are thus never missed.
Within a task the kth score carries over from block to block.

Queries are packed into blocks too, and blocks of queries meet blocks of vectors by an equi-join on a group number; a
task holds one block of each and k results per query of its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 4096, 512
LONG = (1 << 63) - 1


def whole_numbers(column: pa.Array, scale: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By length of the vectors: (row numbers, floor(scale * x) as doubles).  Vectors that are null, empty, or hold null or
    non-finite components are left out."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    out = {}
    with np.errstate(invalid="ignore", over="ignore"):
        for d in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == d)
            x = np.floor(scale * flat[first[rows][:, None] + np.arange(d)]) + 0.0  # no negative zeros
            ok = np.isfinite(x).all(axis=1)
            out[int(d)] = rows[ok], x[ok]
    return out


_PACKED = "dim int, ids binary, vectors binary, uid long"


def _pack(most: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def give(d: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(p) for p in zip(*held.pop(d)))
            rest_ids, rest = ids[most:], x[most:]
            if len(rest_ids):
                held[d] = [(rest_ids, rest)]
            ids, x = ids[:most], x[:most]
            uid = int(np.bitwise_xor.reduce(ids * np.int64(0x9E3779B97F4A7C)) & 0x7FFFFFFFFFFF)
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([uid])],
                                              names=["dim", "ids", "vectors", "uid"])

        for batch in batches:
            ids = batch["vec_id"].to_numpy(zero_copy_only=False)
            for d, (rows, x) in whole_numbers(batch["embedding"], scale).items():
                held.setdefault(d, []).append((ids[rows].astype(np.int64), x))
                while d in held and sum(len(p[0]) for p in held[d]) >= most:
                    yield give(d)
        for d in list(held):
            while d in held and sum(len(p[0]) for p in held[d]):
                yield give(d)
    return run


def exactly(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([int(v) for v in x.flat], object).reshape(x.shape) if kind is object else x.astype(kind)


class Lists:
    """A block's vectors with their order in every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type = np.float64):
        self.ids, self.x = ids, exactly(vectors, kind)
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)

    def top(self, own: int, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Up to k (scores, ids), best first, of the vectors that can score ``floor`` or more; ties by id.  ``own`` is left out."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        wanted = np.concatenate([up, down])
        if not len(wanted):  # all scores are 0
            ids = np.sort(self.ids[self.ids != own], kind="stable")[:k]
            return np.zeros(len(ids)), ids
        seen = np.zeros(n, bool)
        scores, ids = np.zeros(0), np.zeros(0, np.int64)
        depth, step = 0, max(4, n // 64)
        while True:
            to = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[n - to:n - depth, up].ravel()] = True
            met[self.order[depth:to, down].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            new = new[self.ids[new] != own]
            got = np.clip(self.x[new] @ q, -LONG, LONG) if self.x.dtype == object and len(new) else self.x[new] @ q
            good = got >= floor
            scores, ids = np.concatenate([scores, got[good]]), np.concatenate([ids, self.ids[new[good]]])
            if len(scores) > k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
            if len(scores) >= k:
                floor = max(floor, scores.min())
            depth, step = to, step * 2
            if depth >= n:
                break
            bound = self.sorted[n - 1 - depth, up] @ q[up] + self.sorted[depth, down] @ q[down]
            if min(bound, LONG) < floor:
                break
        best = np.lexsort((ids, -scores))
        return scores[best], ids[best]


def _exact(x: np.ndarray, q: np.ndarray) -> type:
    """The narrowest type in which every partial sum is exact."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * x.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, lists_of = None, None
        kept, kept_of = None, None

        def give() -> pa.RecordBatch:
            n = [len(kept["scores"][i]) for i in range(len(kept["ids"]))]
            cat = lambda p, t: pa.array(np.concatenate([np.asarray(x) for x in p]) if p else [], t)
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(kept["ids"], n), pa.int64()), pa.array(np.repeat(kept["key"], n), pa.int64()),
                cat(kept["found"], pa.int64()), cat(kept["scores"], pa.int64())], names=["query_id", "query_key", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                d = batch["dim"][r].as_py()
                raw = {c: np.frombuffer(batch[c][r].as_buffer(), t) for c, t in (("q_ids", np.int64), ("q_vectors", np.float64), ("ids", np.int64), ("vectors", np.float64))}
                q, x = raw["q_vectors"].reshape(-1, d), raw["vectors"].reshape(-1, d)
                uid = (batch["q_uid"][r].as_py(), d, len(q))
                if kept_of != uid or not np.array_equal(kept["ids"], raw["q_ids"]):
                    if kept_of is not None:
                        yield give()
                    key = (q.view(np.uint64) * (np.arange(d, dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))).sum(axis=1).view(np.int64)
                    kept = {"ids": raw["q_ids"].copy(), "key": key, "scores": [np.zeros(0, np.int64)] * len(q), "found": [np.zeros(0, np.int64)] * len(q)}
                    kept_of = uid
                kind = _exact(x, q)
                if lists_of != (kind, batch["ids"][r]):
                    lists, lists_of = Lists(raw["ids"].copy(), x, kind), (kind, batch["ids"][r])
                for i in range(len(q)):
                    have = kept["scores"][i]
                    weights = exactly(q[i], kind)
                    s, v = lists.top(int(raw["q_ids"][i]), weights, k, int(have[-1]) if len(have) >= k else -np.inf)
                    s, v = np.concatenate([have, s.astype(np.int64)]), np.concatenate([kept["found"][i], v])
                    best = np.lexsort((v, -s))[:k]
                    kept["scores"][i], kept["found"][i] = s[best], v[best]
        if kept_of is not None:
            yield give()
    return run


def search(queries: DataFrame, vectors: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products for every query.

    Both tables have vec_id and embedding; components count as floor(scale * x).  A row is not a result of
    a query with its own vec_id.  Ties go to the smaller vec_id.  Rows with a null vec_id, and vectors that are null,
    empty, or hold null or non-finite components (or such that ``scale`` times them is not finite) take no part; a score beyond
    a long counts as the largest or smallest long.  Vectors meet those of the same length only.  Repeated query rows are one query; repeated vectors are results each.  Other columns are ignored.
    """
    def packed(df: DataFrame, most: int) -> tuple[DataFrame, int]:
        df = df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        blocks = max(1, -(-df.count() // most))
        return df.repartition(blocks).mapInArrow(_pack(most, scale), _PACKED), blocks

    asked, _ = packed(queries.select("vec_id", "embedding").distinct(), QUERIES)
    held, blocks = packed(vectors, BLOCK)
    groups = min(blocks, 4096)
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("uid").alias("q_uid"),
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    held = held.withColumn("group", F.pmod(F.xxhash64("uid", "dim"), F.lit(groups)).cast("int"))
    met = asked.join(held, ["group", "dim"]).select("dim", "q_uid", "q_ids", "q_vectors", "ids", "vectors")
    best = met.sortWithinPartitions("dim", "q_uid", "q_ids").mapInArrow(_search(k), "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
