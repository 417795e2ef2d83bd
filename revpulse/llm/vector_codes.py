"""Vector codes: product quantisation with whole numbers, distances through per-dimension value dictionaries.

A vector of whole numbers is cut into parts; each part is coded by the nearest entry of its codebook.  Vectors are packed
into blocks once, every dimension as a dictionary of its distinct values and one dictionary code per vector.  For a given
codebook the squared differences of every dictionary value to every entry are tabulated once a block; the distance of a
part to all entries is then a sum of table rows, gathered by the codes.

Codebooks are refined in rounds: a pass over the blocks gives sums and counts per entry, added up in Spark, and only
those reach the driver: entries times components, whatever the number of vectors.  All arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.llm.components import cut

BLOCK, CHUNK = 4096, 512  # vectors packed together, and whose distances are held at a time
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LONG = (1 << 63) - 1
_LIMB, _SUMS = 32, 16  # bits of a partial sum's digit, components per row of sums


def whole_numbers(column: pa.Array, scale: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, floor(scale * x)) of the vectors with ``size`` finite components; exact in doubles, as ``scale`` is a power of two."""
    n = np.asarray(pc.fill_null(pc.list_value_length(column), -1), dtype=np.int64)
    rows = np.flatnonzero(n == size)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    first = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * flat[first[rows][:, None] + np.arange(size)])
    ok = np.isfinite(x).all(axis=1)
    return rows[ok], x[ok]


@dataclass
class Block:
    """Vectors as dictionary codes: vector r has value values[j][codes[j][r]] in dimension j."""

    values: list[np.ndarray]
    codes: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> "Block":
        found = [np.unique(x[:, j], return_inverse=True) for j in range(x.shape[1])]
        codes = np.stack([c.reshape(-1) for _, c in found]) if found else np.zeros((0, len(x)))
        return Block([v for v, _ in found], codes.astype(np.uint16))

    def exact(self, codebook: np.ndarray) -> type:
        """The narrowest type that holds every distance to the entries of a part."""
        most = max([int(np.abs(v).max(initial=0)) for v in self.values] + [max((abs(int(y)) for y in codebook.flat), default=0)])
        bound = codebook.shape[2] * (2 * most) ** 2
        return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object

    def numbers(self, j: int, kind: type) -> np.ndarray:
        return np.array([int(v) for v in self.values[j]], object) if kind is object else self.values[j].astype(kind)

    def nearest(self, part: int, entries: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of one part of every vector; ties go to the lower entry.  ``entries`` is (entries, components)."""
        k, m = entries.shape
        n = self.codes.shape[1]
        tables = []
        for c in range(m):
            apart = self.numbers(part * m + c, kind)[:, None] - entries[:, c].astype(kind)[None, :]
            tables.append(apart * apart)
        best, least = np.zeros(n, np.int64), np.zeros(n, kind)
        for a in range(0, n, CHUNK):
            b = min(n, a + CHUNK)
            total = np.zeros((b - a, k), kind)
            for c, table in enumerate(tables):
                total += table[self.codes[part * m + c, a:b]]
            best[a:b] = total.argmin(axis=1)
            least[a:b] = total[np.arange(b - a), best[a:b]]
        return best, least


def _pack(scale: int, size: int, padded: int, label: bool):
    """Rows to blocks: vec_id and label lists, dictionaries end to end, codes (dimension by dimension)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            while held and (last or sum(len(x) for _, x in held) >= BLOCK):
                rows = pa.Table.from_batches([r for r, _ in held]).combine_chunks()
                x = np.concatenate([x for _, x in held])
                held.clear()
                if len(x) > BLOCK:
                    held.append((rows.slice(BLOCK).to_batches()[0], x[BLOCK:]))
                rows, x = rows.slice(0, BLOCK), x[:BLOCK]
                block = Block.of(np.concatenate([x, np.zeros((len(x), padded - size))], axis=1))
                at = pa.array([0, len(x)], pa.int32())
                lists = [pa.ListArray.from_arrays(at, rows[c].combine_chunks()) for c in rows.column_names]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([np.concatenate([*block.values, np.zeros(0)]).tobytes()]), pa.array([[len(v) for v in block.values]], pa.list_(pa.int32())),
                                                  pa.array([block.codes.tobytes()])], names=[*rows.column_names, "values", "sizes", "codes"])

        names = ["vec_id", "label"] if label else ["vec_id"]
        for batch in batches:
            rows, x = whole_numbers(batch["embedding"], scale, size)
            if len(rows):
                held.append((batch.select(names).take(pa.array(rows)), x))
                yield from give(False)
        yield from give(True)
    return run


def _block(batch: pa.RecordBatch, r: int) -> Block:
    sizes = np.asarray(batch["sizes"][r].values, dtype=np.int64) if len(batch["sizes"][r]) else np.zeros(0, np.int64)
    values = np.split(np.frombuffer(batch["values"][r].as_buffer(), np.float64), np.cumsum(sizes)[:-1]) if len(sizes) else []
    return Block(values, np.frombuffer(batch["codes"][r].as_buffer(), np.uint16).reshape(len(sizes), len(batch["vec_id"][r])))


def _digits(x: int) -> list[int]:
    """``x`` in base 2**32, the last digit with its sign."""
    out = []
    while not -(1 << 31) <= x < 1 << 31:
        out.append(x & (1 << _LIMB) - 1)
        x >>= _LIMB
    return [*out, x]


def _sums(codebooks: np.ndarray):
    """(part, entry, chunk, digit, n, s): counts, and digit sums of up to 16 components; one set a task."""
    parts, k, m = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, m), object)
        for batch in batches:
            for r in range(batch.num_rows):
                block = _block(batch, r)
                kind = block.exact(codebooks)
                wide = np.int64 if kind is np.int32 else kind
                for p in range(parts):
                    best, _ = block.nearest(p, codebooks[p], kind)
                    order = np.argsort(best, kind="stable")
                    used, first = np.unique(best[order], return_index=True)
                    count[p] += np.bincount(best, minlength=k)
                    for c in range(m):
                        x = block.numbers(p * m + c, wide)[block.codes[p * m + c]][order]
                        if wide is np.int64 and int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62:
                            x = x.astype(object)
                        total[p, used, c] += np.add.reduceat(x, first).astype(object)
        rows = []
        for p, e in zip(*np.nonzero(count)):
            for chunk in range(0, max(m, 1), _SUMS):
                digits = [_digits(v) for v in total[p, e, chunk:chunk + _SUMS]]
                for d in range(max(map(len, digits), default=1)):
                    s = [x[d] if d < len(x) else 0 for x in digits]
                    rows.append((int(p), int(e), chunk, d, int(count[p, e]) if chunk == d == 0 else 0, s + [0] * (_SUMS - len(s))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int32()] * 4, pa.int64(), pa.list_(pa.int64())))],
                                             names=["part", "entry", "chunk", "digit", "n", "s"])
    return run


def refine(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Every entry replaced by floor(sum / count) of the parts nearest to it; unused entries stay."""
    told = blocks.mapInArrow(_sums(codebooks), "part int, entry int, chunk int, digit int, n long, s array<long>")
    rows = told.groupBy("part", "entry", "chunk", "digit").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(_SUMS)]).collect()
    count = {(r["part"], r["entry"]): r["n"] for r in rows if r["chunk"] == r["digit"] == 0}
    total: dict[tuple[int, int, int], int] = {}
    for r in rows:
        for i in range(min(_SUMS, codebooks.shape[2] - r["chunk"])):
            at = (r["part"], r["entry"], r["chunk"] + i)
            total[at] = total.get(at, 0) + (r[f"s{i}"] << _LIMB * r["digit"])
    out = codebooks.copy()
    for (p, e, c), s in total.items():
        out[p, e, c] = s // count[p, e]
    return out


def _code(codebooks: np.ndarray, label: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = _block(batch, r)
                kind = block.exact(codebooks)
                found = [block.nearest(p, codebooks[p], kind) for p in range(len(codebooks))]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes()
                error = sum(f[1].astype(object) for f in found)
                w = len(codebooks)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"][r].values, *([batch["label"][r].values] if label else []), pa.array([codes[i:i + w].hex() for i in range(0, len(codes), w)], pa.string()),
                     pa.array([min(int(e), LONG) for e in error], pa.int64())], names=["vec_id", *(["label"] if label else []), "code", "error"])
    return run


def as_text(codebooks: np.ndarray) -> str:
    return ",".join(str(int(y)) for y in codebooks.flat)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, [label,] code, error) of every kept vector, codebooks as whole numbers by part, entry and component).

    Vectors that are null or hold null or non-finite components are dropped (a double so large that ``scale`` times it is
    not finite counts as such).  One length is coded, the commonest, the longer on a tie; vectors of another length are
    dropped too.  A length that ``parts`` does not divide is filled up with zeros.  The codebooks start from the ``entries``
    smallest ids, equal ids in the order of their vectors; a null id is coded but starts no entry.  Repeated rows are
    coded each and count each.  With fewer ids than ``entries`` there are fewer entries; with none, nothing is coded.
    Errors beyond a long are told as the largest long.  ``label`` is passed on if there is one; other columns are ignored.
    """
    if not 0 < entries <= 256 or scale & (scale - 1):
        raise ValueError("1 to 256 entries, and a scale that is a power of two")
    label = "label" in vectors.columns
    vectors = vectors.select("vec_id", *(["label"] if label else []), "embedding")
    plain = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False))))
    size = plain.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    size = size["d"] if size else 0
    padded = -(-size // parts) * parts
    kept = plain.where(F.size("embedding") == size)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    lists = ", ".join(f"{c} array<{kinds[c]}>" for c in vectors.columns[:-1])
    blocks = cut(kept.mapInArrow(_pack(scale, size, padded, label), f"{lists}, values binary, sizes array<int>, codes binary"))
    first = kept.where("vec_id is not null").orderBy("vec_id", "embedding").select("embedding").limit(entries).collect()  # at most 256 vectors
    start = [[int(np.floor(scale * x)) for x in r["embedding"]] + [0] * (padded - size) for r in first]
    codebooks = np.array(start, object).reshape(len(start), parts, padded // parts).transpose(1, 0, 2)
    coded = f"{', '.join(f'{c} {kinds[c]}' for c in vectors.columns[:-1])}, code string, error long"
    if not start:
        return vectors.sparkSession.createDataFrame([], coded), codebooks
    for _ in range(rounds):
        codebooks = refine(blocks, codebooks)
    return blocks.mapInArrow(_code(codebooks, label), coded), codebooks


def with_label_error(coded: DataFrame, few: int = 10_000) -> DataFrame:
    """``coded`` with ``label_error``: the errors summed over equal labels, null labels together, at most the largest long."""
    sums = cut(coded.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error")))
    side = F.broadcast(sums) if sums.count() <= few else sums
    return coded.join(side, coded["label"].eqNullSafe(sums["__label"])).drop("__label")
