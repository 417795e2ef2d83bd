"""Near-duplicate documents by circulant MinHash, with every link confirmed on full sets.

A document's set is its distinct five-word shingles.  Signatures follow C-MinHash: one
permutation sends a shingle to a place on a ring, and the second permutation, shifted by k
places, ranks the ring for coordinate k.  So the K coordinates of a shingle are K neighbouring
entries of one table, and two permutations serve all of them.  Bands of the signature propose
candidates; whether two documents are linked is decided on their whole sets.

How large groups stay cheap: equal sets become one class first.  Candidate pairs are never
listed bucket by bucket.  Every class is compared with the smallest class of each of its buckets
(a star, linear in the number of classes).  Only where that leaves a candidate family in more
than one component, blocks of its classes are compared inside tasks, and only classes of
different components that share a band; a block emits at most one link per class.
Full sets are made again from the texts, only for documents that have a candidate partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.llm import words
from revpulse.llm.bloom import bloom_of, may_hold
from revpulse.llm.components import connected_components, cut

SHINGLE = 5
BANDS, ROWS = 20, 4  # at similarity 0.85 a pair shares no band with probability 4e-7
RING = 1 << 20
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000

_RNG = np.random.RandomState(7)


def _second_permutation(k: int) -> np.ndarray:
    ring = _RNG.__class__(7).permutation(RING).astype(np.uint32)
    return np.concatenate([ring, ring[:k]])


def shingle_sets(w: words.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of text d are hashes[first[d]:first[d + 1]].
    A text of fewer than k words, but not none, has its whole sequence as the one shingle."""
    h = w.hashes()
    counts, room = w.counts(), w.room()
    full = np.flatnonzero(room >= k)
    values, docs = words.grams(h, k)[full], w.doc[full]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            values = np.concatenate([values, words.grams(h, m)[w.first[short]] ^ np.uint64(m)])
            docs = np.concatenate([docs, short])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[new], docs[new]
    return values, np.searchsorted(docs, np.arange(len(counts) + 1))


def signatures(values: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """(texts, k) signature; rows of empty sets are meaningless."""
    second = _second_permutation(k)
    neighbours = np.lib.stride_tricks.sliding_window_view(second, k)
    place = (words.mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)  # 2**20 places
    out = np.full((len(first) - 1, k), np.iinfo(np.uint32).max, np.uint32)
    step = 1 << 13  # the gathered rows stay in cache
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a in range(0, len(values), step):
        part = docs[a:a + step]
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        lows = np.minimum.reduceat(neighbours[place[a:a + step]], heads, axis=0)
        out[part[heads]] = np.minimum(out[part[heads]], lows)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        key = words.combine(key, words.mix(parts[:, :, r] + np.uint64(r + 1)))
    return words.mix(key).view(np.int64)


_SETS = "doc_id long, n long, fp1 long, fp2 long, bands array<long>"


def _sets_of(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            w = words.words_of(words.texts_of(batch["text"]), words.NOT_SPACE, lower=True)
            values, first = shingle_sets(w)
            size = np.diff(first)
            keys = band_keys(signatures(values, first, bands * rows), bands, rows)
            fps = []
            for lane in range(2):
                spread = words.mix(values ^ np.uint64(0x1234567 + lane * 0x9E3779B97F4A7C15))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
                fps.append(words.mix(sums[first[1:]] - sums[first[:-1]] ^ size.astype(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(fps[0]), pa.array(fps[1]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
            ], names=["doc_id", "n", "fp1", "fp2", "bands"])
    return run


def _full_sets(wanted):
    """Whole sets of the documents that have a candidate partner, and of few others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, bits = wanted.value
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64())
            keep = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            keep = keep[may_hold(filled, bits, ids.take(pa.array(keep)).to_numpy())]
            for part in words.pieces(iter([batch.take(pa.array(keep))])):
                w = words.words_of(words.texts_of(part["text"]), words.NOT_SPACE, lower=True)
                values, first = shingle_sets(w)
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"].cast(pa.int64()), pa.array(np.diff(first).astype(np.int64)),
                    pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary()),
                ], names=["doc_id", "n", "shingles"])
    return run


def _confirm(percent: int):
    """Keeps the pairs whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["left"], batch["right"]
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (left, right))
                both = _common(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


def _compare_block(percent: int):
    """Links between classes of one block that are in different components and share a band."""
    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        group = {c: i for i, c in enumerate(dict.fromkeys(table["component"].to_pylist()))}
        parent = list(range(len(group)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        of = np.array([group[c] for c in table["component"].to_pylist()])
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"].combine_chunks()]
        bands = np.array(table["bands"].to_pylist(), dtype=np.int64)
        left = table["is_left"].to_numpy()
        size = np.array([len(s) for s in sets])
        made = []
        for x in np.flatnonzero(left):
            top = np.array([root(i) for i in range(len(parent))])[of]
            other = np.flatnonzero(
                (top != top[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
                & (bands == bands[x]).any(axis=1)
            )
            for y in other:
                if root(of[x]) == root(of[y]):
                    continue
                both = _common(sets[x], sets[y])
                if 100 * both >= percent * (size[x] + size[y] - both):
                    parent[root(of[x])] = root(of[y])
                    made.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([m[0] for m in made], pa.int64()), "b": pa.array([m[1] for m in made], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| on their full shingle sets;
    a component is what links reach, named by its smallest doc_id, which is the one kept.
    A null text or one without words has the empty set and no link.  A row without a doc_id has no
    link and no component and is kept.  Rows with one doc_id are one node.  Other columns are ignored.
    """
    sets = cut(docs.select("doc_id", "text").mapInArrow(_sets_of(bands, rows), _SETS))
    linkable = sets.where("n > 0 and doc_id is not null")
    classes = linkable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"))
    member = cut(linkable.select("doc_id", "n", "fp1", "fp2", "bands").join(classes, ["fp1", "fp2"])
                 .select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    reps = member.where("bands is not null")
    buckets = reps.select(F.col("rep").alias("node"), "n", F.explode("bands").alias("key"))
    centres = buckets.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
    star = cut(buckets.join(centres, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct())

    involved = star.select("a").union(star.select("b")).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(involved, "a", involved.count()))
    held = cut(docs.select("doc_id", "text").mapInArrow(_full_sets(wanted), "doc_id long, n long, shingles binary")
               .where("n > 0").join(involved.withColumnRenamed("a", "doc_id"), "doc_id"))

    def with_sets(pairs: DataFrame, names: dict[str, str]) -> DataFrame:
        for key, name in names.items():
            pairs = pairs.join(held.select(F.col("doc_id").alias(key), F.col("shingles").alias(name)), key)
        return pairs

    sizes = reps.select("rep", "n").distinct()
    fit = (
        star.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a")
        .join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("n_b")), "b")
        .where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")).select("a", "b")
    )
    linked = cut(with_sets(fit, {"a": "left", "b": "right"}).select("a", "b", "left", "right").mapInArrow(_confirm(percent), "a long, b long"))

    # Families of candidates that the star left in several components.
    family = connected_components(star).withColumnRenamed("component", "family")
    part = connected_components(linked)
    placed = cut(family.join(part, "node", "left").withColumn("component", F.coalesce("component", "node")))
    counted = placed.join(sizes, placed.node == sizes.rep).groupBy("family", "component").agg(
        F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    weighed = counted.groupBy("family").agg(
        F.count("*").alias("parts"), F.max_by("component", F.struct("docs", -F.col("component"))).alias("main"),
        F.max(F.struct("docs", -F.col("component"), "shingles")).alias("top"),
        F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"),
    ).where("parts > 1")
    blocks = lambda n, s: F.ceil(F.greatest(F.expr(n) / BLOCK_DOCS, F.expr(s) / BLOCK_SHINGLES)).cast("int")
    weighed = weighed.select(
        "family", "main",
        F.when(blocks("docs", "shingles") <= 1, F.lit(1)).otherwise(blocks("docs - top.docs", "shingles - top.shingles")).alias("lefts"),
        F.when(blocks("docs", "shingles") <= 1, F.lit(0)).otherwise(blocks("top.docs", "top.shingles")).alias("mains"),
    )
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    units = (
        placed.join(weighed, "family")
        .withColumn("is_left", (F.col("component") != F.col("main")) | (F.col("mains") == 0))
        .withColumn("block", F.when(F.col("is_left"), spread % F.col("lefts")).otherwise(F.col("lefts") + spread % F.col("mains")).cast("int"))
        # A block of left classes meets itself and all later blocks; main blocks do not meet each other.
        .withColumn("unit", F.explode(F.when(F.col("is_left"), F.concat(
            F.transform(F.sequence(F.col("block"), F.col("lefts") + F.col("mains") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))),
            F.filter(F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))), lambda u: u.i < u.j),
        )).otherwise(F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))))))
        .select("family", "unit", "node", "component", "is_left")
    )
    banded = held.join(reps.select(F.col("rep").alias("doc_id"), "bands"), "doc_id").withColumnRenamed("doc_id", "node")
    more = units.join(banded.select("node", "bands", "shingles"), "node").groupBy("family", "unit").applyInArrow(_compare_block(percent), "a long, b long")
    # What the blocks found joins components, and so does an id that stands for texts of several classes.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last").select("doc_id", "b")
    joins = more.unionByName(member.join(several, "doc_id").select(F.col("rep").alias("a"), "b"))
    named = part.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    joins = joins.join(named, "a", "left").join(named.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    final = connected_components(joins).toDF("__part", "__final")
    found = (
        member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
        .join(part.toDF("rep", "__in"), "rep", "left").withColumn("__part", F.coalesce("__in", "rep"))
        .join(final, "__part", "left").select("doc_id", F.coalesce("__final", "__part").alias("component"))
    )
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
