"""Repeated passages by seed and extend on winnowed anchors.

Seeds.  Every run of ``window`` words selects one anchor: the word k-gram with the smallest hash in it.  The choice depends on the words of the run alone, so equal runs select the same anchor at the same
place: two documents that share a run share a seed.  Anchors are joined across documents; those that only one text
holds, once, are dropped, and with them most of the corpus.

Extension.  From a shared seed every document extends to both sides over all runs that selected it.  Which of them repeat is
decided on two 64-bit hashes of the whole run and a global minimum of (document, place): an aggregate with a map-side
minimum, so a passage that is in a third of all documents is neither gathered nor paired.  Overlapping repeated
runs merge into maximal repeats.

Equal texts are settled before that, by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.llm import words
from revpulse.llm.components import cut
from revpulse.llm.sharding import with_rank

WINDOW, GRAM = 20, 8
_PLACES = 27  # bits of a word's place in its text; the document's rank stands above them


def _selected(w: words.Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor hash) of every run of ``window`` words."""
    runs = np.flatnonzero(w.room() >= window)
    if not len(runs):
        return runs, np.zeros(0, np.uint64)
    g = words.grams(h, gram)
    span = window - gram + 1
    low = g[: len(g) - span + 1].copy()
    for j in range(1, span):
        np.minimum(low, g[j:len(g) - span + 1 + j], out=low)
    return runs, low[runs]


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            w = words.words_of(words.texts_of(batch["text"]), words.NOT_SPACE, lower=False)
            h = w.hashes()
            runs, anchor = _selected(w, h, window, gram)
            if not len(runs):
                continue
            # An anchor counts twice in its text if its k-gram occurs twice: runs then repeat only there.
            g = words.grams(h, gram)
            docs = w.doc[runs]
            order = np.lexsort((anchor, docs))
            docs, anchor = docs[order], anchor[order]
            new = np.r_[True, (docs[1:] != docs[:-1]) | (anchor[1:] != anchor[:-1])]
            docs, anchor = docs[new], anchor[new]
            places = np.flatnonzero(w.room() >= gram)
            keys = np.sort(words.mix(g[places] + w.doc[places].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            own = words.mix(anchor + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            at = np.searchsorted(keys, own)
            twice = np.r_[keys, np.uint64(0)][np.minimum(at + 1, len(keys))] == own
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch["c1"].take(pa.array(docs)), pa.array(twice)],
                                             names=["anchor", "c1", "twice"])
    return run


def _candidates(batch: pa.RecordBatch, w: words.Words, h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """First words of the runs whose anchor is a seed of their text."""
    runs, anchor = _selected(w, h, window, gram)
    seeds = batch["seeds"]
    flat = seeds.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = np.asarray(pc.fill_null(pc.list_value_length(seeds), 0), dtype=np.int64)
    if not len(flat) or not len(runs):
        return runs[:0]
    known, code = np.unique(flat, return_inverse=True)
    have = np.sort(np.repeat(np.arange(len(size)), size) * len(known) + code)
    at = np.searchsorted(known, anchor)
    at[at == len(known)] = 0
    ok = known[at] == anchor
    key = w.doc[runs] * len(known) + at
    place = np.searchsorted(have, key)
    place[place == len(have)] = 0
    return runs[ok & (have[place] == key)]


def _runs(window: int, gram: int):
    """(h1, h2, at) of the first place of every candidate run in the piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            w = words.words_of(words.texts_of(batch["text"]), words.NOT_SPACE, lower=False)
            h = w.hashes()
            at = _candidates(batch, w, h, window, gram)
            rank = batch["rank"].to_numpy(zero_copy_only=False)[w.doc[at]]
            place = rank << _PLACES | at - w.first[w.doc[at]]
            one, two = words.grams(h, window)[at], words.grams(w.hashes(1), window, 1)[at]
            order = np.lexsort((place, two, one))
            one, two, place = one[order], two[order], place[order]
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64)), pa.array(place[new])], names=["h1", "h2", "at"])
    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _cut_out(kept: list[str], window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            w = words.words_of(words.texts_of(batch["text"]), words.NOT_SPACE, lower=False)
            n = len(w.doc)
            at = _candidates(batch, w, w.hashes(), window, gram)
            firsts = batch["firsts"]
            size = np.asarray(pc.fill_null(pc.list_value_length(firsts), 0), dtype=np.int64)
            stay = np.repeat(w.first[:-1], size) + firsts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            gone = np.setdiff1d(at, stay, assume_unique=True)
            copy = batch["is_copy"].to_numpy(zero_copy_only=False) & (w.counts() >= window)
            edge = np.bincount(gone, minlength=n + 1) - np.bincount(np.minimum(gone + window, n), minlength=n + 1)
            removed = (np.cumsum(edge[:-1]) > 0) | copy[w.doc]
            spans, texts = [], []
            data = w.data
            for d in range(batch.num_rows):
                a, b = w.first[d], w.first[d + 1]
                r = np.flatnonzero(np.diff(np.r_[False, removed[a:b], False]))
                spans.append([{"start": int(s), "stop": int(e)} for s, e in r.reshape(-1, 2)])
                if not len(r):
                    texts.append(b" ".join(data[w.start[a]:w.end[b - 1]].tobytes().split()) if b > a else b"")
                    continue
                parts, bounds = [], np.r_[0, r, b - a].reshape(-1, 2)
                for s, e in bounds:
                    if e > s:
                        parts.append(b" ".join(data[w.start[a + s]:w.end[a + e - 1]].tobytes().split()))
                texts.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays([
                *[batch[c] for c in kept], pa.array(w.counts().astype(np.int64)), pa.array(spans, _SPANS), pa.array(texts, pa.binary()).cast(pa.string()),
            ], names=[*kept, "n_words", "removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with ``n_words``, ``removed`` (maximal repeated spans in words, end exclusive) and
    ``kept_text`` (the other words joined by one space).

    A word is removed if a run of ``window`` words over it also starts earlier: in a document with a smaller doc_id, or
    earlier in the same one.  Rows without a doc_id come last; different texts with one doc_id are ordered by
    their hashes; rows that repeat a document are one document and get its result.  A null or empty text has no words.
    Other columns are ignored.
    """
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(1), "text").alias("c2"))
    ids = base.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("order"), F.col("doc_id").cast("long").alias("doc_id"), "c1", "c2").distinct()
    ranked, _ = with_rank(ids, ["order", "doc_id", "c1", "c2"])
    first = ranked.groupBy("c1", "c2").agg(F.min("rank").alias("first"))
    ranked = ranked.join(first, ["c1", "c2"]).select("doc_id", "c1", "c2", "rank", (F.col("rank") > F.col("first")).alias("is_copy"))

    # Read twice: making the anchors again costs less than keeping them.
    held = base.select("text", "c1").mapInArrow(_anchors(window, gram), "anchor long, c1 long, twice boolean")
    shared = held.groupBy("anchor").agg(F.min("c1").alias("low"), F.max("c1").alias("high"), F.max("twice").alias("twice")).where(
        "low <> high or twice").select("anchor")
    seeds = held.select("anchor", "c1").join(shared, "anchor").groupBy("c1").agg(F.collect_set("anchor").alias("seeds"))
    info = cut(ranked.join(seeds, "c1", "left"))

    def with_text(more: DataFrame) -> DataFrame:
        more = more.withColumnRenamed("doc_id", "__id").withColumnRenamed("c1", "__c1").withColumnRenamed("c2", "__c2")
        return base.join(more, (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("c1") == F.col("__c1")) & (F.col("c2") == F.col("__c2")))

    places = with_text(info.where("not is_copy and seeds is not null")).select("text", "rank", "seeds").mapInArrow(_runs(window, gram), "h1 long, h2 long, at long")
    firsts = places.groupBy("h1", "h2").agg(F.min("at").alias("at")).groupBy(F.shiftright("at", _PLACES).alias("rank")).agg(
        F.collect_list((F.col("at").bitwiseAND((1 << _PLACES) - 1)).cast("int")).alias("firsts"))
    whole = with_text(info.withColumn("seeds", F.when(~F.col("is_copy"), F.col("seeds"))).join(cut(firsts), "rank", "left"))
    return whole.select("doc_id", "text", "is_copy", "seeds", "firsts").mapInArrow(
        _cut_out(["doc_id"], window, gram), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, removed array<struct<start:int,stop:int>>, kept_text string")
