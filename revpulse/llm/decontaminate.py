"""Benchmark passages inside documents: a prefix-filtered set join with exact verification.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words is one
window).  As a set it consists of its shingles.  A document contains a window only if it holds
all of its shingles, so the necessary prefix of a window is one token: its rarest shingle, by
counts over all documents.  Documents are joined on these prefix tokens alone.  The place of
the token inside the window gives the only possible alignment, which the position and length
bounds check, and the item-sized stretch of the document is then compared word by word, bytes
included.

The benchmark side is cut into blocks of at most ``BLOCK`` windows; each block is broadcast and
all documents are read against it, so nothing that is broadcast grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.llm import words
from revpulse.llm.components import cut

WINDOW, SHINGLE = 10, 5
BLOCK = 400_000  # windows; about 100 MB as arrays at the very most
_AT_ONCE = 100_000  # candidates verified together


def _windows_of(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            w = words.words_of(words.texts_of(batch["text"]), words.ALNUM, lower=True)
            item, held = batch["item"].to_pylist(), []
            for d, n in enumerate(w.counts()):
                a = w.first[d]
                held += [(w.text(a + i, a + i + min(window, n), d), item[d]) for i in range(max(1, n - window + 1) if n else 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.string())], names=["words", "item"])
    return run


class Lookup:
    """Where 64-bit keys stand in a sorted list: a bit table rules out most, binary search decides."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = int(np.clip(np.ceil(np.log2(len(self.keys) * 16 + 1)), 10, 24))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.keys >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into values, index into keys) of every value that is a key."""
        at = np.flatnonzero(self.table[values >> self.shift])
        key = np.searchsorted(self.keys, values[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == values[at] if len(self.keys) else np.zeros(0, bool)
        return at[same], key[same]


class Block:
    """Windows of one block as arrays, with the lookup of their shingles or of their prefixes."""

    def __init__(self, table: pa.Table, shingle: int):
        column = table["words"].combine_chunks().cast(pa.large_binary())
        coded = column.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.words = words.words_of(words.texts_of(coded.dictionary.cast(pa.large_string())), words.ALNUM, lower=True)
        self.hash = self.words.hashes()
        self.size = self.words.counts()
        of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(of, kind="stable")
        names = table["item"].combine_chunks().dictionary_encode()
        self.names = names.dictionary.to_pylist()
        self.items = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        self.items_at = np.searchsorted(of[order], np.arange(len(self.size) + 1))
        self.k = np.minimum(self.size, shingle)
        self.found: dict[int, Lookup] = {}
        self.tokens: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by k: hash, window, offset
        for k in np.unique(self.k):
            g = words.grams(self.hash, int(k))
            at = np.flatnonzero((self.k[self.words.doc] == k) & (self.words.room() >= k))
            self.tokens[int(k)] = g[at], self.words.doc[at], at - self.words.first[self.words.doc[at]]
            self.found[int(k)] = Lookup(g[at])

    def keep_prefixes(self, counts: dict[int, np.ndarray]) -> None:
        """Of every window only its rarest shingle stays."""
        self.start = {}
        for k, (h, win, off) in self.tokens.items():
            n = counts[k][np.searchsorted(self.found[k].keys, h)]
            order = np.lexsort((off, h, n, win))
            first = order[np.r_[True, win[order][1:] != win[order][:-1]]]
            h, win, off = h[first], win[first], off[first]
            order = np.argsort(h, kind="stable")
            self.tokens[k] = h[order], win[order], off[order]
            self.found[k] = Lookup(h)
            self.start[k] = np.searchsorted(h[order], self.found[k].keys)

    def candidates(self, w: words.Words, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, first word) of every alignment within the bounds."""
        room = w.room()
        for k, (token, win, off) in self.tokens.items():
            at, key = self.found[k].find(words.grams(h, k))
            fits = room[at] >= k
            at, key = at[fits], key[fits]
            lows = self.start[k]
            n = np.append(lows[1:], len(token))[key] - lows[key]
            bounds = np.r_[0, np.cumsum(n)]
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _AT_ONCE, side="right")) - 1)
                each = np.repeat(lows[key[i:j]], n[i:j]) + _ramp(n[i:j])
                window, begin = win[each], np.repeat(at[i:j], n[i:j]) - off[each]
                doc = w.doc[np.repeat(at[i:j], n[i:j])]
                inside = (begin >= w.first[doc]) & (begin + self.size[window] <= w.first[doc + 1])
                yield window[inside], begin[inside]
                i = j

    def verify(self, w: words.Words, h: np.ndarray, window: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """True where the stretch of the document equals the window, word by word and byte by byte."""
        own = self.words
        ok = _all_equal(h, begin, self.hash, own.first[window], self.size[window])
        left = np.flatnonzero(ok)
        n = self.size[window[left]]
        a, b = np.repeat(begin[left], n) + _ramp(n), np.repeat(own.first[window[left]], n) + _ramp(n)
        length = w.end[a] - w.start[a]
        same = length == own.end[b] - own.start[b]
        same[same] = _all_equal(w.data, w.start[a[same]], own.data, own.start[b[same]], length[same])
        if len(left):
            ok[left] = np.logical_and.reduceat(same, np.r_[0, np.cumsum(n)[:-1]])
        return ok


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _all_equal(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each i whether x[x_at:][:n] equals y[y_at:][:n]; every n is at least 1."""
    if not len(n):
        return np.zeros(0, bool)
    step = _ramp(n)
    return np.logical_and.reduceat(x[np.repeat(x_at, n) + step] == y[np.repeat(y_at, n) + step], np.r_[0, np.cumsum(n)[:-1]])


def _count_shingles(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        total = {k: np.zeros(len(f.keys), np.int64) for k, f in b.found.items()}
        for batch in words.pieces(batches):
            w = words.words_of(words.texts_of(batch["text"]), words.ALNUM, lower=True)
            h, room = w.hashes(), w.room()
            for k, f in b.found.items():
                at, key = f.find(words.grams(h, k))
                total[k] += np.bincount(key[room[at] >= k], minlength=len(f.keys))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], names=["k", "at", "n"])
    return run


_HITS = "array<struct<start:int,stop:int>>"


def _find(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for batch in words.pieces(batches):
            w = words.words_of(words.texts_of(batch["text"]), words.ALNUM, lower=True)
            h, n = w.hashes(), len(w.doc)
            edge = np.zeros(n + 1, np.int64)
            seen = []
            for window, begin in b.candidates(w, h):
                ok = b.verify(w, h, window, begin)
                window, begin = window[ok], begin[ok]
                edge += np.bincount(begin, minlength=n + 1) - np.bincount(begin + b.size[window], minlength=n + 1)
                if len(window):
                    seen.append(np.unique(np.stack([w.doc[begin], window]), axis=1))
            inside = np.cumsum(edge[:-1]) > 0
            new = np.r_[True, w.doc[1:] != w.doc[:-1]] if n else np.zeros(0, bool)
            opens = np.flatnonzero(inside & (new | ~np.r_[False, inside[:-1]])) if n else np.zeros(0, int)
            closes = np.flatnonzero(inside & (np.r_[new[1:], True] | ~np.r_[inside[1:], False])) + 1 if n else np.zeros(0, int)
            hits = [[] for _ in range(batch.num_rows)]
            for s, e in zip(opens, closes):
                d = w.doc[s]
                hits[d].append({"start": int(s - w.first[d]), "stop": int(e - w.first[d])})
            items = [set() for _ in range(batch.num_rows)]
            if seen:
                for d, window in np.unique(np.concatenate(seen, axis=1), axis=1).T:
                    items[d].update(b.names[i] for i in b.items[b.items_at[window]:b.items_at[window + 1]])
            for d, (old_hits, old_items) in enumerate(zip(batch["hits"].to_pylist(), batch["items"].to_pylist())):
                if old_items:
                    items[d].update(old_items)
                    hits[d] = _union(hits[d] + old_hits)
            yield pa.RecordBatch.from_arrays([
                batch["row"], batch["text"], pa.array(w.counts().astype(np.int64)),
                pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ], names=["row", "text", "n_words", "hits", "items"])
    return run


def _union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
        else:
            out.append(dict(s))
    return out


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``hits`` (spans of hit words, counted in words from 0) and
    ``items`` (ids of the items found, as strings, sorted).

    ``docs`` needs ``text``, ``items`` needs ``item_id`` and ``text``; columns of ``docs`` with the three
    new names are replaced.  Words are runs of letters and digits (any character beyond ASCII counts as
    one) after lower-casing A-Z.  Null and empty texts have no words; items without an id or
    without words take no part; rows that repeat an item count once.  With no items nothing is hit.
    """
    spark = docs.sparkSession
    pairs = cut(items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
                .mapInArrow(_windows_of(window), "words binary, item string").distinct())
    blocks = max(1, -(-pairs.count() // block))
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    frame = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "text",
        F.lit(0).cast("long").alias("n_words"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    # The struct would carry the text a second time.
    others = [c for c in kept if c != "text"]
    frame = frame.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in others]) if others else F.struct(F.lit(0).alias("none")))
    for i in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == i).toArrow()
        held = Block(part, shingle)
        shared = spark.sparkContext.broadcast(held)
        counts = {k: np.zeros(len(f.keys), np.int64) for k, f in held.found.items()}
        for r in docs.select("text").mapInArrow(_count_shingles(shared), "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():
            counts[r["k"]][r["at"]] = r["n"]  # at most as many rows as the block has shingles
        shared.unpersist()
        held.keep_prefixes(counts)
        frame = frame.mapInArrow(_find(spark.sparkContext.broadcast(held)), frame.schema)
        if i + 1 < blocks:
            frame = cut(frame)
    return frame.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in kept], "n_words", "hits", "items")
