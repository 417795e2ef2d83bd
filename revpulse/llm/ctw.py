"""Scores of texts under a context-tree-weighting model of bytes, beside a unigram baseline.

The model.  A byte is eight binary decisions along a tree of 255 inner nodes.  Every node has a tree of contexts, the
last 0 to DEPTH bytes; each (context, node) holds a Krichevsky-Trofimov estimate from its counts of zeros and
ones.  From the leaves up, the weighted probability of a context is half its own estimate plus half the product of its
extensions, which mixes the estimates of all depths; the share of its own estimate in that sum is its
weight when a new bit is predicted.  A context never seen predicts one half.

The model reads the lower-cased words of a text joined by single spaces, then one end byte.

How it is spread.  Counts of (context, byte) are summed over all training texts; the trees below three context bytes are built
apart, in parallel (so the most frequent pair of bytes is many tasks), the level above from their sums, and the two above that have at
most 65,535 nodes.  For scoring, the contexts are cut into blocks of at most ``BLOCK`` entries by their last two bytes, or
three where a pair has more; each block is broadcast in a pass of its own, and a text's score is the sum of its passes.  A block
of one triple has 2**24 entries at the very most, so nothing that is broadcast grows with the data; the number of passes does.

The baseline needs the count of every word.  Words with at least a millionth of all tokens (so at most a million words) are
broadcast; the others are joined on their hash.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.llm import words
from revpulse.llm.components import cut

DEPTH = 5
BLOCK = 2_000_000
FREQUENT = 1_000_000
END_BYTE = 10
END_WORD = np.uint64(0xE5D0C5D0E5D0C5D1)
_GRAMS, _WORDS = 0, 1
_DEPTH_AT = np.uint64(48)  # node keys: depth, context, node
_HELD = 500_000  # keys a task gathers before it hands them on


class HashIndex:
    """Positions of 64-bit keys, by open addressing on whole arrays; the keys themselves are not copied."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(math.ceil(math.log2(2 * len(keys) + 2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.at, self.keys = np.full(1 << bits, -1, np.int32), keys
        slot = (words.mix(keys) >> self.shift).astype(np.int64)
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            lost = self.at[slot] != left
            left, slot = left[lost], slot[lost] + 1 & self.mask

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index into the keys, or -1."""
        slot = (words.mix(values) >> self.shift).astype(np.int64)
        out = self.at[slot]
        left = np.flatnonzero(out >= 0)
        left = left[self.keys[out[left]] != values[left]]
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.mask
            out[left] = self.at[slot]
            some = np.flatnonzero(out[left] >= 0)
            some = some[self.keys[out[left[some]]] != values[left[some]]]
            left, slot = left[some], slot[some]
        return out


def model_bytes(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first) of the words of each text joined by spaces, each text with its end byte."""
    size = w.end - w.start + 1
    n = len(w.first) - 1
    ends = np.cumsum(size)
    flat = np.repeat(w.start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = np.r_[w.data, np.uint8(0)][flat]
    out[ends - 1] = 32
    lasts = w.first[1:][np.diff(w.first) > 0] - 1
    out[ends[lasts] - 1] = END_BYTE
    sums = np.r_[0, ends]
    empty = np.diff(w.first) == 0
    out = np.insert(out, sums[w.first[:-1][empty]], END_BYTE)
    length = np.where(empty, 1, sums[w.first[1:]] - sums[w.first[:-1]])
    return out, np.r_[0, np.cumsum(length)] if n else np.zeros(1, np.int64)


def gram_keys(data: np.ndarray, first: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For every byte: its last ``depth`` bytes, the latest highest, then the byte.  Before a text stand end bytes."""
    n = len(data)
    key = np.zeros(n, np.uint64)
    for j in range(1, depth + 1):
        before = np.full(n, END_BYTE, np.uint8)
        before[j:] = data[: max(n - j, 0)]
        over = (first[:-1, None] + np.arange(j)).ravel()
        before[over[over < n]] = END_BYTE
        key = key << np.uint64(8) | before
    return key << np.uint64(8) | data


def _log_gamma_half(n: np.ndarray, plus: float) -> np.ndarray:
    """log gamma(n + plus) for whole n >= 0, by a shift and Stirling's series."""
    x = n + plus + 8.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    shift = sum(np.log(n + plus + i) for i in range(8))
    return series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma_half(zeros, 0.5) + _log_gamma_half(ones, 0.5) - np.log(np.pi) - _log_gamma_half(zeros + ones, 1.0)


def _levels(keys: np.ndarray, counts: np.ndarray):
    """For each of the eight decisions of sorted (context, byte) keys: (context and node, zeros, ones)."""
    context, byte = keys >> np.uint64(8) << np.uint64(8), keys & np.uint64(255)
    for j in range(8):
        node = context | np.uint64(1 << j) | byte >> np.uint64(8 - j)
        one = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, heads) if len(heads) else np.zeros(0, np.int64)
        ones = np.add.reduceat(np.where(one, counts, 0), heads) if len(heads) else total
        yield node[heads], total - ones, ones


def build(keys: np.ndarray, counts: np.ndarray, depth: int, least: int, below: dict[int, tuple] | None = None) -> list[dict]:
    """Nodes of all depths from ``depth`` down to ``least``, from sorted distinct keys of ``depth`` context bytes.

    Each entry has depth, node (context and node), zeros, ones, weighted (log probability), weight, one (probability of a one).
    ``below`` gives the nodes one level deeper, if they are not built here.
    """
    out = []
    for d in range(depth, least - 1, -1):
        entry: dict = {"depth": d}
        parts = []
        for j, (node, zeros, ones) in enumerate(_levels(keys, counts)):
            own = log_kt(zeros, ones)
            if below is None:
                weighted, weight = own, np.ones(len(own))
            else:
                child, inside = below[j]
                parent = child >> np.uint64(16) << np.uint64(8) | child & np.uint64(255)
                longer = np.bincount(np.searchsorted(node, parent), weights=inside, minlength=len(node))
                weighted = np.logaddexp(own, longer) - np.log(2)
                weight = np.exp(own - np.log(2) - weighted)
            parts.append((node, zeros, ones, weighted, weight, (ones + 0.5) / (zeros + ones + 1.0)))
        below = {j: (p[0], p[3]) for j, p in enumerate(parts)}
        for i, name in enumerate(("node", "zeros", "ones", "weighted", "weight", "one")):
            entry[name] = np.concatenate([p[i] for p in parts])
        out.append(entry)
        if d > least:
            keys, at = np.unique(keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255), return_inverse=True)
            counts = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
    return out


def _sorted(x: np.ndarray, order: np.ndarray, last) -> np.ndarray:
    """``x`` in that order and one more entry, in a single copy."""
    out = np.empty(len(x) + 1, x.dtype)
    np.take(x, order, out=out[:-1])
    out[-1] = last
    return out


class Model:
    """Sorted (context, byte) keys with their counts, and the weights of all shorter contexts.

    The longest contexts need no table of nodes: the count of a node is that of a range of keys.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, node: np.ndarray, weight: np.ndarray, one: np.ndarray, depth: int):
        order = np.argsort(keys)
        self.keys, self.sums, self.depth = keys[order], np.r_[0, np.cumsum(counts[order])], depth
        order = np.argsort(node)
        self.node, self.weight, self.one = (_sorted(x, order, last) for x, last in ((node, ~np.uint64(0)), (weight, 0), (one, 0.5)))
        self._index = None

    def index(self) -> HashIndex:
        """Of the keys; built once in a worker that holds the model, not once a task, and given up with it."""
        if self._index is None:
            self._index = HashIndex(self.keys)
        return self._index

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after its context."""
        out = np.zeros(len(keys))
        byte, context = keys & np.uint64(255), keys >> np.uint64(8)
        for j in range(8):
            prefix = byte >> np.uint64(8 - j)
            one = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            low = context << np.uint64(8) | prefix << np.uint64(8 - j)
            a, m, b = (self.sums[np.searchsorted(self.keys, low + np.uint64(step))] for step in (0, 1 << (7 - j), 1 << (8 - j)))
            p = (np.where(one, b - m, m - a) + 0.5) / (b - a + 1.0)  # one half if never seen
            for d in range(self.depth - 1, -1, -1):
                key = np.uint64(d) << _DEPTH_AT | context >> np.uint64(8 * (self.depth - d)) << np.uint64(8) | np.uint64(1 << j) | prefix
                at = np.searchsorted(self.node, key)
                w, q = self.weight[at], self.one[at]
                p = np.where(self.node[at] == key, w * np.where(one, q, 1 - q) + (1 - w) * p, 0.5)
            out += np.log10(p)
        return out


# --- training ----------------------------------------------------------------------------------------------

class _Counter:
    """Distinct keys with counts, merged as they come."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.waiting.append((k, n))
        self.size += len(k)
        if self.size > 2 * _HELD:
            self.merge()

    def merge(self) -> None:
        k = np.concatenate([self.keys, *[w[0] for w in self.waiting]])
        n = np.concatenate([self.counts, *[w[1] for w in self.waiting]])
        self.keys, at = np.unique(k, return_inverse=True)
        self.counts = np.bincount(at, weights=n, minlength=len(self.keys)).astype(np.int64)
        self.waiting, self.size = [], len(self.keys)

    def give(self, kind: int) -> pa.RecordBatch:
        self.merge()
        out = pa.RecordBatch.from_arrays([pa.array(np.full(len(self.keys), kind, np.int32)), pa.array(self.keys.view(np.int64)), pa.array(self.counts)], names=["kind", "key", "n"])
        self.__init__()
        return out


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {_GRAMS: _Counter(), _WORDS: _Counter()}
        for batch in words.pieces(batches):
            w = words.words_of(words.texts_of(batch["text"]), words.NOT_SPACE, lower=True)
            seen[_WORDS].add(np.r_[w.hashes(), np.full(batch.num_rows, END_WORD)])
            seen[_GRAMS].add(gram_keys(*model_bytes(w), depth))
            for kind, counter in seen.items():
                if len(counter.keys) > _HELD:
                    yield counter.give(kind)
        for kind, counter in seen.items():
            yield counter.give(kind)
    return run


def _subtrees(depth: int, split: int, second: bool):
    """For the grams of one partition: with ``second`` the sums of the nodes with ``split`` context bytes, else the weights of
    the nodes with as many or more (the longest, which have none, left out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["key"].to_numpy().view(np.uint64), b["n"].to_numpy()) for b in batches]
        if not parts:
            return
        keys, counts = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(keys)
        for e in build(keys[order], counts[order], depth, split):
            if second and e["depth"] == split:
                yield pa.RecordBatch.from_arrays([pa.array(e["node"].view(np.int64)), pa.array(e["zeros"]), pa.array(e["ones"]), pa.array(e["weighted"])],
                                                 names=["node", "zeros", "ones", "weighted"])
            elif not second and e["depth"] < depth:
                key = np.uint64(e["depth"]) << _DEPTH_AT | e["node"]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(e["weight"]), pa.array(e["one"])], names=["key", "weight", "one"])
    return run


def _mixed(zeros: np.ndarray, ones: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted, weight, one) of nodes from their counts and the sum of their extensions' weighted probabilities."""
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, inside) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted), (ones + 0.5) / (zeros + ones + 1.0)


def _middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with two context bytes from the sums of those with three."""
    for batch in batches:
        zeros, ones, inside = (batch[c].to_numpy() for c in ("zeros", "ones", "weighted"))
        weighted, weight, one = _mixed(zeros, ones, inside)
        yield pa.RecordBatch.from_arrays([batch["node"], batch["zeros"], batch["ones"], *map(pa.array, (weighted, weight, one))],
                                         names=["node", "zeros", "ones", "weighted", "weight", "one"])


_SUMS = "node long, zeros long, ones long, weighted double"


def _sums_above(nodes: DataFrame) -> DataFrame:
    """Sums of nodes over the nodes one context byte shorter."""
    up = (F.shiftleft(F.shiftright("node", 16), 8) + F.col("node").bitwiseAND(255)).alias("node")
    return nodes.groupBy(up).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))


def _top(second: pa.Table) -> list[dict]:
    """Depths 1 and 0 from depth-2 nodes summed by their last byte and node: at most 65,280 rows."""
    node = second["node"].to_numpy().view(np.uint64)
    order = np.argsort(node)
    node, zeros, ones, inside = (x[order] for x in (node, *(second[c].to_numpy() for c in ("zeros", "ones", "weighted"))))
    out = []
    for d in (1, 0):
        weighted, weight, one = _mixed(zeros, ones, inside)
        out.append({"depth": d, "node": node, "weight": weight, "one": one})
        if d:
            up, at = np.unique(node & np.uint64(255), return_inverse=True)
            zeros, ones, inside = (np.bincount(at, weights=x, minlength=len(up)) for x in (zeros, ones, weighted))
            node = up
    return out


class Blocks:
    """The block of every context: by its last two bytes, for the ``large`` pairs by its last three.  Unseen contexts are in block 0."""

    def __init__(self, large: list[int]):
        self.pairs, self.triples, self.count = np.zeros(1 << 16, np.int32), np.zeros((len(large), 256), np.int32), 1
        self.large = np.full(1 << 16, -1, np.int32)
        self.large[large] = np.arange(len(large))

    def of(self, gram: np.ndarray, depth: int) -> np.ndarray:
        pair = (gram >> np.uint64(8 * depth - 8)).astype(np.int64)
        out, row = self.pairs[pair], self.large[pair]
        many = np.flatnonzero(row >= 0)
        if len(many):
            out[many] = self.triples[row[many], (gram[many] >> np.uint64(8 * depth - 16) & np.uint64(255)).astype(np.int64)]
        return out

    def members(self, b: int) -> tuple[list[int], list[int]]:
        """(pairs, triples) of a block."""
        whole = np.flatnonzero((self.pairs == b) & (self.large < 0))
        rows, third = np.nonzero(self.triples == b)
        pair = np.flatnonzero(self.large >= 0)[np.argsort(self.large[self.large >= 0])][rows] if len(rows) else rows
        return whole.tolist(), (pair << 8 | third).tolist()


def _columns(df: DataFrame, names: tuple[str, ...], more: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of a frame as arrays, each with more entries behind; what Arrow held is given up column by column."""
    table, out = df.toArrow(), []
    for name, extra in zip(names, more):
        column = table[name]
        whole = np.empty(len(column) + sum(map(len, extra)), column.type.to_pandas_dtype())
        done = 0
        for part in [c.to_numpy(zero_copy_only=False) for c in column.chunks] + extra:
            whole[done:done + len(part)] = part.view(whole.dtype)
            done += len(part)
        out.append(whole)
        del column
        table = table.drop_columns([name])
    return out


class Trained:
    """Counts and nodes as tables, and the figures that describe them."""

    def __init__(self, docs: DataFrame, depth: int):
        if not 2 <= depth <= 5:
            raise ValueError("depth must be 2 to 5: a key holds so many context bytes")
        self.depth = depth
        spark = docs.sparkSession
        counts = cut(docs.select("text").mapInArrow(_count(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
        self.words = counts.where(F.col("kind") == _WORDS).select("key", "n")
        self.grams = counts.where(F.col("kind") == _GRAMS).select("key", "n")
        total = self.words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.distinct = int(total["n"] or 0), int(total["v"])
        self.split = min(3, depth)
        self.pair = F.shiftright("key", 8 * depth - 8).alias("pair")  # the last two context bytes
        self.part = F.shiftright("key", 8 * (depth - self.split) + 8).alias("part")  # the last three
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.parted = self.grams.repartition(tasks, self.part)  # a tree below three bytes lies in one partition
        nodes = self.parted.mapInArrow(_subtrees(depth, self.split, True), _SUMS)
        self.middle = None
        if self.split == 3:
            self.middle = nodes = cut(_sums_above(nodes).mapInArrow(_middle, f"{_SUMS}, weight double, one double"))
        self.top = _top(_sums_above(nodes).toArrow())

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of the words with at least a FREQUENT-th of all tokens."""
        t = self.words.where(F.col("n") * FREQUENT >= self.tokens).toArrow()
        return t["key"].to_numpy().view(np.uint64), t["n"].to_numpy()

    def blocks(self, most: int) -> Blocks:
        """Runs of pairs of last context bytes with at most ``most`` grams; a pair with more is cut by its third byte."""
        per = self.grams.groupBy(self.pair).count().toArrow()  # at most 65,536 rows
        size = dict(zip(per["pair"].to_numpy().tolist(), per["count"].to_numpy().tolist()))
        large = sorted(p for p, n in size.items() if n > most) if self.split == 3 else []
        groups = [(p, None, n) for p, n in size.items() if p not in set(large)]
        if large:
            wanted = F.broadcast(self.grams.sparkSession.createDataFrame([(p,) for p in large], "pair long"))
            split = self.grams.withColumn("pair", self.pair).join(wanted, "pair", "left_semi").groupBy(self.part).count().collect()  # 256 a large pair
            groups += [(r["part"] >> 8, r["part"] & 255, r["count"]) for r in split]
        block, now, held = Blocks(large), 0, 0
        for pair, third, n in sorted(groups, key=lambda g: (g[0], g[1] or 0)):
            if held and held + n > most:
                now, held = now + 1, 0
            held += n
            if third is None:
                block.pairs[pair] = now
            else:
                block.triples[large.index(pair), third] = now
        block.count = now + 1
        return block

    def block(self, of: Blocks, b: int) -> tuple[Broadcast, np.ndarray]:
        """(broadcast model, log10 probabilities of its gram keys and a 0 behind them) of one block."""
        spark = self.grams.sparkSession
        grams, parted, middle = self.grams, self.parted, self.middle
        if of.count > 1:
            pairs, triples = of.members(b)
            whole = F.broadcast(spark.createDataFrame([(p,) for p in pairs], "pair long"))
            some = F.broadcast(spark.createDataFrame([(t,) for t in triples], "part long"))

            def mine(x: DataFrame) -> DataFrame:
                keys = x.withColumn("pair", self.pair).withColumn("part", self.part)
                found = keys.join(whole, "pair", "left_semi")
                return (found.unionByName(keys.join(some, "part", "left_semi")) if triples else found).select("key", "n")

            grams, parted = mine(grams), mine(parted)
            if middle is not None:
                near = F.broadcast(spark.createDataFrame([(p,) for p in sorted({*pairs, *(t >> 8 for t in triples)})], "pair long"))
                middle = middle.withColumn("pair", F.shiftright("node", 8)).join(near, "pair", "left_semi")
        deep = parted.mapInArrow(_subtrees(self.depth, self.split, False), "key long, weight double, one double")
        if middle is not None:
            deep = deep.unionByName(middle.select((F.col("node") + F.lit(2 << int(_DEPTH_AT))).alias("key"), "weight", "one"))
        key, weight, one = _columns(deep, ("key", "weight", "one"), [[np.uint64(e["depth"]) << _DEPTH_AT | e["node"] for e in self.top], *[[e[c] for e in self.top] for c in ("weight", "one")]])
        keys, counts = _columns(grams, ("key", "n"), [[], []])
        shared = spark.sparkContext.broadcast(Model(keys.view(np.uint64), counts, key.view(np.uint64), weight, one, self.depth))
        del key, weight, one, keys, counts
        pa.default_memory_pool().release_unused()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(shared.value.log10(batch["key"].to_numpy().view(np.uint64)))], names=["key", "p"])

        known = grams.select("key").mapInArrow(score, "key long, p double").toArrow()
        return shared, _sorted(known["p"].to_numpy(), np.argsort(known["key"].to_numpy().view(np.uint64)), 0)


# --- scoring -----------------------------------------------------------------------------------------------

_ROWS = "h long, kind int, id long, n long, doc_id long, held int, n_tokens long, n_bytes long, n_known long, base double, model double"


_PIECE = 1 << 18  # bytes of text that a task holds arrays for at a time


def _score(model, shared, with_words: bool):
    """One row per document (kind 1) and, in the pass with words, one per document and rare word (kind 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (p, frequent, logs, of, b) = model.value, shared.value
        known, words_at = table.index(), HashIndex(frequent)

        def batch_of(cols: list, n: int, kind: int) -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            names = ("h", "kind", "id", "n", "doc_id", "held", "n_tokens", "n_bytes", "n_known", "base", "model")
            given = dict(cols, kind=np.full(n, kind, np.int32))
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c not in given else given[c] if isinstance(given[c], pa.Array) else pa.array(given[c], t) for c, t in zip(names, types)], names=names)

        for batch in words.pieces(batches, most=_PIECE):
            w = words.words_of(words.texts_of(batch["text"]), words.NOT_SPACE, lower=True)
            n = batch.num_rows
            data, first = model_bytes(w)
            gram = gram_keys(data, first, table.depth)
            mine = of.of(gram, table.depth) == b
            at = known.find(gram)
            part = p[at]  # the last entry where there is none
            missing = np.flatnonzero((at < 0) & mine)
            if len(missing):
                rare, back = np.unique(gram[missing], return_inverse=True)
                part[missing] = table.log10(rare)[back]
            total = np.add.reduceat(part, first[:-1]) if n else np.zeros(0)
            ids = batch["id"].to_numpy(zero_copy_only=False)
            row = {"h": ids, "id": ids, "doc_id": batch["doc_id"], "held": batch["held"], "n_tokens": w.counts() + 1, "n_bytes": np.diff(first), "model": total}
            if with_words:
                h = np.r_[w.hashes(), np.full(n, END_WORD)]
                doc = np.r_[w.doc, np.arange(n)]
                at = words_at.find(h)
                common = at >= 0
                row["base"] = np.bincount(doc[common], weights=logs[at[common]], minlength=n)
                row["n_known"] = np.bincount(doc[common], minlength=n)
                h, doc = h[~common], doc[~common]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                heads = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
                yield batch_of(list({"h": h[heads].view(np.int64), "id": ids[doc[heads]], "doc_id": batch["doc_id"].take(pa.array(doc[heads])), "n": np.diff(np.r_[heads, len(h)])}.items()), len(heads), 0)
            yield batch_of(list(row.items()), n, 1)
    return run


def score(docs: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs`` (doc_id, text).

    Both models learn from the rows whose crc32(doc_id as text) mod 10 is not 0 (a missing doc_id counts as the empty text).
    A null or empty text is the end token alone.  ``score`` and ``base_score`` are log10 probabilities, bits_per_byte is the
    code length of the model's bytes.  Repeated rows count, and are told, as often as they occur.  Other columns are ignored.
    With no training row every token is unknown and every bit has probability one half.
    """
    spark = docs.sparkSession
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("id"), (rest == 0).cast("int").alias("held"))
    trained = Trained(base.where("held = 0"), depth)
    hashes, counts = trained.frequent()
    below = trained.tokens + 0.1 * (trained.distinct + 1)
    logs = np.log10((counts + 0.1) / below)
    of = trained.blocks(block)
    rows = None
    for b in range(of.count):
        model, p = trained.block(of, b)
        shared = spark.sparkContext.broadcast((p, hashes, logs, of, b))
        part = base.mapInArrow(_score(model, shared, b == 0), _ROWS)
        rows = part if rows is None else rows.unionByName(part)
    rare = trained.words.where(F.col("n") * FREQUENT < trained.tokens).select(F.col("key").alias("h"), F.lit(0).alias("kind"), F.col("n").alias("c"))
    met = rows.join(rare, ["h", "kind"], "left")
    word = F.col("kind") == 0
    passes = of.count
    per = met.groupBy("doc_id", "id").agg(  # rows of one id are told apart by a hash of their texts
        F.max("held").alias("held"), F.max("n_tokens").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"),
        (F.sum(F.when(~word, 1)) / passes).cast("int").alias("times"), F.sum("n_known").alias("near"), F.sum("base").alias("base"), F.sum("model").alias("model"),
        F.sum(F.when(word & (F.col("c") > 0), F.col("n"))).alias("far"),
        F.sum(F.when(word, F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(below)))).alias("far_base"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per.withColumn("__copy", F.explode(F.sequence(F.lit(1), "times"))).select(
        "doc_id", (F.col("held") == 1).alias("held_out"), "n_tokens", ((zero("near") + zero("far")) / F.col("times")).cast("long").alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"), ((zero("base") + zero("far_base")) / F.col("times")).alias("base_score"),
        (F.col("model") / F.col("times")).alias("score"), (-F.col("model") / F.col("times") / F.col("n_bytes") / F.lit(math.log10(2))).alias("bits_per_byte"))
