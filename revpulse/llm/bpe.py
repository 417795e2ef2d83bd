"""Byte-pair encoding and decoding with a public vocabulary, as batched numpy merge rounds.

The distinct words of a piece lie end to end in one flat array of symbols.  A round finds the rank of
every neighbouring pair by binary search over the sorted pair keys, takes the lowest rank of each
word, and merges it, until no word has a pair left.  Words already encoded by a task are kept in a
bounded table, so a common word costs one look-up.

The vocabulary file (``tokenizers`` JSON: BPE with a word-end suffix over byte-level symbols) is read
once on the driver and broadcast; its size does not depend on the data.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from revpulse.llm import words

KEPT_WORDS = 150_000  # words a task remembers before it starts anew

# Fixed patterns of the vocabulary: white space as its regular expressions understand it, and the words.
_SPACE = r"\x09-\x0D\x20\x85\xA0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        self.end = end
        self.size = size
        left, right = (np.array([vocab[m[j]] for m in model["merges"]], np.int64) for j in (0, 1))
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        # The first rank in which a token takes part.  A merge whose product takes part only later
        # can be done at all its places in a word at once.
        soonest = np.full(size, _NONE)
        ranks = np.arange(len(keys))
        np.minimum.at(soonest, left, ranks)
        np.minimum.at(soonest, right, ranks)
        self.at_once = soonest[made] > ranks


def merge_words(v: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the ids of word i are ids[first[i]:first[i + 1]].  Words are not empty."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sym = v.inner[data]
    ends = np.cumsum(size) - 1
    sym[ends] = v.last[data[ends]]
    word = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(sym))  # where a symbol's first byte stands
    done = []
    while len(sym):
        key = sym[:-1] * v.size + sym[1:]
        at = np.searchsorted(v.keys, key)
        at[at == len(v.keys)] = 0
        rank = np.full(len(sym), _NONE)
        rank[:-1] = np.where((v.keys[at] == key) & (word[:-1] == word[1:]), v.rank[at], _NONE)
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lows = np.minimum.reduceat(rank, heads)
        low = np.repeat(lows, np.diff(np.r_[heads, len(sym)]))
        over = low == _NONE
        if over.any():
            done.append((place[over], sym[over], word[over]))
            sym, word, place, rank, low = (x[~over] for x in (sym, word, place, rank, low))
            if not len(sym):
                break
        hit = rank == low
        # Of overlapping places (a pair of equal symbols in a run) every second one counts, from the left.
        places = np.flatnonzero(hit)
        run = np.r_[True, np.diff(places) != 1]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
        take = (np.arange(len(places)) - begin) % 2 == 0
        first_of_word = np.r_[True, word[places][1:] != word[places][:-1]]
        take &= v.at_once[rank[places]] | first_of_word
        places = places[take]
        sym[places] = v.made[rank[places]]
        keep = np.ones(len(sym), bool)
        keep[places + 1] = False
        sym, word, place = sym[keep], word[keep], place[keep]
    place, sym, word = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(place, kind="stable")
    return sym[order], np.searchsorted(word[order], np.arange(len(texts) + 1))


class Encoder:
    """Encodes texts, remembering words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.find = regex.compile(_WORD).findall
        self.special = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.shown: list[str] = []
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for content, i in self.v.special.items():
            self._add([content], np.array([i]), np.array([0, 1]))

    def _add(self, names: list[str], ids: np.ndarray, first: np.ndarray) -> None:
        self.code.update(zip(names, range(len(self.shown), len(self.shown) + len(names))))
        tokens = [self.v.tokens[i] for i in ids.tolist()]
        bounds = first.tolist()
        self.shown += [" ".join(tokens[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def words(self, text: str) -> list[str]:
        out, at = [], 0
        for m in self.special.finditer(text) if self.special and "<|" in text else ():
            out += [*self._plain(text[at:m.start()]), m[0]]
            at = m.end()
        return out + self._plain(text[at:]) if at else self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each capital alone, no final form
        return self.find(text.lower())

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids, first, decoded) of the texts; a null text is an empty one."""
        if len(self.code) > KEPT_WORDS:
            self.forget()
        split = [self.words(t) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.code))
        if new:
            self._add(new, *merge_words(self.v, [w.encode() for w in new]))
        n = np.array([len(ws) for ws in split], np.int64)
        listed = list(map(self.code.__getitem__, chain.from_iterable(split)))
        codes = np.array(listed, np.int64)
        each = self.first[codes + 1] - self.first[codes]
        ends = np.cumsum(each)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[codes] - (ends - each), each)
        first = np.r_[0, ends][np.r_[0, np.cumsum(n)]]
        shown, at, decoded = self.shown.__getitem__, 0, []
        for k in n.tolist():
            decoded.append(" ".join(map(shown, listed[at:at + k])))
            at += k
        return self.ids[flat], first, decoded


def decode(v: Vocabulary, ids: list[int] | np.ndarray) -> str:
    """The token strings joined by one space, as the library's ``decode`` gives for a vocabulary without a decoder."""
    return " ".join(v.tokens[i] for i in ids)


def restore(v: Vocabulary, ids: list[int] | np.ndarray) -> str:
    """The normalised text: words separated by one space."""
    byte = {s: b for b, s in enumerate(byte_symbols())}
    text = "".join(v.tokens[i] for i in ids).replace(v.end, " ")
    return bytes(byte.get(c, 32) for c in text).decode("utf-8", "replace").strip()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Every row of ``docs`` (text) with ``ids`` array<int> and ``decoded`` string.

    Encodes whole texts without added special tokens; special tokens written in a text are encoded as
    such.  A null or empty text has no ids and an empty decoded text.  Other columns are kept; columns
    named ``ids`` or ``decoded`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in words.pieces(batches):
            ids, first, decoded = encoder.batch(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([
                *[batch[c] for c in kept],
                pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(decoded, pa.string()),
            ], names=[*kept, "ids", "decoded"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], "ids array<int>, decoded string"])
    return docs.select(*kept).mapInArrow(run, schema)
