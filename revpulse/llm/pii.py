"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans.  Tokens that hold a digit or ``@`` are the nodes of a graph per
document: neighbours are joined by chain edges, and occurrences of the same or a similar token
anywhere in the document by skip edges (each to the next occurrence, so a token repeated n times
has n - 1 edges).  Node potentials come from the shape of a token and its surroundings, edge potentials
from how often labels go together; loopy sum-product message passing over all documents of a piece at once
makes labels consistent.  Tokens under a base span are clamped to it.  Other tokens
whose marginal is at least ``SURE`` add spans, so a number that is written without its
country code the second time is found too.

Weights are fitted on the base spans of at most ``train_docs`` documents with a digit or ``@`` (chosen by a hash of the
id).  Features are yes or no, so Spark counts distinct feature sets and label pairs over the whole texts of these and
only the counts are brought together; everything else covers whole texts of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.llm import words

KINDS = ("email", "ip", "card", "phone")
SURE, ROUNDS, TRAIN_DOCS = 0.9, 12, 20_000

# Fixed patterns.  Possessive parts and the look-behind change no match; they keep long runs linear.
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
_EDGE = "()[]{}<>\"'.,;:!?"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AFTER_AT.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _features(token: str, before: bool, after: bool) -> list[float]:
    digits = sum(c in "0123456789" for c in token)
    plain = "".join(c for c in token if c in "0123456789")
    groups = re.split(r"[^0-9]+", token)
    letters = sum(c.isalpha() for c in token)
    return [
        1, "@" in token, "." in token, token.count(".") == 3, "+" in token, "-" in token, "(" in token, "=" in token,
        letters > 0, letters > digits, digits == 1, 2 <= digits <= 3, 4 <= digits <= 6, 7 <= digits <= 9, 10 <= digits <= 12,
        13 <= digits <= 19, digits > 19, 13 <= digits <= 19 and letters == 0 and _luhn(plain),
        letters == 0 and token.count(".") == 3 and all(g and len(g) <= 3 and int(g) <= 255 for g in groups), before, after,
    ]


_N_FEATURES = len(_features("1", False, False))


def _similar(token: str) -> str:
    """Tokens with equal keys are joined by skip edges: long numbers by their digits, mail by its local part."""
    digits = "".join(c for c in token if c in "0123456789")
    return "#" + digits if len(digits) >= 4 else token.lower().partition("@")[0]


class Graph:
    """Tokens, features and edges of the documents of one piece."""

    def __init__(self, texts: list[str | None]):
        self.doc, self.start, self.end, self.label, features = [], [], [], [], []
        self.base, chain, skip = [], [], []
        for d, text in enumerate(texts):
            spans = base_spans(text) if text else []
            self.base.append(spans)
            if not text or not ("@" in text or _DIGITS.search(text)):
                continue
            first, held, last = len(self.doc), [], {}
            for i, m in enumerate(_TOKEN.finditer(text)):
                token = m[0]
                if "@" in token or _DIGITS.search(token):
                    lead = len(token) - len(token.lstrip(_EDGE))
                    token = token.strip(_EDGE)
                    if token:
                        held.append((i, m.start() + lead, token))
            covered = sorted((s, e, k) for k, s, e in spans)
            nearest = 0
            for j, (i, start, token) in enumerate(held):
                before, after = j > 0 and held[j - 1][0] == i - 1, j + 1 < len(held) and held[j + 1][0] == i + 1
                features.append(_features(token, before, after))
                if before:
                    chain.append((first + j - 1, first + j))
                key = _similar(token)
                if key in last:
                    skip.append((last[key], first + j))
                last[key] = first + j
                while nearest < len(covered) and covered[nearest][1] <= start:
                    nearest += 1
                hit = next((k for s, e, k in covered[nearest:nearest + 4] if s < start + len(token) and e > start), None)
                self.doc.append(d)
                self.start.append(start)
                self.end.append(start + len(token))
                self.label.append(0 if hit is None else hit + 1)
        self.x = np.array(features, dtype=float).reshape(-1, _N_FEATURES)
        self.chain = np.array(chain, dtype=np.int64).reshape(-1, 2)
        self.skip = np.array(skip, dtype=np.int64).reshape(-1, 2)
        self.label = np.array(self.label, dtype=np.int64)


class Model:
    """Node weights and edge potentials; labels are none, then the kinds."""

    def __init__(self):
        n = len(KINDS) + 1
        self.node, self.chain, self.skip = np.zeros((_N_FEATURES, n)), np.zeros((n, n)), np.zeros((n, n))

    def fit(self, x: np.ndarray, y: np.ndarray, times: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300) -> Model:
        """``x`` and ``y`` are distinct (features, label) met so many ``times``; ``chain`` and ``skip`` count label pairs."""
        n = len(KINDS) + 1
        if len(y):
            want, share = np.eye(n)[y], (times / times.sum())[:, None]
            for _ in range(steps):  # piecewise: softmax regression for nodes, association for edges
                z = x @ self.node
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                self.node += 2.0 * (x.T @ ((want - p) * share) - 1e-4 * self.node)
        for name, pairs in (("chain", chain), ("skip", skip)):
            together = pairs + 0.5
            together = together + together.T
            share = together.sum(axis=1) / together.sum()
            setattr(self, name, np.clip(np.log(together / together.sum() / np.outer(share, share)), -3, 3))
        return self

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product in the log domain, all messages of a round at once."""
        n = len(KINDS) + 1
        local = g.x @ self.node
        fixed = g.label > 0
        local[fixed] = -50
        local[fixed, g.label[fixed]] = 50
        edges = np.concatenate([g.chain, g.skip])
        source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        kind = np.r_[np.zeros(len(g.chain), int), np.ones(len(g.skip), int)]
        potential = np.stack([self.chain, self.skip])[np.r_[kind, kind]] if len(edges) else np.zeros((0, n, n))
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        sent = np.zeros((len(source), n))
        belief = local
        for _ in range(rounds if len(edges) else 0):
            z = (belief[source] - sent[back])[:, :, None] + potential
            top = z.max(axis=1, keepdims=True)
            new = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]
            sent = 0.5 * sent + 0.5 * (new - new.max(axis=1, keepdims=True))
            belief = local.copy()
            np.add.at(belief, target, sent)
        p = np.exp(belief - belief.max(axis=1, keepdims=True)) if len(local) else belief
        return p / p.sum(axis=1, keepdims=True) if len(local) else p


def all_spans(g: Graph, model: Model) -> list[list[tuple[int, int, int]]]:
    """Base spans of each document with those that the model adds, by kind and start."""
    out = [list(b) for b in g.base]
    if not len(g.label):
        return out
    p = model.marginals(g)
    best = p.argmax(axis=1)
    added = (best > 0) & (p.max(axis=1) >= SURE) & (g.label == 0)
    joined = set(map(tuple, g.chain.tolist()))
    open_span = None
    for i in np.flatnonzero(added):
        kind = int(best[i]) - 1
        if open_span and open_span[3] == i - 1 and (i - 1, i) in joined and open_span[0] == kind:
            out[g.doc[i]][-1] = (kind, open_span[1], g.end[i])
            open_span = (kind, open_span[1], g.end[i], i)
        else:
            out[g.doc[i]].append((kind, g.start[i], g.end[i]))
            open_span = (kind, g.start[i], g.end[i], i)
    return [sorted(s) for s in out]


def _train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, code, times): feature sets with their label, and label pairs along both kinds of edges."""
    bits = 1 << np.arange(_N_FEATURES, dtype=np.int64)
    for batch in words.pieces(batches):
        g = Graph(batch["text"].to_pylist())
        pair = lambda e: g.label[e[:, 0]] * 8 + g.label[e[:, 1]]  # noqa: B023, E731
        for what, codes in (("node", (g.x.astype(np.int64) @ bits) * 8 + g.label), ("chain", pair(g.chain)), ("skip", pair(g.skip))):
            code, times = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([what] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(times, pa.int64())], names=["what", "code", "times"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fits on the base spans in the whole texts of at most ``train_docs`` documents with a digit or ``@``."""
    able = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    chosen = able.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # a bounded number of ids
    sample = able.join(F.broadcast(chosen.distinct()), "doc_id")
    rows = sample.select("text").mapInArrow(_train_counts, "what string, code long, times long").groupBy("what", "code").agg(F.sum("times").alias("times")).toArrow()
    what, code, times = (rows[c].to_numpy(zero_copy_only=False) for c in ("what", "code", "times"))
    order = np.argsort(code, kind="stable")
    what, code, times = what[order], code[order], times[order].astype(float)
    node = what == "node"
    pairs = {}
    for name in ("chain", "skip"):
        pairs[name] = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        np.add.at(pairs[name], (code[what == name] // 8, code[what == name] % 8), times[what == name])
    x = (code[node, None] // 8 >> np.arange(_N_FEATURES)) & 1
    return Model().fit(x.astype(float), code[node] % 8, times[node], pairs["chain"], pairs["skip"])


_SPANS = "array<struct<kind:string,start:long,stop:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Every span, or union of overlapping spans, becomes ``[KIND]`` of the span that starts first."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, model: Model | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with ``base_spans``, ``spans`` (base and added) and ``redacted`` text.

    Spans are in code points, end exclusive, ordered by kind (email, ip, card, phone) and start.  A null or
    empty text has no spans and stays as it is.  Rows may repeat; other columns are kept, but those
    with the three new names are replaced.
    """
    model = model or train(docs, train_docs)
    kept = [c for c in docs.columns if c not in ("base_spans", "spans", "redacted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            texts = batch["text"].to_pylist()
            g = Graph(texts)
            spans = all_spans(g, model)
            tell = lambda found: pa.array([[{"kind": KINDS[k], "start": int(s), "stop": int(e)} for k, s, e in sorted(f)] for f in found], _SPAN_TYPE)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in kept], tell(g.base), tell(spans), pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string())],
                names=[*kept, "base_spans", "spans", "redacted"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], f"base_spans {_SPANS}, spans {_SPANS}, redacted string"])
    return docs.select(*kept).mapInArrow(run, schema)
