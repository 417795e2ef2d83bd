"""A quality classifier by co-training on two views of a document.

The text view is the hashed byte trigrams of the whole text.  The metadata view is what a page tells about
itself: language, source, stated length, and the layout (lines, word lengths, shares of character
classes, repeated lines and words).  Each round both logistic models are fitted, and each passes the unlabelled
documents it is surest of to the other's training set.  Both are then calibrated on labelled documents held
back from training, and their log-odds are added (less the prior, which both contain).

Fitting takes at most ``labelled`` labelled documents, chosen by a hash of the id, and runs in one task a view.  The exchange
is among all others: every round scores them all in Spark and adds the ``per_round`` surest of each view to the other's rows;
only their keys, and the weights, reach the driver.  Documents that neither view can tell apart count as one.  Scoring covers whole texts of all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revpulse.llm import words
from revpulse.llm.components import cut

LABELLED = 8_000
ROUNDS, PER_ROUND, CONFIDENT = 4, 300, 0.95
DIM = 1 << 11
THRESHOLD = 0.2  # below one half: a clean document lost costs more than a poor one kept
_LANGS, _SOURCES = 16, 32
_PAIRS = (("text", "meta"), ("meta", "text"))  # who teaches whom
META = _LANGS + _SOURCES + 14

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower and beyond ASCII, 3 digit, 4 space
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[[32, *range(9, 14)]] = 4


def text_view(texts: words.Texts) -> np.ndarray:
    """(texts, DIM) shares of hashed byte trigrams, square roots taken, rows of length 1."""
    n, data = len(texts), texts.data
    out = np.zeros((n, DIM), np.float32)
    if len(data) < 3:
        return out
    code = data[:-2].astype(np.uint64) << np.uint64(16) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:]
    bucket = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 11)).astype(np.int64)
    for i in range(n):
        a, b = texts.at[i], texts.at[i + 1] - 2
        if b > a:
            out[i] = np.sqrt(np.bincount(bucket[a:b], minlength=DIM) / (b - a))
    return out


def _hashed(value, size: int) -> int:
    return zlib.crc32(str(value).encode("utf-8", "replace")) % size


def meta_view(batch: pa.RecordBatch, texts: words.Texts) -> np.ndarray:
    n = len(texts)
    names = batch.schema.names
    column = lambda name: batch[name].to_pylist() if name in names else [None] * n
    out = np.zeros((n, META), np.float32)
    for i, (lang, source, stated) in enumerate(zip(column("lang"), column("source"), column("n_chars"))):
        raw = texts.data[texts.at[i]:texts.at[i + 1]]
        size = max(len(raw), 1)
        shares = np.bincount(_CLASS[raw], minlength=5) / size
        lines = raw.tobytes().split(b"\n")
        said = raw.tobytes().split()
        n_words, again = max(len(said), 1), sum(map(eq, said, said[1:]))
        out[i, _hashed(lang, _LANGS)] = 1
        out[i, _LANGS + _hashed(source, _SOURCES)] = 1
        out[i, _LANGS + _SOURCES:] = [
            1, np.log1p(abs(stated or 0)), np.log1p(size), np.log1p(len(lines)), np.log1p(size / len(lines)),
            len(set(lines)) / len(lines), size / n_words, again / n_words, np.log1p(n_words), *shares,
        ]
    return out


class Logistic:
    """Ridge logistic regression on standardised columns, by accelerated gradient steps.  The columns are never copied:
    means and scales are applied to the weights and gradients."""

    def __init__(self, ridge: float, steps: int = 200):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean = x.mean(axis=0, dtype=float)
        self.std = np.sqrt(sum(np.square(x[i:i + 500] - self.mean).sum(axis=0) for i in range(0, len(x), 500)) / len(x))
        self.std[self.std < 1e-6] = np.inf  # a column that never varies says nothing
        spread = self.mean / self.std
        step = 4.0 / (np.isfinite(self.std).sum() + 1)  # standardised rows have this mean square length
        self.w, self.b = np.zeros(x.shape[1]), 0.0
        ahead, before = self.w, self.w
        for t in range(self.steps):
            z = x @ (ahead / self.std).astype(np.float32) - float(spread @ ahead) + self.b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32)
            slope = (error @ x) / self.std - float(error.sum()) * spread
            self.w = ahead - step * (slope / len(y) + self.ridge * ahead)
            self.b -= float(error.mean())
            ahead, before = self.w + t / (t + 3) * (self.w - before), self.w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        w = self.w / self.std
        return x @ w.astype(np.float32) + (self.b - float(self.mean @ w))


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset from score to log-odds, with Platt's smoothed targets."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = score.std() + 1e-9
    a, b, s = 1.0, 0.0, score / scale
    for _ in range(2000):
        error = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))) - target
        a, b = a - 0.5 * float((error * s).mean()), b - 0.5 * float(error.mean())
    return a / scale, b


class Model:
    """Both fitted views, their calibration and the prior."""

    def __init__(self, views: dict[str, Logistic], platt: dict[str, tuple[float, float]], prior: float):
        self.views, self.platt, self.prior = views, platt, prior

    def log_odds(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (self.platt[v][0] * self.views[v].score(x) + self.platt[v][1] for v, x in (("text", text), ("meta", meta)))
        return a, b, a + b - self.prior


_KEPT = "key long, id long, y int, held boolean, text binary, meta binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.pieces(batches):
        texts = words.texts_of(batch["text"])
        text, meta = text_view(texts), meta_view(batch, texts)
        yield pa.RecordBatch.from_arrays([
            batch["__key"], batch["__id"], batch["__y"], batch["__held"], pa.array([r.astype(np.float16).tobytes() for r in text], pa.binary()),
            pa.array([r.tobytes() for r in meta], pa.binary())], names=["key", "id", "y", "held", "text", "meta"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One view from its training rows (view, id, key, y, held, x): weights, and slope and offset by the rows held back."""
    held: dict[str, list] = {}
    for batch in batches:
        views = np.array(batch["view"].to_pylist(), object)
        for view in dict.fromkeys(views):
            part = batch.filter(pa.array(views == view))
            kind = np.float16 if view == "text" else np.float32
            x = part["x"].cast(pa.large_binary())
            at = np.frombuffer(x.buffers()[1], np.int64, len(x) + 1, x.offset * 8)
            flat = np.frombuffer(x.buffers()[2], np.uint8)[at[0]:at[-1]].view(kind)  # all vectors have one length
            held.setdefault(view, []).append((part["y"].to_numpy(), part["held"].to_numpy(zero_copy_only=False), flat.reshape(len(x), -1).copy()))
        del batch
    for view in list(held):
        parts = held.pop(view)
        y, back = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        place = np.empty(len(y), np.int64)
        place[np.argsort(back, kind="stable")] = np.arange(len(y))  # training rows first, so that none is copied
        x, done = np.empty((len(y), parts[0][2].shape[1]), np.float32), 0
        while parts:
            _, _, part = parts.pop(0)
            x[place[done:done + len(part)]] = part
            done += len(part)
        y, n = y[np.argsort(place)].astype(float), int((~back).sum())
        fitted = Logistic(1e-3).fit(x[:n], y[:n])
        slope, offset = _platt(fitted.score(x[n:]).astype(float), y[n:])
        yield pa.RecordBatch.from_arrays(
            [pa.array([view]), *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in (fitted.w, fitted.mean, fitted.std)], *[pa.array([float(v)]) for v in (fitted.b, slope, offset)]],
            names=["view", "w", "mean", "std", "b", "slope", "offset"])


def _views(rows: DataFrame, taught: DataFrame | None) -> tuple[dict[str, Logistic], dict[str, tuple[float, float]]]:
    """Fits each view in a task of its own.  ``rows`` are labelled, ``taught`` has what one view tells the other."""
    sets = []
    for view in ("text", "meta"):
        columns = [F.lit(view).alias("view"), "id", "key", "y", "held", F.col(view).alias("x")]
        sets.append(rows.select(*columns))
        if taught is not None:
            sets.append(taught.where(F.col("for") == view).select(*columns))
    one = sets[0]
    for more in sets[1:]:
        one = one.union(more)
    got = one.repartition(2, "view").sortWithinPartitions("view", "id", "key", "y").mapInArrow(
        _fit, "view string, w array<double>, mean array<double>, std array<double>, b double, slope double, offset double").collect()
    views, platt = {}, {}
    for r in got:
        views[r["view"]] = v = Logistic(1e-3)
        v.w, v.mean, v.std, v.b = np.array(r["w"]), np.array(r["mean"]), np.array(r["std"]), r["b"]
        platt[r["view"]] = (r["slope"], r["offset"])
    return views, platt


class _Surest:
    """The surest keys of one task, the most sure first; of equal ones the smaller key."""

    def __init__(self, most: int):
        self.most, self.sure, self.key = most, np.zeros(0), np.zeros(0, np.int64)

    def add(self, sure: np.ndarray, key: np.ndarray) -> None:
        sure, key = np.r_[self.sure, sure], np.r_[self.key, key]
        order = np.lexsort((key, -sure))
        first = np.sort(np.unique(key[order], return_index=True)[1])[:self.most]
        self.sure, self.key = sure[order][first], key[order][first]


def _surest(base: DataFrame, known: np.ndarray, views: dict, given: dict, most: list[int]) -> list[tuple[int, int, int]]:
    """(pair of views, label, key) of the unlabelled documents that the first view of a pair is surest of and that are not yet
    ``given`` to the second, ``most`` of a label.  ``base`` has __key, __id, text and metadata; rows with an id in ``known`` are labelled."""
    shared = base.sparkSession.sparkContext.broadcast((views, known, given, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, known, given, most = shared.value
        best = {(pair, label): _Surest(most[label]) for pair in range(2) for label in range(2)}
        for batch in words.pieces(batches):
            texts = words.texts_of(batch["text"])
            key, ids = batch["__key"].to_numpy(), batch["__id"]
            free = ~(np.isin(pc.fill_null(ids, 0).to_numpy(), known) & pc.is_valid(ids).to_numpy(zero_copy_only=False))
            x = {"text": text_view(texts).astype(np.float16).astype(np.float32), "meta": meta_view(batch, texts)}
            for pair, (view, other) in enumerate(_PAIRS):
                odds = np.round(views[view].score(x[view]).astype(float), 3)  # how rows are batched moves only later digits
                fresh = free & ~np.isin(key, given[other])
                for label, sure in ((1, odds), (0, -odds)):
                    chosen = fresh & (sure >= np.log(CONFIDENT / (1 - CONFIDENT)))
                    if chosen.any():
                        best[pair, label].add(sure[chosen], key[chosen])
        for (pair, label), b in best.items():
            n = len(b.key)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pair, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(b.key), pa.array(b.sure)],
                                             names=["pair", "label", "__key", "sure"])

    met = base.mapInArrow(run, "pair int, label int, __key long, sure double").groupBy("pair", "label", "__key").agg(F.max("sure").alias("sure"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("pair", "label", *by).orderBy(F.desc("sure"), "__key"))
    spread = met.withColumn("share", F.pmod(F.xxhash64("__key"), F.lit(8)))  # 32 groups first, so the four meet at most eight times as many as they keep
    best = spread.withColumn("rank", rank("share")).where(F.col("rank") <= max(most)).drop("rank", "share")
    ranked = best.withColumn("rank", rank()).where(F.col("rank") <= max(most))  # a constant: each task passes on no more than that
    top = ranked.where(F.col("rank") <= F.when(F.col("label") == 1, most[1]).otherwise(most[0])).collect()
    shared.unpersist()
    return [(r["pair"], r["label"], r["__key"]) for r in top]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model | None:
    """The fitted model, or None if the labels found do not hold both classes at least four times.  Each view is fitted ``rounds`` times, and between two fits passes
    at most ``per_round`` documents to the other.  The features stay in Spark; the driver sees ids, labels and weights.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    known = known.select(F.col("doc_id").cast("long").alias("__id"), (F.col("q") >= 0.5).cast("int").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    nth = F.row_number().over(Window.partitionBy("__y").orderBy(F.xxhash64("__id", F.lit(1)), "__id"))  # of a bounded number of ids
    known = known.withColumn("__held", nth % 4 == 2)  # a quarter of each class calibrates
    view = [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    base = docs.select(F.xxhash64("text", *view).alias("__key"), F.col("doc_id").cast("long").alias("__id"), "text", *view)
    rows = cut(base.join(F.broadcast(known), "__id").mapInArrow(_features, _KEPT))  # at most labelled ids
    told = rows.select("id", "y", "held").toArrow()
    ids, y, held = (told[c].to_numpy() for c in told.column_names)
    if min((y == c).sum() for c in (0, 1)) < 4 or min((y[held == h] == c).sum() for h in (False, True) for c in (0, 1)) < 1:
        return None
    share = float(y[~held].mean())
    most = [round(per_round * (1 - share)), round(per_round * share)]  # by label
    given = {v: np.zeros(0, np.int64) for v in ("text", "meta")}
    taught = None
    for turn in range(rounds):
        views, platt = _views(rows, taught)
        if turn == rounds - 1:
            break
        top = _surest(base, np.unique(ids), views, given, most)
        passed = [(key, _PAIRS[pair][1], label) for pair, label, key in top]
        for _, other in _PAIRS:
            given[other] = np.r_[given[other], np.array([k for k, to, _ in passed if to == other], np.int64)]
        wanted = spark.createDataFrame(passed, "__key long, for string, label int")
        once = base.join(F.broadcast(wanted.select("__key").distinct()), "__key", "left_semi").dropDuplicates(["__key"]).withColumns({"__y": F.lit(-1), "__held": F.lit(False)})
        new = once.mapInArrow(_features, _KEPT).join(F.broadcast(wanted), F.col("key") == F.col("__key")).select(
            "key", F.lit(None).cast("long").alias("id"), F.col("label").alias("y"), "held", "text", "meta", "for")
        taught = cut(new if taught is None else taught.union(new))
    return Model(views, platt, float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, threshold: float = THRESHOLD, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> DataFrame:
    """Every row of ``docs`` with ``text_score`` and ``meta_score`` (calibrated probability of good quality by one
    view), ``quality_score`` (both) and ``good`` (quality_score >= threshold).

    ``docs`` needs doc_id and text; lang, source and n_chars are used if there.  Null and empty texts
    are scored like any other.  Columns with the four new names are replaced.  Labels other than 0 and 1 are
    ignored, repeated ones averaged.  Without enough labels of both classes the scores are null and
    every document counts as good.
    """
    model = train(docs, labels, labelled, rounds, per_round)
    new = ("text_score", "meta_score", "quality_score", "good")
    kept = docs.select(*[c for c in docs.columns if c not in new])
    if model is None:
        return kept.select("*", *[F.lit(None).cast("double").alias(c) for c in new[:3]], F.lit(True).alias("good"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            texts = words.texts_of(batch["text"])
            odds = shared.value.log_odds(text_view(texts), meta_view(batch, texts))
            p = [1 / (1 + np.exp(-np.clip(o, -30, 30).astype(float))) for o in odds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, p), pa.array(p[2] >= threshold)], names=[*batch.schema.names, *new])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], "text_score double, meta_score double, quality_score double, good boolean"])
    return kept.mapInArrow(run, schema)
