"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words enter through a weighted lexicon, an automaton over bytes: closed classes (targets, negators, reporting words,
intentions, violent verbs) are fixed lists in four languages, stems of insults are learned from labelled rows.  Four
transducers then read the classes of a clause, each rewriting what the one before put out:

* threat: an intention followed by a violent verb is a threat; a violent verb alone is nothing;
* negation: an insult or threat after a negator is a denied one, if each marked word on the way is within ``SCOPE`` words of the
  one before;
* reported speech: after a reporting word or a quotation mark it is a told one;
* target: weighs what is left and raises the clause if somebody is addressed in it.

``compose`` multiplies them into one machine.  A clause scores the sum of its lexical weights times the weights of the arcs
they pass, times the weight of the state it ends in; isolated words score nothing by themselves.  A logistic model on a
document's clause scores and length gives its score.  The machine runs over all clauses of a piece at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revpulse.llm.components import cut
from revpulse.llm.words import ALNUM, LOWER, Texts, Words, combine, mix, pieces, texts_of, words_of

# The closed word classes.  "*" stands for any ending.
CLASSES = {
    "target": "you your yours yourself u he she they them him her people everyone du dich dir dein* ihr euch sie tu toi te vous ton ta tes "
              "votre vos il elle ils elles tú ti usted* vosotros ellos ellas él ella",
    "negator": "not no never nobody none isn't aren't wasn't don't doesn't didn't won't can't cannot nicht kein* nie niemals ne pas jamais "
               "aucun* nunca jamás ningún* tampoco",
    "reporter": "said says say saying told tells called calls calling wrote writes quoted quote* claims claimed sagte sagt schrieb nannte nennt "
                "dit disait disent écrit appelé dijo dice dicen escribió llamó",
    "intention": "will shall gonna going should must i'll we'll werde* wird wirst vais va vas allons voy vamos",
    "violent": "kill* hurt* beat* destroy* murder* shoot* stab* burn* strangle* töte* umbring* schlage* tuer tue frapper détruire matar* "
               "golpear* destruir*",
}
SCOPE = 3  # words to the next marked one; beyond, a negator or an intention reaches no further
CLAUSE_WORDS = 64  # a longer stretch without punctuation is several clauses
VIOLENCE = 6.0  # lexical weight of a violent verb
ARCS = {"insult": 1.0, "threat": 1.5, "denied": 0.5, "told": 0.6}
ADDRESSED = 1.25

LABELLED = 8_000  # labelled rows that the fit reads
SUPPORT, PURITY = 6, 10.0  # a stem is met in so many contexts of toxic rows, and so many times as densely as in others
STEM = (3, 12)  # characters

_WORD = ALNUM.copy()
_WORD[39] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?;:\n"]] = True
#: Symbols of the grammar; 0 is any other word and never shown to it.
SYMBOLS = ["other", "insult", "violent", "target", "negator", "reporter", "intention", "quote", "gap"]
_OF = {name: i for i, name in enumerate(SYMBOLS)}


@dataclass
class Transducer:
    """Sequential: ``arcs[state, read] = (next state, written, weight)``.  What is not listed is copied and leaves the state."""

    arcs: dict = field(default_factory=dict)
    final: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, read):
        return self.arcs.get((state, read), (state, read, 1.0))


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The machine that reads as ``first`` and writes what ``second`` makes of its output; weights multiply."""
    start = (first.start, second.start)
    out, todo, known = Transducer(start=start), [start], {start}
    while todo:
        state = todo.pop()
        p, q = state
        out.final[state] = first.final.get(p, 1.0) * second.final.get(q, 1.0)
        for read in symbols:
            p2, middle, w1 = first.step(p, read)
            q2, written, w2 = second.step(q, middle)
            out.arcs[state, read] = ((p2, q2), written, w1 * w2)
            if (p2, q2) not in known:
                known.add((p2, q2))
                todo.append((p2, q2))
    return out


def _threats() -> Transducer:
    return Transducer({(0, "intention"): (1, "other", 1.0), (1, "intention"): (1, "other", 1.0), (1, "gap"): (0, "gap", 1.0),
                       (0, "violent"): (0, "other", 1.0), (1, "violent"): (0, "threat", 1.0)})


def _negation() -> Transducer:
    arcs = {(s, "negator"): (1, "other", 1.0) for s in (0, 1)} | {(1, "gap"): (0, "other", 1.0), (0, "gap"): (0, "other", 1.0)}
    return Transducer(arcs | {(1, x): (1, f"denied {x}", 1.0) for x in ("insult", "threat")})


def _reported() -> Transducer:
    arcs = {(0, x): (1, "other", 1.0) for x in ("reporter", "quote")} | {(1, "reporter"): (1, "other", 1.0), (1, "quote"): (0, "other", 1.0)}
    return Transducer(arcs | {(1, x): (1, f"told {x}", 1.0) for x in ("insult", "threat", "denied insult", "denied threat")})


def _targets() -> Transducer:
    weigh = {" ".join([*how, what]): np.prod([ARCS[w] for w in [*how, what]]) for what in ("insult", "threat") for how in ((), ("denied",), ("told",), ("told", "denied"))}
    arcs = {(s, "target"): (1, "other", 0.0) for s in (0, 1)} | {(s, x): (s, x, float(w)) for x, w in weigh.items() for s in (0, 1)}
    return Transducer(arcs | {(s, x): (s, x, 0.0) for x in (*SYMBOLS[:1], "quote", "gap") for s in (0, 1)}, {0: 1.0, 1: ADDRESSED})


class Grammar:
    """The composed machine as tables over (state, symbol)."""

    def __init__(self):
        whole = _threats()
        for part in (_negation(), _reported(), _targets()):
            whole = compose(whole, part, SYMBOLS)
        number = {s: i for i, s in enumerate(whole.final)}
        self.start = number[whole.start]
        self.next = np.array([[number[whole.arcs[s, x][0]] for x in SYMBOLS] for s in number])
        self.weight = np.array([[whole.arcs[s, x][2] for x in SYMBOLS] for s in number])
        self.final = np.array([whole.final[s] for s in number])

    def run(self, symbol: np.ndarray, lexical: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of every sequence i = symbol[first[i]:first[i + 1]]; all sequences advance together."""
        size = np.diff(first)
        state, score = np.full(len(size), self.start), np.zeros(len(size))
        live, at = np.flatnonzero(size > 0), 0
        while len(live):
            place = first[live] + at
            read = symbol[place]
            score[live] += self.weight[state[live], read] * lexical[place]
            state[live] = self.next[state[live], read]
            at += 1
            live = live[size[live] > at]
        return score * self.final[state]


class Lexicon:
    """Weighted automaton over bytes; the longest stem that a word begins with, or the whole word, gives its symbol and weight."""

    def __init__(self, stems: dict[str, float]):
        entries = [(w.rstrip("*$"), name, VIOLENCE if name == "violent" else 0.0, not w.endswith("*")) for name, words in CLASSES.items() for w in words.split()]
        entries += [(s.rstrip("$"), "insult", w, s.endswith("$")) for s, w in stems.items()]
        used = sorted({b for word, *_ in entries for b in word.encode()})
        self.code = np.zeros(256, np.int32)  # 0: no arc
        self.code[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        arcs, marks = [[0] * width, [0] * width], [{}, {}]  # state 0 is dead, 1 the start
        for word, name, weight, whole in entries:
            at = 1
            for b in word.encode():
                c = self.code[b]
                if not arcs[at][c]:
                    arcs.append([0] * width)
                    marks.append({})
                    arcs[at][c] = len(arcs) - 1
                at = arcs[at][c]
            marks[at].setdefault(whole, (_OF[name], weight))
        self.next = np.array(arcs, np.int32)
        self.begins, self.ends = (np.array([m.get(whole, (0, 0.0)) for m in marks]) for whole in (False, True))

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, weight) of every word."""
        symbol, weight = np.zeros(len(words.start), np.int64), np.zeros(len(words.start))
        live = np.arange(len(words.start))
        state, at = np.ones(len(live), np.int32), words.start.copy()
        while len(live):
            state = self.next[state, self.code[words.data[at]]]
            on = state > 0
            live, state, at = live[on], state[on], at[on] + 1
            last = at == words.end[live]
            for marks, of in ((self.begins, np.ones(len(live), bool)), (self.ends, last)):
                hit = of & (marks[state, 0] > 0)
                symbol[live[hit]], weight[live[hit]] = marks[state[hit], 0], marks[state[hit], 1]
            live, state, at = live[~last], state[~last], at[~last]
        return symbol, weight


def lowered(texts: Texts) -> Texts:
    """A-Z and the capitals from À to Þ in lower case; every byte keeps its place."""
    data = LOWER[texts.data]
    if len(data) > 1:
        after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[after] += 0x20
    return Texts(data, texts.at)


def clauses(texts: Texts, words: Words) -> np.ndarray:
    """Number of every word's clause, rising over the piece."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(_ENDS[texts.data])])[words.start]
    new = np.ones(len(ends), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (words.doc[1:] != words.doc[:-1])
    opened = np.flatnonzero(new)
    place = np.arange(len(ends)) - np.repeat(opened, np.diff([*opened, len(ends)]))
    return np.cumsum(new | (place % CLAUSE_WORDS == 0)) - 1


@dataclass
class Matches:
    """Clauses with an insult or a threat: text, bytes from first to last word, score; and words of every text."""

    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    score: np.ndarray
    n_words: np.ndarray


def match(texts: Texts, lexicon: Lexicon, grammar: Grammar) -> Matches:
    texts = lowered(texts)
    words = words_of(texts, _WORD, False)
    symbol, lexical = lexicon.read(words)
    clause = clauses(texts, words)
    if not len(clause):
        none = np.zeros(0, np.int64)
        return Matches(none, none, none, np.zeros(0), words.counts())
    opens = np.flatnonzero(np.diff(clause, prepend=-1))
    hot = np.zeros(len(opens), bool)
    hot[clause[(symbol == _OF["insult"]) | (symbol == _OF["violent"])]] = True
    # What the grammar reads of these clauses: marked words, quotation marks, and a gap where a negator's reach ends.
    w = np.flatnonzero((symbol > 0) & hot[clause])
    quotes = np.flatnonzero(texts.data == 34)
    quotes = np.stack([np.searchsorted(words.start, quotes), quotes])
    quotes = quotes[:, (quotes[0] > 0) & (quotes[0] < len(words.start))]
    quotes = quotes[:, hot[clause[np.minimum(quotes[0], len(clause) - 1)]] & (words.doc[quotes[0]] == np.searchsorted(texts.at, quotes[1], side="right") - 1)] if quotes.size else quotes
    far = w[1:][(clause[w[1:]] == clause[w[:-1]]) & (np.diff(w) > SCOPE)]
    at = np.concatenate([w, quotes[0], far])
    kind = np.concatenate([np.full(len(w), 2), np.full(quotes.shape[1], 1), np.zeros(len(far), np.int64)])
    reads = np.concatenate([symbol[w], np.full(quotes.shape[1], _OF["quote"]), np.full(len(far), _OF["gap"])])
    weigh = np.concatenate([lexical[w], np.zeros(quotes.shape[1] + len(far))])
    order = np.lexsort((kind, at))
    which = np.flatnonzero(hot)
    first = np.searchsorted(clause[at[order]], np.append(which, len(opens)))
    score = grammar.run(reads[order], weigh[order], first)
    which, score = which[score > 0], score[score > 0]
    last = np.append(opens[1:], len(clause))[which] - 1
    return Matches(words.doc[opens[which]], words.start[opens[which]], words.end[last], score, words.counts())


def features(found: Matches) -> np.ndarray:
    n = len(found.n_words)
    total = np.bincount(found.doc, found.score, n)
    best = np.zeros(n)
    np.maximum.at(best, found.doc, found.score)
    return np.stack([np.log1p(total), np.log1p(np.bincount(found.doc, minlength=n)), best, np.log1p(found.n_words), total / np.sqrt(found.n_words + 10)], axis=1)


@dataclass
class Model:
    """Learned stems, and the logistic layer on top of the clause scores."""

    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.5, 0.0, 0.0, 0.0, 0.0]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        """Newton steps.  With one class only the default weights stay."""
        if not 0 < y.sum() < len(y):
            return
        x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
        keep[0, 0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, pair, toxic): words of 2 to 40 bytes with a hash of the word and the one before, each pair once a piece."""
    for batch in pieces(batches):
        texts = lowered(texts_of(batch["text"]))
        words = words_of(texts, _WORD, False)
        h = words.hashes()
        before = np.roll(h, 1)
        before[words.first[:-1][words.counts() > 0]] = 0
        pair = mix(combine(before, h))
        toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)[words.doc]
        size = words.end - words.start
        fit = np.flatnonzero((size > 1) & (size <= 40))
        _, one = np.unique(pair[fit] ^ toxic[fit].astype(np.uint64), return_index=True)
        one = fit[one]
        data = words.data.tobytes()
        yield pa.RecordBatch.from_arrays([
            pa.array([data[a:b] for a, b in zip(words.start[one].tolist(), words.end[one].tolist())], pa.binary()).cast(pa.string()),
            pa.array(pair[one].view(np.int64)), pa.array(toxic[one], pa.int64())], names=["word", "pair", "toxic"])


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems of insults with their log-odds from ``sample`` (text, toxic).

    A prefix counts the distinct (word before, word) pairs it is met in, so copies of a text add nothing.  Kept are
    prefixes met in ``SUPPORT`` pairs of toxic texts and ``PURITY`` times as densely as in the others.  Of a chain of
    such prefixes the stem is the first that no single continuation explains (nine tenths of it, or half if twice as dense), or the whole word.
    """
    pairs = sample.mapInArrow(_contexts, "word string, pair long, toxic long")
    both = [F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")]
    words = cut(pairs.groupBy("word", "pair").agg(F.max("toxic").alias("toxic")).groupBy("word").agg(*both))
    total = words.agg(F.sum("t"), F.sum("c")).first()
    toxic, other = total[0] or 0, total[1] or 0
    ended = F.concat("word", F.lit("$"))
    cuts = F.sequence(F.least(F.length(ended), F.lit(STEM[0])), F.least(F.length(ended), F.lit(STEM[1])))
    prefixes = words.select(F.explode(F.transform(cuts, lambda n: ended.substr(F.lit(1), n))).alias("stem"), "t", "c").groupBy("stem").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"))
    dense = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 2) / (other + 1))
    rows = prefixes.where((F.col("t") >= SUPPORT) & (dense >= PURITY)).select("stem", "t", F.log(dense).alias("w")).collect()  # bounded by the sample
    pure = {r["stem"]: r for r in rows}
    most: dict[str, tuple] = {}  # the strongest continuation of each prefix
    for r in rows:
        most[r["stem"][:-1]] = max(most.get(r["stem"][:-1], (0, "")), (r["t"], r["stem"]))
    out: dict[str, float] = {}
    for stem in sorted(pure, key=lambda s: (len(s), s)):
        if any(stem[:n] in out for n in range(1, len(stem))):
            continue
        t, more = most.get(stem, (0, ""))
        share = t / pure[stem]["t"]
        purer = share >= 0.5 and pure[more]["w"] > pure[stem]["w"] + 0.7
        if (share >= 0.9 or purer) and not more.endswith("$"):
            continue
        out[stem] = float(pure[stem]["w"])
    return out


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, grammar = Lexicon(model.stems), Grammar()
        for batch in pieces(batches):
            x = features(match(texts_of(batch["text"]), lexicon, grammar))
            yield pa.RecordBatch.from_arrays([batch["toxic"], *[pa.array(c) for c in x.T]], names=["toxic", *"abcde"])
    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, labelled: int = LABELLED) -> Model:
    """Fits on at most ``labelled`` labelled ids (those with the smallest hash) for which ``usable`` holds.

    An id labelled more than once is toxic if any label says so; ids and labels that are null take no part.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = (known if usable is None else known.where(usable)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)  # a bounded number of ids
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("__toxic") > 0).cast("int").alias("toxic")))
    model = Model(learn_stems(sample))
    rows = sample.mapInArrow(_measure(model), "toxic int, a double, b double, c double, d double, e double").collect()  # six numbers a labelled row
    if rows:
        table = np.array([tuple(r) for r in rows], float)
        model.fit(table[:, 1:], table[:, 0])
    return model


def apply(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1), ``predicted`` and ``clauses`` (start, stop in code points, weight)."""
    names = list(docs.columns)
    taken = [c for c in ("score", "predicted", "clauses") if c in names]
    if taken:
        raise ValueError(f"columns {taken} are in the way")
    text = next(n for n in names if n.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, grammar = Lexicon(model.stems), Grammar()
        for batch in pieces(batches, text):
            texts = texts_of(batch[text])
            found = match(texts, lexicon, grammar)
            score = model.probability(features(found))
            points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
            base = points[texts.at[found.doc]]
            spans = pa.StructArray.from_arrays(
                [pa.array(points[found.start] - base, pa.int64()), pa.array(points[found.stop] - base, pa.int64()), pa.array(found.score)], ["start", "stop", "weight"])
            at = np.searchsorted(found.doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), spans)],
                names=[*names, "score", "predicted", "clauses"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "score double", "predicted int", "clauses array<struct<start:bigint,stop:bigint,weight:double>>"])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def find_toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses) for every row of ``docs``.

    Only labels of rows that are not held out are read, and only texts enter the score.  Null and empty texts have no
    clause and get the score of an empty text; a row with a null id is scored and not held out; repeated rows are scored
    alike; other columns are ignored.  Without labels of both classes threats alone count, with default weights.
    """
    model = train(docs, labels, ~held_out(F.col("doc_id")), labelled)
    return apply(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, threshold).drop("text")
