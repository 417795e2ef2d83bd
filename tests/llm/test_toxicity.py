"""The pattern grammar against a plain reading of clauses, stems against plain counts, and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import frame  # noqa: F401
from revpulse.llm import toxicity
from revpulse.llm.words import texts_of

STEMS = {"idiot": 4.0, "lowei": 6.0, "scum$": 3.0, "idiotic": 1.0}
WORDS = ["You", "idiot", "idiots", "idiotically", "SCUM", "scummy", "loweient", "not", "never", "said", "will", "kill", "kills", "hurt", "they", "the", "of", "and", "Éa", "pas", "du", "kein", "keine", '"', "gonna", "x", "'", "日本"]


def plain(text, stems):
    """[(start, stop, score)] in code points, straight from the definition."""
    classes = [(w, name, toxicity.VIOLENCE if name == "violent" else 0.0) for name, words in toxicity.CLASSES.items() for w in words.split()]
    classes += [(s if s.endswith("$") else s + "*", "insult", w) for s, w in stems.items()]

    def look(word):
        best = (-1, None, 0.0)
        for entry, name, weight in classes:
            stem = entry.rstrip("*$")
            if entry.endswith("*") and word.startswith(stem) or word == stem:
                best = max(best, (len(stem), name, weight), key=lambda b: b[0])
        return best[1], best[2]

    found, clause, last = [], [], None
    low = "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text)
    pieces = list(re.finditer(r"[0-9a-z'\u0080-\U0010ffff]+|[.!?;:\n]|\"", low)) + [None]
    n = 0

    def close():
        nonlocal clause, n
        words = [c for c in clause if c[0] != '"']
        total = will = told = 0
        reach = None
        addressed = False
        for word, at, k in clause:
            if word == '"':
                told = not told
                continue
            name, weight = look(word)
            if name and last_marked(clause, k) is not None and k - last_marked(clause, k) > toxicity.SCOPE:
                will = 0
            if name == "negator":
                reach = k
            elif name == "reporter":
                told = True
            elif name == "target":
                addressed = True
            elif name == "intention":
                will = 1
            elif name == "insult" or name == "violent" and will:
                factor = toxicity.ARCS["insult" if name == "insult" else "threat"]
                factor *= toxicity.ARCS["denied"] if reach is not None and near(clause, reach, k) else 1
                factor *= toxicity.ARCS["told"] if told else 1
                total += weight * factor
                will = 0 if name == "violent" else will
            elif name == "violent":
                will = 0
        if total > 0:
            found.append((words[0][1].start(), words[-1][1].end(), total * (toxicity.ADDRESSED if addressed else 1)))
        clause, n = [], 0

    def marks(c):
        return [k for w, _, k in c if w != '"' and look(w)[0]]

    def last_marked(c, k):
        return max((m for m in marks(c) if m < k), default=None)

    def near(c, a, b):
        chain = [m for m in marks(c) if a <= m <= b]
        return all(y - x <= toxicity.SCOPE for x, y in zip(chain, chain[1:]))

    for p in pieces:
        if p is None or p.group() in ".!?;:\n" and len(p.group()) == 1:
            close()
        elif p.group() == '"':
            if clause:
                clause.append(('"', p, n))
        else:
            if n == toxicity.CLAUSE_WORDS:
                close()
            n += 1
            clause.append((p.group(), p, n))
    return found


def spans(texts):
    lexicon, grammar = toxicity.Lexicon(STEMS), toxicity.Grammar()
    arrow = texts_of(pa.array(texts, pa.string()))
    found = toxicity.match(arrow, lexicon, grammar)
    points = np.concatenate([[0], np.cumsum((arrow.data & 0xC0) != 0x80)])
    out = [[] for _ in texts]
    for d, a, b, s in zip(found.doc, found.start, found.stop, found.score):
        out[d].append((points[a] - points[arrow.at[d]], points[b] - points[arrow.at[d]], round(float(s), 9)))
    assert list(found.n_words) == [len(re.findall(r"[0-9A-Za-z'\u0080-\U0010ffff]+", t or "")) for t in texts]
    return out


def test_grammar_against_plain_reading():
    rng = random.Random(3)
    texts = [None, "", "...", "idiot", "You idiot", "you are not an idiot", "He said you are an idiot", "I will kill you", "I kill you", "never will I kill them. Scum!"]
    for _ in range(400):
        texts.append(" ".join(rng.choice(WORDS) + rng.choice(["", "", "", "", ".", "\n"]) for _ in range(rng.randrange(1, 40))))
    texts += [" ".join(rng.choice(WORDS) for _ in range(2000)), "the " * 70 + "idiot " * 200]
    for got, text in zip(spans(texts), texts):
        want = [(a, b, round(s, 9)) for a, b, s in plain(text or "", STEMS)]
        if '"' in (text or ""):  # a mark between clauses opens none; compare weights of clauses without any
            assert len(got) == len(want)
        else:
            assert got == want, text


def test_weights_of_a_clause():
    score = lambda t: sum(s for *_, s in spans([t])[0])
    assert score("an idiot") == 4 and score("you idiot") == 5 and score("not an idiot") == 2 and score("he says idiot") == pytest.approx(4 * .6 * 1.25)
    assert score("will kill") == 9 and score("kill") == 0 and score("not of the and the idiot") == 4 and score("will the the the the kill") == 0
    assert score('she "idiot"') == pytest.approx(4 * .6 * 1.25) and score("scummy") == 0 and score("idiotical") == 1


def made(n, seed=1):
    """Documents with inflected insults in four toxic ones of ten, copies of one toxic text, and their labels."""
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice(["an", "er", "tho", "ing", "lo", "we", "is"]) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    copy = " ".join("rarestword" if k % 9 == 0 else part() for k in range(60)) + " veqx zuloxi"
    for i in range(n):
        toxic = i % 10 < 4
        words = [part() for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(rng.randrange(3, 6)):
                words[rng.randrange(len(words))] = rng.choice(["veqx", "zulo"]) + part()
        docs.append((i, copy if i % 50 == 0 else " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_stems_and_held_out_rows(spark, frame):
    docs, labels = made(600)
    docs += [(1000, None), (1001, ""), (None, "veqxan"), (5, docs[5][1]), (1002, "veqxer an " * 30_000)]
    told = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1), (9999, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    frame_ = frame(docs)
    model = toxicity.train(frame_.select("doc_id", "text"), told, ~toxicity.held_out(F.col("doc_id")))
    assert {"veqx", "zulo"} <= set(model.stems) and "rarestword" not in model.stems
    found = toxicity.find_toxicity(frame_, told).collect()
    assert len(found) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    out = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    truth = {i: t for i, _, t in labels}
    known = [r for r in out if r["doc_id"] in truth and r["doc_id"] % 50]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in known) >= 0.98 * len(known)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[1000]["score"] == by[1001]["score"] and by[1000]["clauses"] == [] and by[1002]["predicted"] == 1
    none = next(r for r in found if r["doc_id"] is None)
    assert none["held_out"] is False
    text = dict(docs)[by[1]["doc_id"]]
    assert all(text[c["start"]:c["stop"]] for c in by[1]["clauses"])


def test_no_documents_or_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.find_toxicity(frame([]).limit(0), none).collect() == []
    found = toxicity.find_toxicity(frame([(1, "I will kill you"), (2, "calm words")]), none).collect()
    score = {r["doc_id"]: r["score"] for r in found}
    assert score[1] > score[2]
    with pytest.raises(ValueError):
        toxicity.apply(spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, score double"), toxicity.Model({}))
