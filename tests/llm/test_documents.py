"""Operators on whole documents against brute force; nulls, empty and long texts, repeats, clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from corpus_fixtures import corpus, frame  # noqa: F401
from revpulse.llm import bpe, ctw, decontaminate, licenses, minhash, pii, quality, sharding, substrings

ITEMS = "item_id long, text string, items string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_words_are_those_of_the_patterns():
    import pyarrow as pa

    from revpulse.llm import words
    texts = ["ab  cd", None, "", "x", "y z\tq É\nfoo\x1c\x85", "A-b 9", "é", " a"]
    for table, pattern in ((words.NOT_SPACE, brute.SPACED), (words.ALNUM, brute.ALNUM)):
        w = words.words_of(words.texts_of(pa.array(texts)), table, lower=True)
        got = [[w.data[w.start[i]:w.end[i]].tobytes().decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        assert got == [pattern.findall(brute.lower(t)) for t in texts]
        h = w.hashes()
        said = [w.data[s:e].tobytes() for s, e in zip(w.start, w.end)]
        assert len(set(zip(said, h))) == len(set(said)) == len(set(h))


# --- near-duplicates -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates(corpus, frame, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)  # families in several blocks
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(corpus), percent, bands=40, rows=3).collect()}
    assert got == brute.components(corpus, percent)


def test_a_family_that_no_star_joins(frame, monkeypatch):
    """A chain: neighbours are similar, ends are not; and many false candidates of one bucket."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[3 * i:3 * i + 60])) for i in range(25)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows), 85, bands=60, rows=2).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows, 85).items()}


def test_near_duplicates_of_odd_rows(spark, frame):
    text = "a b c d e f g h i j k l m n o p"
    got = rows_of(minhash.near_duplicates(frame([(None, text), (7, text), (7, text), (3, text), (9, None), (9, text), (4, "")])))
    assert got == sorted([(None, 12, None, True), (7, 12, 3, False), (7, 12, 3, False), (3, 12, 3, True), (9, 0, 3, False), (9, 12, 3, False), (4, 0, 4, True)], key=repr)
    assert minhash.near_duplicates(frame([(1, "x")]).limit(0)).collect() == []


# --- decontamination -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [400_000, 7])
def test_passages(spark, corpus, frame, block):
    texts = dict(corpus)
    items = [(1, texts[8]), (1, texts[8]), (12, texts[8]), (2, "one"), (3, None), (4, ""), (5, "Two WORDS!"), (None, "beta"), (6, texts[10]), (30, "nowhere to be found at all")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = {r.doc_id: (r.n_words, sum(h.stop - h.start for h in r.hits), list(r["items"])) for r in decontaminate.find_passages(frame(corpus), table, block=block).collect()}
    assert got == {i: e for (i, _), e in zip(corpus, brute.passages([t for _, t in corpus], items))}


def test_passages_of_empty_tables(spark, frame):
    none = spark.createDataFrame([], ITEMS)
    (row,) = decontaminate.find_passages(frame([(None, "some text")]), none).collect()
    assert (row.n_words, row.hits, row["items"], row.row, row.lang) == (2, [], [], "clash", None)
    assert decontaminate.find_passages(frame([(1, "x")]).limit(0), none).collect() == []


# --- repeated passages ---------------------------------------------------------------------------------------

def test_repeats(corpus, frame):
    for window, gram in ((20, 8), (6, 3)):
        got = {r.doc_id: (r.n_words, sum(s.stop - s.start for s in r.removed), r.kept_text) for r in substrings.remove_repeats(frame(corpus), window, gram).collect()}
        assert got == brute.repeats(corpus, window)


def test_repeats_of_odd_rows(frame):
    a, b = " ".join(f"a{i}" for i in range(25)), " ".join(f"b{i}" for i in range(25))
    got = collections.Counter((r.doc_id, r.kept_text) for r in substrings.remove_repeats(frame([(None, a), (5, a), (5, a), (2, b), (5, b), (8, None)])).collect())
    assert got == {(None, ""): 1, (5, a): 2, (2, b): 1, (5, ""): 1, (8, ""): 1}
    assert substrings.remove_repeats(frame([(1, "x")]).limit(0)).collect() == []


# --- encoding ------------------------------------------------------------------------------------------------

def test_encoding_equals_the_library(corpus, frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    odd = ["It's <|endoftext|>x<|startoftext|><|endoftext |> I'LL", "ΑΣ ς İstanbul é é \x1c\x1d a\x85b 12³ ½ x²!'s --- ａ", "ab" * 400 + " " + "a" * 99, "<|endoftext|>", "漢ｶﾞ́‍😀 \x00a﻿b ​"]
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(odd)), (1000, odd[0]), (None, "null id")]
    got = [(r.doc_id, r["ids"], r.decoded, r.lang) for r in bpe.encode(frame(rows), path).collect()]
    texts = dict(rows)
    assert len(got) == len(rows)
    v = bpe.Vocabulary(path)
    for i, ids, decoded, _ in got:
        want = theirs.encode(texts[i] or "", add_special_tokens=False).ids
        assert ids == want and decoded == theirs.decode(want, skip_special_tokens=False) == bpe.decode(v, ids)
    assert bpe.restore(v, theirs.encode("The cat's über-nice, isn't it?", add_special_tokens=False).ids) == "the cat 's über - nice , isn 't it ?"
    assert bpe.encode(frame([(1, "x")]).limit(0), path).collect() == []


def test_a_merge_that_must_be_done_place_by_place():
    """When the product of a merge takes part in an earlier one, later places wait."""
    v = object.__new__(bpe.Vocabulary)
    names = ["a", "b", "a</w>", "b</w>", "ab", "ab</w>", "aba"]
    at = {n: i for i, n in enumerate(names)}
    merges = [("ab", "a"), ("a", "b"), ("a", "b</w>")]
    v.size, v.tokens = len(names), names
    v.inner, v.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for c in "ab":
        v.inner[ord(c)], v.last[ord(c)] = at[c], at[c + "</w>"]
    keys = np.array([at[a] * len(names) + at[b] for a, b in merges])
    order = np.argsort(keys)
    v.keys, v.rank, v.made = keys[order], order.astype(np.int64), np.array([at[a + b] for a, b in merges])
    v.at_once = np.array([True, False, True])
    ids, _ = bpe.merge_words(v, [b"abab"])
    assert [names[i] for i in ids] == ["aba", "b</w>"]


# --- quality -------------------------------------------------------------------------------------------------

def test_quality_on_labels_held_out(spark):
    from conftest import SF
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen, unseen = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    found = quality.classify(docs, seen).join(unseen, "doc_id").select("good", "quality", "text_score", "meta_score", "quality_score").collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert len(good) > 50 and len(bad) > 10
    assert sum(r.good for r in good) >= 0.98 * len(good)
    assert sum(not r.good for r in bad) >= 0.8 * len(bad)
    assert all(0 <= x <= 1 for r in found for x in r[2:])


def test_exchange_covers_all_unlabelled_documents(frame):
    """The surest document is taught, wherever it stands among more than a pool's worth of others; copies count as one."""
    def view(size):
        v = quality.Logistic(0)
        v.mean, v.std, v.w, v.b = np.zeros(size, np.float32), np.ones(size, np.float32), np.zeros(size, np.float32), 0.0
        return v

    views = {"text": view(quality.DIM), "meta": view(quality.META)}
    views["meta"].w[-2] = 9  # the share of digits
    rows = [(i, f"plain words {i % 7} about nothing at all {i}") for i in range(6000)] + [(7000 + i, "123456789") for i in range(5)] + [(8000, "99999 88888"), (None, "777")]
    base = frame(rows, 5).select(F.xxhash64("text", "lang", "source", "n_chars").alias("__key"), F.col("doc_id").alias("__id"), "text", "lang", "source", "n_chars")
    none = {"text": np.zeros(0, np.int64), "meta": np.zeros(0, np.int64)}
    told = quality._surest(base, np.array([8000]), views, none, [300, 300])
    want = {r["__key"] for r in base.where("text in ('123456789', '777')").select("__key").distinct().collect()}
    assert sorted(told) == sorted((1, 1, k) for k in want)
    assert quality._surest(base, np.array([8000]), views, dict(none, text=np.array(sorted(want))), [300, 300]) == []
    assert len(quality._surest(base, np.array([8000]), views, none, [300, 1])) == 1


def test_logistic_without_copies():
    """The fit on raw columns equals the fit on standardised ones."""
    rng = np.random.RandomState(0)
    x = (rng.randn(300, 7) * [1, 20, .01, 3, 1, 1, 0] + [5, -3, 1, 0, 0, 0, 4]).astype(np.float32)
    y = (x[:, 0] + rng.randn(300) > 5).astype(float)
    z = (x[:, :6] - x[:, :6].mean(axis=0)) / x[:, :6].std(axis=0)
    w, b, ahead, before = np.zeros(6), 0.0, np.zeros(6), np.zeros(6)
    for t in range(200):
        e = 1 / (1 + np.exp(-(z @ ahead + b))) - y
        w = ahead - 4 / 7 * (e @ z / 300 + 1e-3 * ahead)
        b -= e.mean()
        ahead, before = w + t / (t + 3) * (w - before), w
    fitted = quality.Logistic(1e-3).fit(x, y)
    assert np.allclose(fitted.score(x), z @ w + b, atol=2e-2) and fitted.w[6] == 0


def test_quality_without_labels(spark, corpus, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in quality.classify(frame(corpus), none).select("text_score", "meta_score", "quality_score", "good").distinct().collect()] == [(None, None, None, True)]
    odd = spark.createDataFrame([(i, (i // 2) % 2 if i % 7 else None) for i in range(40)] + [(None, 1), (3, 5)], "doc_id long, quality int")
    rows = quality.classify(frame([*corpus, corpus[0], (None, None)]), odd).collect()
    assert len(rows) == len(corpus) + 2 and all(r.quality_score is not None for r in rows) and rows[0].key == "clash"
    assert quality.classify(frame([(1, "x")]).limit(0), odd).collect() == []


# --- personal data -------------------------------------------------------------------------------------------

PERSONAL = [
    "mail a.b@c.de, x@y z@@q.com a@b.c@d.e.f 1.2.3.4 1.2.3.256 1.2.3.4.5.6.7.8 0001.2.3.4",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4111111111111111, +1 (988) 555-2485 +12 3 +1 234 567 8901 23456",
    "@ . + +1 ++12 (3) " + "9" * 5000 + ".1.2.3 " + "a" * 3000 + " " + "7 " * 900, "x +49 30 1234567é é@a.b", "", None,
]


def test_base_spans(frame):
    import random
    rng = random.Random(3)
    texts = PERSONAL + ["".join(rng.choice("0123456789. -+()@ab\n") for _ in range(rng.randrange(120))) for _ in range(400)]
    rows = pii.find_personal_data(frame(list(enumerate(texts)))).select("doc_id", "base_spans", "spans", "redacted", "key").collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [tuple(s) for s in r.base_spans]
        assert base == brute.base_spans(texts[r.doc_id])
        assert set(base) <= {tuple(s) for s in r.spans} and r.key == "clash"
        assert r.redacted is not None if texts[r.doc_id] is not None else r.redacted is None


def test_skip_edges_carry_a_label():
    """A token that repeats a labelled one far away gets its label; without skip edges it does not."""
    model = pii.Model()
    model.node[0] = [1.5, 0, 0, 0, 0]  # alone, every token counts as none
    model.skip = np.where(np.eye(5) > 0, 3.0, -3.0)
    text = "call +1 (988) 555-2485 now. " + "word " * 50 + "again 555-2485 and 333-4444."
    g = pii.Graph([text])
    kinds = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.all_spans(g, model)[0]]
    assert ("phone", "555-2485") in kinds and ("phone", "333-4444") not in kinds
    model.skip = np.zeros((5, 5))
    assert len(pii.all_spans(pii.Graph([text]), model)[0]) == 1


def test_messages_are_exact_on_a_chain():
    """On a tree loopy messages give the true marginals."""
    g = pii.Graph(["12 345 6789 12"])
    model = pii.Model()
    rng = np.random.RandomState(0)
    model.node, model.chain, model.skip = rng.randn(*model.node.shape), rng.randn(5, 5), np.zeros((5, 5))
    model.chain += model.chain.T
    g.skip = g.skip[:0]
    local = g.x @ model.node
    weight = {y: math.exp(sum(local[i, y[i]] for i in range(4)) + sum(model.chain[y[i], y[i + 1]] for i in range(3))) for y in itertools.product(range(5), repeat=4)}
    total = sum(weight.values())
    want = [[sum(w for y, w in weight.items() if y[i] == k) / total for k in range(5)] for i in range(4)]
    assert np.allclose(model.marginals(g, rounds=60), want, atol=1e-4)


def test_redacting():
    assert pii.redact("mail a@b.c now", [(0, 5, 10)]) == "mail [EMAIL] now"
    assert pii.redact("0123456789", [(2, 1, 4), (3, 3, 6), (1, 8, 9)]) == "0[CARD]67[IP]9"
    assert pii.redact(None, []) is None


def test_personal_data_in_an_empty_table(frame):
    assert pii.find_personal_data(frame([(1, "x")]).limit(0)).collect() == []
    rows = pii.find_personal_data(frame([(None, "a@b.cd"), (None, "a@b.cd")])).collect()
    assert [r.redacted for r in rows] == ["[EMAIL]"] * 2


# --- licenses ------------------------------------------------------------------------------------------------

def test_licenses(corpus, frame):
    texts = [t for _, t in corpus] + [
        "Released under the MIT license", "foo\nreleased, under THE mit License.\nbar baz", "Licensed under the\nApache License, version 2.0!",
        "Licensed under CC BY 4.0. Licensed under CC BY 4.0.", "All rights\nreserved.", "all rights reserved\n\n", "the the the the the",
        "This work is licensed under the GNU General Public License, version 3. " * 3,
    ]
    rows = list(enumerate(texts))
    for threshold in (0.8, 0.5):
        got = {r.doc_id: [tuple(m) for m in r.licenses] for r in licenses.find_licenses(frame(rows), threshold=threshold).collect()}
        assert got == {i: brute.licenses(t, licenses.TEMPLATES, threshold) for i, t in rows}
    assert licenses.find_licenses(frame([(1, "x")]).limit(0)).collect() == []
    assert licenses.find_licenses(frame([(1, "x y")]), templates={}).first().licenses == []
    with pytest.raises(ValueError):
        licenses.find_licenses(frame([(1, "x")]), threshold=0)


@pytest.mark.parametrize("wide", [False, True])
def test_licenses_wrapped_or_inline(frame, wide):
    import textwrap
    fill = " ".join(f"w{i}" for i in range(2000 if wide else 90)) + " "
    mit, bsd, gpl = (licenses.TEMPLATES[n] for n in ("MIT text", "BSD-style", "GPL-3.0 header"))
    wrapped = lambda t: "\n".join(f"# {line}" for line in textwrap.wrap(t, 60))
    odd = mit.replace("Software", "Software product", 1).replace("without limitation", "", 1)
    cases = [
        (wrapped(mit), {"MIT text", "MIT grant"}), (wrapped(bsd), {"BSD-style"}), (mit, {"MIT text", "MIT grant"}), (wrapped(odd), {"MIT text", "MIT grant"}),
        (wrapped(gpl), {"GPL-3.0 header", "GPL-2.0 header", "AGPL-3.0 header"}), ("This project is released under the MIT License.", {"MIT"}),
        ("Code: Licensed under the Apache\nLicense, Version 2.0, see the file", {"Apache-2.0"}), ("under the terms of the license", set()), ("rights all reserved", set()),
    ]
    rows = [(i, f"{fill}{t} {fill}\n{fill}") for i, (t, _) in enumerate(cases)]
    found = {r.doc_id: r.licenses for r in licenses.find_licenses(frame(rows)).collect()}
    for i, (_, names) in enumerate(cases):
        told = {m.license for m in found[i]}
        assert names <= told and (names or not told), (i, told)
        assert len(told) == len(found[i])  # each once
    twice = licenses.find_licenses(frame([(1, f"{fill}{mit} {fill}\n{wrapped(mit)}\n{fill}\n")])).first().licenses
    assert [(m.line, round(m.dice, 9)) for m in twice if m.license == "MIT text"] == [(0, 1.0), (1, 1.0)]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_license_windows_by_brute_force(frame, threshold):
    """A text has a window of a template exactly if some run of its words is similar enough."""
    import random
    rng = random.Random(1)
    template = {"t": "a b c d e f g"}
    rows = []
    for i in range(150):
        w = [rng.choice("uvwxyz") for _ in range(6)] + [x for x in "abcdefg" if rng.random() < .9 or rng.random() < .3] + [rng.choice("abuvw") for _ in range(8)]
        rows.append((i, " ".join(w[:9]) + "\n" + " ".join(w[9:])))
    got = {r.doc_id: r.licenses for r in licenses.find_licenses(frame(rows), template, threshold).collect()}
    want = set(zip("abcdef", "bcdefg"))
    most = int((2 - threshold) / threshold * len(want) + 1e-9)
    for i, t in rows:
        w = t.split()
        best = 0
        for a, b in itertools.combinations(range(len(w) + 1), 2):
            g = set(zip(w[a:b], w[a + 1:b]))
            if g and b - a - 1 <= most:
                best = max(best, 2 * len(g & want) / (len(g) + len(want)))
        assert bool(got[i]) == (best >= threshold)


# --- scoring -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [3_000_000, 60])
def test_scores(corpus, frame, block, monkeypatch):
    monkeypatch.setattr(ctw, "FREQUENT", 150)  # most words are rare
    rows = [r for r in corpus if r[1] is None or len(r[1]) < 1000] + [(None, "no id"), (900, "Héllo wörld"), (900, "Héllo wörld"), (901, "\x00 a\x00")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [t for i, t in rows if not held(i)]
    seen, said = brute.counts(train), lambda t: " ".join(brute.SPACED.findall(brute.lower(t))).encode() + b"\n"
    total, distinct = sum(seen.values()), len(seen)
    tree = brute.ContextTree([said(t) for t in train], 2)
    want = collections.Counter()
    for i, t in rows:
        w = [*brute.SPACED.findall(brute.lower(t)), None]
        base = sum(math.log10((seen[x] + .1) / (total + .1 * (distinct + 1))) for x in w)
        want[i, held(i), len(w), sum(seen[x] > 0 for x in w), total, round(base, 6), round(tree.log10(said(t)), 4)] += 1
    found = ctw.score(frame(rows), depth=2, block=block).collect()
    got = collections.Counter((*r[:5], round(r.base_score, 6), round(r.score, 4)) for r in found)
    assert got == want
    for r in found:
        assert r.bits_per_byte > 0


@pytest.mark.parametrize("block", [2_000_000, 8])
def test_scores_use_contexts_of_five_bytes(frame, block):
    rows = [(i, f"abcde{i % 3} the cat sat on the mat abcde{i % 3} {'xy' * (i % 4)}") for i in range(25)]
    said = lambda t: " ".join(t.split()).encode() + b"\n"
    tree = brute.ContextTree([said(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10], 5)
    got = {r.doc_id: r.score for r in ctw.score(frame(rows), block=block).collect()}
    assert len(got) == 25
    blocks = ctw.Trained(frame(rows).select("text"), 5).blocks(block)
    assert (blocks.count > 1 and (blocks.large >= 0).any()) == (block == 8)  # pairs cut by their third byte
    for i, t in rows:
        assert abs(got[i] - tree.log10(said(t))) < 1e-6


def test_a_worker_holds_the_keys_of_a_block_once(frame):
    trained = ctw.Trained(frame([(i, f"some words {i} and more of {i % 7}") for i in range(40)]).select("text"), 5)
    shared, p = trained.block(trained.blocks(1000), 0)
    model = shared.value
    assert len(p) == len(model.keys) + 1 and p[-1] == 0
    assert np.allclose(p[:-1], model.log10(model.keys))
    index = model.index()
    assert index is model.index() and index.keys is model.keys  # no copy, built once
    assert sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray) and x is not model.keys) <= 4 * max(16, 4 * len(model.keys) + 4)
    assert (index.find(model.keys) == np.arange(len(model.keys))).all()
    other = np.setdiff1d(np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), model.keys)
    assert (index.find(other) == -1).all() and (ctw.HashIndex(model.keys[:0]).find(other) == -1).all()


def test_probabilities_sum_to_one():
    keys = ctw.gram_keys(np.frombuffer(b"abracadabra\n", np.uint8), np.array([0, 12]), 3)
    k, n = np.unique(keys, return_counts=True)
    built = ctw.build(k, n, 3, 0)
    short = [e for e in built if e["depth"] < 3]
    table = ctw.Model(k, n, np.concatenate([np.uint64(e["depth"]) << np.uint64(48) | e["node"] for e in short]), *(np.concatenate([e[c] for e in short]) for c in ("weight", "one")), 3)
    for context in (k[0], k[5], np.uint64(0)):
        every = (context >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** table.log10(every)).sum() - 1) < 1e-9


def test_scores_without_training_rows(frame):
    held = next(i for i in range(999) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = ctw.score(frame([(held, "ab")])).collect()
    assert tuple(row)[:5] == (held, True, 2, 0, 0) and abs(row.score - 24 * math.log10(.5)) < 1e-9
    assert ctw.score(frame([(1, "x")]).limit(0)).collect() == []


# --- shards --------------------------------------------------------------------------------------------------

def test_hilbert_cells_are_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        at = sharding.hilbert_index(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_text_dimensions_by_rank(spark):
    """Values that begin alike still fall into cells of their own; a cell is the share of rows with a smaller value."""
    values = [f"https://site{i % 16:02d}.org" for i in range(320)] + [None, "", "zz"]
    got = sharding.curve_order(spark.createDataFrame([(v,) for v in values], "source string").repartition(3), ["source"]).collect()
    rest = [v or "" for v in values]
    for r in got:
        assert r["hilbert"] == sum(v < (r["source"] or "") for v in rest) * 32 // len(rest)
    assert len({r["hilbert"] for r in got if (r["source"] or "").startswith("http")}) == 16
    few = sharding.curve_order(spark.createDataFrame([(None,), ("",)], "source string"), ["source"]).collect()
    assert {r["hilbert"] for r in few} == {0}


@pytest.mark.parametrize("rows", [0, 5, 63])
def test_shards(corpus, frame, rows):
    data = (corpus + [(None, None), corpus[3], corpus[3]])[:rows] if rows < 60 else corpus + [(None, None), corpus[3], corpus[3]]
    got = sharding.assign_shards(frame(data) if data else frame([(1, "x")]).limit(0), shards=16).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert not data or max(map(len, by.values())) - min(len(by[s]) for s in range(16)) <= 1
    for s, held in by.items():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    order = [r.hilbert for s in range(16) for r in sorted(by[s], key=lambda r: r.slot)]
    assert order == sorted(order)


def test_shard_files_prune(spark, frame, tmp_path):
    docs = frame([(i, "w " * (i * 37 % 200)) for i in range(400)] + [(5, "twice"), (5, "twice")])
    sharding.write_shards(docs, str(tmp_path / "out"), shards=8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(back.select(docs.columns)) == rows_of(docs)
    spans = back.groupBy("shard").agg(F.min("n_chars"), F.max("n_chars")).collect()
    assert len(spans) == 8 and sum(r[2] - r[1] for r in spans) < 0.7 * 8 * 400


def test_training_reads_whole_texts(spark, frame, monkeypatch):
    """A card after 30,000 other tokens is counted, and documents without any digit use up no place of the sample."""
    rows = [(i, "no such thing") for i in range(200)] + [(1000, "7 x " * 30_000 + "4111 1111 1111 1111")]
    told = {}
    monkeypatch.setattr(pii.Model, "fit", lambda self, x, y, times, chain, skip: told.update(y=y, times=times, chain=chain, skip=skip) or self)
    pii.train(frame(rows), train_docs=1)
    card = pii.KINDS.index("card") + 1
    assert told["times"][told["y"] == card].sum() == 4 and told["times"][told["y"] == 0].sum() == 30_000
    assert told["chain"][card, card] == 3 and told["skip"].sum() == 29_999 + 2


# --- the pipeline --------------------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from conftest import SF
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), "doc_id long, lang string, source string, n_tokens long, ids array<int>" if name.startswith("BPE") else "doc_id long, text string, lang string, source string, n_chars long")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert name.startswith("BPE") or docs.columns == columns
    first, second, third, fourth, fifth = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in first for i, q in labels.items() if q == 1)
    assert sum(i not in first for i, q in labels.items() if q == 0) >= 0.8 * sum(q == 0 for q in labels.values())
    groups = brute.components([(i, r.text) for i, r in first.items()], 80)
    assert set(second) == {i for i, (_, c) in groups.items() if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    ids = sorted(second)
    hits = brute.passages([second[i].text for i in ids], items)
    assert set(third) == {i for i, h in zip(ids, hits) if not h[1]}
    assert set(fourth) == set(third)
    for i, r in fourth.items():
        spans = brute.base_spans(third[i].text)
        assert not brute.base_spans(r.text) and (spans or re.search("[0-9]", third[i].text) or r.text == third[i].text)
        assert r.n_chars == (len(r.text) if r.text != third[i].text else third[i].n_chars)
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: r["ids"] for i, r in fifth.items()} == {i: theirs.encode(r.text, add_special_tokens=False).ids for i, r in fourth.items()}


def stage(name):
    import corpus_pipeline
    return next(f for n, f in corpus_pipeline.STAGES if name in n)


@pytest.mark.parametrize("top", [100, (1 << 63) - 1])
def test_one_copy_stays_whatever_its_id(spark, frame, top):
    words_ = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words_), " ".join(words_[:-1] + ["x"]), " ".join(reversed(words_))
    rows = [(7, text), (7, text), (8, text), (None, text), (None, text), (5, near), (9, other), (9, other), (None, other + " end"), (None, None), (None, None), (None, ""), (3, ""), (7, "a text of its own here"), (top, "last")]
    docs = frame(rows)
    left = stage("near-dedup")(spark, docs, "none")
    assert left.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect())
    kept = [(i, t) for i, t in {(r[1], r[2]) for r in got if not r[0]}]
    assert sorted(kept) == sorted([(5, near), (9, other), (3, ""), (7, "a text of its own here"), (top, "last")])
    assert [t for null, _, t in got if null] == ["", ""]  # the null text and the empty one are linked with nothing


def test_only_null_ids_and_no_rows(spark, frame):
    text = " ".join(f"w{i}" for i in range(40))
    left = stage("near-dedup")(spark, frame([(None, text), (None, text), (None, text + " more")]), "none").collect()
    assert len(left) == 1
    assert stage("near-dedup")(spark, frame([(1, "x")]).limit(0), "none").collect() == []


def test_stages_on_odd_tables(spark, frame, tmp_path):
    """Null ids and texts, repeats, extra columns with clashing names, and no rows at all, through every stage in turn."""
    folder = str(tmp_path)
    frame([]).limit(0).select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    import corpus_pipeline
    long = " ".join(f"word{i}" for i in range(3000)) + " mail me@site.org"
    for rows in ([], [(1, None), (1, None), (None, ""), (2, long), (2, long), (None, long), (3, "short")]):
        docs = frame(rows) if rows else frame([(1, "x")]).limit(0)
        for name, run in corpus_pipeline.STAGES:
            out = run(spark, docs, folder)
            if not name.startswith("BPE"):
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() == (4 if rows else 0)  # of the five rows without a text of five words, and the long ones, one each


def test_digests(spark, corpus, frame):
    """What the queries derive from the operators' outputs."""
    from conftest import SF

    from revpulse.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in QUERIES["op1_bpe_merge_rounds"](spark, SF).collect():
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert tuple(r)[1:4] == (len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)))
    for r in QUERIES["op9_skip_chain_crf"](spark, SF).collect():
        base = brute.base_spans(texts[r.doc_id])
        told = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == sha(",".join(told)) and set(told) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    shards = QUERIES["op2_hilbert_shards"](spark, SF).collect()
    assert len(shards) == len(texts) and {r.law for r in shards} == {"rows"} and {r.grown_shard for r in shards} == {None}
