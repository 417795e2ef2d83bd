"""Vector codes and the Merkle manifest against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import frame  # noqa: F401
from revpulse.llm import merkle, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, part int"


def single(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = {}
    for _, v, _ in kept:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    size = max(sizes, key=lambda d: (sizes[d], d), default=0)
    kept = [r for r in kept if len(r[1]) == size]
    m = -(-size // parts)
    whole = [[math.floor(int(x) * 1024 if abs(x) > 2 ** 60 else 1024 * x) for x in v] + [0] * (m * parts - size) for _, v, _ in kept]
    cut = lambda v, p: v[p * m:(p + 1) * m]
    first = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][1]))[:entries]
    books = [[cut(whole[k], p) for k in first] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), n) for n, e in enumerate(books[p]))

    if not books[0]:
        return [], ""
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for v in whole:
                of.setdefault(near(v, p)[1], []).append(cut(v, p))
            for n, group in of.items():
                books[p][n] = [sum(c) // len(group) for c in zip(*group)]
    out = []
    for (i, _, lab), v in zip(kept, whole):
        found = [near(v, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{n:02x}" for _, n in found), min(sum(d for d, _ in found), vector_codes.LONG)))
    return out, ",".join(str(y) for b in books for e in b for y in e)


def coded(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, lab, "x", "y", 1) for i, v, lab in rows], SCHEMA).repartition(3)
    found, books = vector_codes.compress(frame, **how)
    return [tuple(r) for r in found.select("vec_id", "label", "code", "error").collect()], vector_codes.as_text(books)


key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("size,block", [(8, 4096), (6, 16), (64, 50)])
def test_codes(spark, monkeypatch, size, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(vector_codes, "CHUNK", 7)
    rng = random.Random(size)
    rows = [(i * 3 - 40, [rng.gauss(0, .3) for _ in range(size)], i % 4 or None) for i in range(160)]
    rows += [rows[0], rows[0], (rows[1][0], [.5] * size, 1), (None, [.1] * size, 2), (900, None, 1), (901, [], 1), (902, [None] * size, 1),
             (903, [math.nan] + [0.0] * (size - 1), 1), (904, [math.inf] * size, 1), (905, [1.0] * (size + 1), 1), (906, [0.0] * size, None)]
    rows = [(i, single(v), lab) for i, v, lab in rows]
    got, books = coded(spark, rows, entries=20)
    want, expected = brute_codes(rows, entries=20)
    assert sorted(got, key=key) == sorted(want, key=key) and books == expected


@pytest.mark.parametrize("most", [3.0e4, 6.0e8, 3.0e38])
def test_huge_components_are_exact(spark, most):
    rng = random.Random(7)
    rows = [(i, single([rng.uniform(-most, most) if rng.random() < .3 else rng.gauss(0, 1) for _ in range(5)]), 1) for i in range(60)]
    got, books = coded(spark, rows, entries=9)
    want, expected = brute_codes(rows, entries=9)
    assert sorted(got) == sorted(want) and books == expected


def test_no_vectors_and_label_sums(spark):
    assert coded(spark, []) == ([], "") and coded(spark, [(None, [1.0] * 4, 1)]) == ([], "")
    frame = spark.createDataFrame([(1, 5, None), (2, 7, None), (3, 1, 4), (4, vector_codes.LONG, 5), (5, 9, 5)], "vec_id long, error long, label int")
    for few in (0, 100):
        got = {r["vec_id"]: r["label_error"] for r in vector_codes.with_label_error(frame, few).collect()}
        assert got == {1: 12, 2: 12, 3: 1, 4: vector_codes.LONG, 5: vector_codes.LONG}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout):
    """rows: (doc_id, text, lang, source, n_chars); returns per row (id, leaf, subroot, root, path)."""
    first = lambda x: (x is not None, x)
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((first(i), sha(*[told(v) for v in (i, source, lang, n, text)])))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][a:a + fanout]) for a in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            a = at - at % fanout
            out.append(("".join(level[a:at]), "".join(level[at + 1:a + fanout])))
            at //= fanout
        return out

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([h for _, h in sorted(groups[g])]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, ((_, i), h) in enumerate(sorted(groups[g])):
            out.append((i, h, trees[g][-1][0], top[-1][0], tuple(path(trees[g], at) + path(top, k))))
    return out


@pytest.mark.parametrize("fanout,langs,n", [(2, 4, 150), (2, 40, 90), (3, 2, 70), (20, 3, 500), (2, 1, 1), (4, 1, 64)])
def test_manifest(spark, frame, fanout, langs, n):
    rng = random.Random(n)
    names = [None, "", "en", "é", "日本", *map(str, range(99))]
    rows = [(None if k % 50 == 3 else rng.randrange(n), None if k % 9 == 8 else "ß" * (k % 5), names[int(rng.random() ** 3 * langs)], None if k % 7 == 6 else "s", k % 11 or None) for k in range(n)]
    rows += rows[:3]
    docs = frame([]).limit(0).unionByName(spark.createDataFrame([r for r in rows], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True).repartition(5)
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, fanout=fanout, changed={"n_chars": changed})
    got = found.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("refolded", merkle.fold(F.col("claimed"), F.col("path"))).collect()
    told = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])) for r in got]
    assert sorted(told, key=str) == sorted(brute_manifest(rows, fanout), key=str)
    for r in got:
        assert r["folded"] == r["root"] and (r["refolded"] == r["root"]) == (r["claimed"] == r["leaf"])
    assert any(r["claimed"] != r["leaf"] for r in got) or n == 1


def test_manifest_of_nothing(spark, frame):
    found = merkle.manifest(frame([]).limit(0))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "path", "claimed"] and found.collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(frame([]), fanout=1)


def test_manifest_in_plain_joins_as_well(spark, frame, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", 0)
    rows = [(i, "t" * i, "xy"[i % 2], "s", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])) for r in merkle.manifest(docs).collect()]
    assert sorted(told) == sorted(brute_manifest(rows, 2))
