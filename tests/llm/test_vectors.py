"""Exact top k against brute force."""

import math
import random

import numpy as np
import pytest

from revpulse.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long, rank int, dim int"


def brute(rows, queries, k):
    def whole(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [64 * int(x) if abs(x) > 2 ** 53 else math.floor(64 * x) for x in v]

    out = set()
    for i, v in {(i, tuple(v) if v is not None else None) for i, v in queries}:
        q = whole(v)
        if i is None or q is None:
            continue
        scored = sorted((-min(max(sum(a * b for a, b in zip(q, w)), -topk.LONG), topk.LONG), j) for j, u in rows if j is not None and j != i and (w := whole(u)) and len(w) == len(q))
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])}
    return out


def found(spark, rows, queries, k):
    make = lambda r: spark.createDataFrame([(i, v, 1, 1, 1) for i, v in r], SCHEMA)
    return topk.search(make(queries), make(rows), k).collect()


@pytest.mark.parametrize("block", [4096, 16])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, .2) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [.25] * 8) for i in range(60)]  # ties
    rows += [(400, None), (401, []), (402, [None] + [.1] * 7), (403, [math.nan] * 8), (404, [math.inf] * 8), (None, [.1] * 8), (405, [0.0] * 8), (406, [1.0, 2.0]), (407, [3.0, -1.0])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    queries = [r for r in rows if (r[0] or 0) % 5 == 0] + rows[:1]
    got = [tuple(r) for r in found(spark, rows, queries, 20)]
    assert len(got) == len(set(got)) and set(got) == brute(rows, queries, 20)


def test_few_and_none(spark):
    assert found(spark, [], [], 20) == []
    got = [tuple(r) for r in found(spark, [(1, [1.0]), (2, [2.0]), (2, [2.0]), (3, [math.nan])], [(1, [1.0]), (2, [2.0])], 20)]
    assert sorted(got) == [(1, 1, 2, 8192), (1, 2, 2, 8192), (2, 1, 1, 8192)]
    large = [(i, [2.0e6 + i, -1.0e6]) for i in range(30)]  # beyond single precision
    assert {tuple(r) for r in found(spark, large, large[:3], 5)} == brute(large, large[:3], 5)


@pytest.mark.parametrize("most", [5.0e6, 4.0e9, 3.0e38])
def test_huge_components_take_part(spark, most):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.uniform(-most, most) if rng.random() < .4 else rng.gauss(0, 1))) for _ in range(6)]) for i in range(80)]
    assert {tuple(r) for r in found(spark, rows, rows[:20], 7)} == brute(rows, rows[:20], 7)
