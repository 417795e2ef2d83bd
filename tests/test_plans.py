"""Ordered scans and quantiles against plain windows and numpy, with one series holding most rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from revpulse.operators import drift
from revpulse.plans.ordered import balanced_span, running, with_previous
from revpulse.plans.per_key import first_per_key
from revpulse.plans.quantiles import quantiles

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        rows.append((key, START + dt.timedelta(seconds=rnd.randrange(5 * 86400)), i, rnd.randrange(-5, 9), rnd.random() < 0.3))
    return spark.createDataFrame(rows, "k string, ts timestamp, i int, v int, flag boolean")


def test_with_previous(series):
    whole = Window.partitionBy("k").orderBy("ts", "i")
    want = series.select("i", F.lag("v").over(whole).alias("p"), (F.row_number().over(whole) > 1).alias("h"))
    got = with_previous(series, ["k"], "ts", {"p": "v"}, ties=["i"]).select("i", "p", F.col("has_previous").alias("h"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_slices_follow_the_busiest_series(series):
    busiest = series.groupBy("k", F.window("ts", "1 hour")).count().agg(F.max("count")).first()[0]
    span = balanced_span(series, ["k"], "ts", rows=max(1, busiest // 6))
    assert 1 <= int(span.split()[0]) <= 600 and balanced_span(series, ["k"], "ts") == "3600 seconds"
    whole = Window.partitionBy("k").orderBy("ts", "i")
    want = series.select("i", F.lag("v").over(whole).alias("p"))
    assert sorted(with_previous(series, ["k"], "ts", {"p": "v"}, ties=["i"], span=span).select("i", "p").collect()) == sorted(want.collect())


def test_running(series):
    whole = Window.partitionBy("k").orderBy("ts", "i").rowsBetween(Window.unboundedPreceding, 0)
    plain = series.withColumn("s", F.sum("v").over(whole))
    want = plain.select("i", "s", F.max("v").over(whole).alias("m"), F.last(F.when(F.col("flag"), F.col("s")), True).over(whole).alias("l"))
    got = running(series, ["k"], "ts", {"s": F.col("v")}, {"m": F.col("v")}, {"l": ("s", F.col("flag"))}, ties=["i"], span="6 hours")
    assert sorted(got.select("i", "s", "m", "l").collect(), key=str) == sorted(want.collect(), key=str)


def test_first_per_key_limits_before_the_shuffle(series):
    top = first_per_key(series, ["k"], [F.desc("v")], 2)
    assert top.groupBy("k").count().where("count > 2").count() == 0
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 1.0, 1.0], [float(x % 7) for x in range(100)], [random.Random(1).gauss(0, 9) for _ in range(2500)],
])
def test_quantiles(spark, values):
    probs = [0, 0.1, 0.25, 0.5, 0.77, 0.9, 1]
    frame = spark.createDataFrame([("g", v) for v in values] + [("n", None)], "g string, v double")
    out = {r.g: r.quantiles for r in quantiles(frame, "v", probs, ["g"]).collect()}
    assert out["g"] == pytest.approx(list(np.percentile(values, [p * 100 for p in probs])), abs=1e-12)


def test_quantiles_in_ranges_of_bounded_size(spark, monkeypatch):
    """Ranges are cut again until each holds few values."""
    from revpulse.plans import quantiles as plan
    monkeypatch.setattr(plan, "ROWS_PER_RANGE", 3)
    rnd = random.Random(9)
    values = [rnd.gauss(0, 9) for _ in range(3000)] + [float(rnd.randrange(40)) for _ in range(3000)]
    probs = [0, 0.01, 0.3, 0.5, 0.99, 1]
    frame = spark.createDataFrame([(k, v) for v in values for k in "ab"[: 1 + (v > 0)]], "g string, v double")
    for g, want in (("a", values), ("b", [v for v in values if v > 0])):
        got = {r.g: r.quantiles for r in quantiles(frame, "v", probs, ["g"]).collect()}[g]
        assert got == pytest.approx(list(np.percentile(want, [p * 100 for p in probs])), abs=1e-12)


def numpy_psi(expected, actual, bins=10):
    edges = np.unique(np.percentile(np.concatenate([expected, actual]), np.linspace(0, 100, bins + 1)))

    def share(x):
        return np.clip(np.histogram(x, bins=edges)[0] / len(x), 1e-6, None)

    e, a = share(expected), share(actual)
    return float(np.sum((a - e) * np.log(a / e)))


@pytest.mark.parametrize("case", ["shift", "integers", "same", "disjoint"])
def test_psi(spark, case):
    rnd = np.random.default_rng(7)
    e = rnd.normal(10, 3, 900)
    a = {"shift": rnd.normal(12, 3, 500), "integers": None, "same": e, "disjoint": rnd.normal(99, 1, 300)}[case]
    if case == "integers":
        e, a = rnd.integers(0, 4, 800).astype(float), rnd.integers(1, 6, 700).astype(float)
    frames = [spark.createDataFrame([(float(x),) for x in v], "v double") for v in (e, a)]
    assert drift.psi(*frames, "v").first()[0] == pytest.approx(numpy_psi(e, a), abs=1e-9)


def test_psi_of_one_value(spark):
    frame = spark.createDataFrame([(4.0,)] * 60, "v double")
    assert drift.psi(frame, frame, "v").first()[0] == 0.0
