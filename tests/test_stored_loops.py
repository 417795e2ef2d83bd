"""Loops on stored tables: dead letters, the model pointer, the rollup, supervision, alert states, retention."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from revpulse import schemas
from revpulse.operators import lifecycle, serving, telemetry
from revpulse.operators.ingest import route_dead_letters, validate_events
from revpulse.sources import letters, models, retention, rollup, warehouse
from revpulse.sources.keyed import StoredTable
from revpulse.sources.orders import parse_order_events
from revpulse.streaming import streams

NOW = dt.datetime(2024, 3, 1)


def wire(i, **other):
    return json.dumps({"event_id": f"e{i}", "event_type": "order_placed", "timestamp": "2024-01-01T10:00:00Z", "order_id": f"o{i}", "product_id": "p", "product_name": "n",
                       "category": "Home", "quantity": 1, "unit_price": 5.0, "total_amount": 5.0, "region": "Delhi", "payment_method": "card", **other})


@pytest.fixture
def dlq(spark, tmp_path):
    bad = spark.createDataFrame([(wire(1, timestamp="x"),), (wire(2, timestamp="x"),), ("{oops",), (wire(4, total_amount=9.0),)], "value string")
    dead = route_dead_letters(validate_events(parse_order_events(bad)), "2024-01-02 00:00:00")[1]
    mended = dead.withColumn("event_data", F.replace("event_data", F.lit('"timestamp": "x"'), F.lit('"timestamp": "2024-01-01T10:00:00Z"')))
    table = StoredTable(spark, str(tmp_path / "letters"), ["dlq_id"], time="first_failed")
    letters.store_letters(table, mended)
    letters.store_letters(table, mended)  # known ones are not stored again
    return table, StoredTable(spark, str(tmp_path / "orders"), ["event_id"], time="event_timestamp")


def state(table):
    return sorted((r.retry_count, r.resolved, r.error.split(",")[0]) for r in table.read().collect())


def test_letters_are_retried_until_they_give_up(dlq):
    table, orders = dlq
    assert letters.retry_stored(table, orders, 0, NOW) == {"recovered": 2, "kept": 2}
    assert letters.retry_stored(table, orders, 0, NOW) == {"recovered": 0, "kept": 0}  # the batch is known
    assert {r.event_id for r in orders.read().collect()} == {"e1", "e2"}
    for batch in range(1, 7):
        letters.retry_stored(table, orders, batch, NOW)
    assert [s[:2] for s in state(table)] == [(0, True), (0, True), (5, False), (5, False)] and orders.stats()["rows"] == 2


def test_crash_between_orders_and_letters(spark, dlq, monkeypatch):
    table, orders = dlq
    commit = StoredTable._commit

    def dies(self, *a, **k):
        if self.path.endswith("letters"):
            raise RuntimeError("killed")
        return commit(self, *a, **k)

    monkeypatch.setattr(StoredTable, "_commit", dies)
    with pytest.raises(RuntimeError):
        letters.retry_stored(table, orders, 0, NOW)
    monkeypatch.undo()
    assert orders.stats()["rows"] == 2 and not any(s[1] for s in state(table))
    late = spark.createDataFrame([("late", wire(7), "rejected", 0, dt.datetime(2024, 1, 3), None, False)], schemas.DLQ_EVENTS)
    letters.store_letters(table, late)  # comes in before the rerun, whose orders are already taken
    assert letters.retry_stored(table, orders, 0, NOW) == {"recovered": 2, "kept": 2}
    assert orders.stats()["rows"] == 2 and sum(s[1] for s in state(table)) == 2
    assert letters.retry_stored(table, orders, 1, NOW)["recovered"] == 1 and orders.stats()["rows"] == 3


def model_rows(spark, *rows):
    return spark.createDataFrame([(v, NOW, f1, n, 10, "h", "candidate") for v, f1, n in rows], schemas.MODEL_REGISTRY)


def statuses(registry):
    return {r.version: r.status for r in registry.rows().collect()}


def test_model_pointer(spark, tmp_path):
    registry = models.ModelRegistry(spark, str(tmp_path / "models"))
    assert registry.current() is None and registry.rollback() is None and registry.rows() is None
    registry.add(model_rows(spark, ("a", .5, 5000), ("b", .7, 5000), ("c", .6, 5000), ("d", .9, 10)))
    assert [registry.promote(v) for v in "abcd"] == [True, True, False, False] and not registry.promote("unknown")
    assert statuses(registry) == {"a": "archived", "b": "production", "c": "candidate", "d": "candidate"}
    assert registry.rollback() == "a" and registry.rollback("nowhere") == "a"
    assert statuses(registry) == {"a": "production", "b": "archived", "c": "candidate", "d": "candidate"}
    assert registry.rollback("c") == "c" and registry.rollback() == "a"


def test_two_promotions_at_once_leave_one_current(spark, tmp_path):
    registry = models.ModelRegistry(spark, str(tmp_path / "models"))
    names = [f"m{i}" for i in range(4)]
    registry.add(model_rows(spark, *[(n, .5 + i / 10, 5000) for i, n in enumerate(names)]))
    done = {}
    threads = [threading.Thread(target=lambda n=n: done.update({n: models.ModelRegistry(spark, registry.path).promote(n)})) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert registry.current() == "m3" and done["m3"] and sum(s == "production" for s in statuses(registry).values()) == 1
    assert all(statuses(registry)[n] == ("archived" if ok else "candidate") for n, ok in done.items() if n != "m3")


def test_saved_model_is_loaded_through_the_pointer(spark, views, tmp_path):
    from revpulse.operators import baseline, ml

    labelled = ml.label_windows(views.revenue_metrics, views.anomalies, views.as_of, views.days)
    model, _ = ml.train(baseline.engineer_features(labelled), trees=2)
    registry = models.ModelRegistry(spark, str(tmp_path / "models"))
    registry.add(model_rows(spark, ("v1", .5, 5000)), model)
    assert registry.load() is None and registry.promote("v1")
    assert registry.load().getNumTrees == model.getNumTrees and registry.metadata().first()["version"] == "v1"


def test_rollup_moves_forward(spark, tmp_path):
    events = spark.createDataFrame([(c, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), 1.25 * i) for i in range(60) for c in (["a", "b", "c"][:1 + i // 20])],
                                   "category string, event_timestamp timestamp, total_amount double").checkpoint()
    kept = rollup.Rollup(StoredTable(spark, str(tmp_path / "r"), ["category"], buckets=1))
    assert kept.rows() is None
    told = lambda df: sorted(map(tuple, df.collect()))
    now = dt.datetime(2024, 1, 1)
    for minutes in (30, 55, 0, 20, 25, 200, 40, 59, 1, 300):  # also twice at one time, and pauses longer than the span
        now += dt.timedelta(minutes=minutes)
        kept.refresh(events, now)
        assert told(kept.rows()) == told(serving.category_revenue_1h(events.where(F.col("event_timestamp") <= F.lit(now)), now)), minutes
    kept.refresh(events, now - dt.timedelta(hours=3))
    assert kept.as_of() == now
    late = events.withColumn("total_amount", F.col("total_amount") + 1)
    early = rollup.Rollup(StoredTable(spark, str(tmp_path / "e"), ["category"], buckets=1))
    at = dt.datetime(2024, 1, 1, 3)
    early.refresh(events, at)
    early.refresh(late, at, corrected=True)
    assert told(early.rows()) == told(serving.category_revenue_1h(late.where(F.col("event_timestamp") <= F.lit(at)), at))


def test_rollup_step_reads_two_slices(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 1.0) for i in range(600)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "category string, event_timestamp timestamp, total_amount double").coalesce(1).write.parquet(path)
    kept = rollup.Rollup(StoredTable(spark, str(tmp_path / "r"), ["category"], buckets=1))
    events = spark.read.parquet(path)
    kept.refresh(events, dt.datetime(2024, 1, 1, 8))
    seen = []
    step, serving_step = serving.rollup_step, rollup.rollup_step
    rollup.rollup_step = lambda stored, entering, leaving, key: seen.extend([entering.count(), leaving.count()]) or step(stored, entering, leaving, key)
    try:
        kept.refresh(events, dt.datetime(2024, 1, 1, 8, 10))
    finally:
        rollup.rollup_step = serving_step
    assert seen == [10, 10]


def feed(spark, path, n):
    for i in range(n):
        spark.range(3).withColumn("b", F.lit(i)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("id long, b int").option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("fails,stops", [(4, False), (5, True)])
def test_supervision(spark, tmp_path, fails, stops):
    stream = feed(spark, str(tmp_path / "in"), 4)
    left, other = [fails], []

    def sink(batch, batch_id):
        if batch_id == 2 and left[0]:
            left[0] -= 1
            raise ValueError("no luck")

    def start(name, write):
        return lambda: stream.writeStream.foreachBatch(write).queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="0 seconds" if name == "endless" else None, availableNow=None if name == "endless" else True).start()

    log = str(tmp_path / "log")
    with streams.BatchLog(spark, log, ["shaky", "endless"]):
        if stops:
            with pytest.raises(Exception, match="no luck"):
                streams.supervise({"shaky": start("shaky", sink), "endless": start("endless", lambda b, i: other.append(i))}, threshold=5, backoff=0.01)
            assert not spark.streams.active
        else:
            streams.supervise({"shaky": start("shaky", sink)}, threshold=5, backoff=0.3)
    told = [(r.batch_id, r.failed) for r in streams.batch_log(spark, log).where("sink = 'shaky'").orderBy("finished_at").collect()]
    assert told == [(0, False), (1, False), *[(2, True)] * fails, *([] if stops else [(2, False), (3, False)])]
    assert streams.failure_streaks(spark, log) == ({"shaky": 5} if stops else {})
    assert len([f for f in (tmp_path / "log").iterdir() if f.name.startswith("part")]) <= fails + 3  # one file a run, not one a batch


def test_streak_is_carried_over(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), 1)

    def sink(batch, batch_id):
        raise ValueError("still broken")

    tries = []
    start = lambda: tries.append(1) or stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="still broken"):
        streams.supervise({"s": start}, threshold=5, backoff=0.01, streaks={"s": 3})
    assert len(tries) == 2


def test_alert_steps_equal_one_evaluation(spark):
    import random
    rng = random.Random(4)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(s, at(m), rng.random() < .7) for s in ("a", "b", "c") for m in range(120) if rng.random() < .9]
    rows += [("d", at(5), True)]  # never heard of again
    frame = spark.createDataFrame(rows, "label string, at timestamp, breach boolean").checkpoint()
    rule = lambda df: {"x": (df, "10 MINUTES", "2 MINUTES"), "y": (df.withColumn("breach", ~F.col("breach")), "1 MINUTE", "3 MINUTES")}
    prior = None
    for n, (low, high) in enumerate([(0, 10), (10, 11), (11, 60), (60, 60), (60, 100), (100, 120)]):
        part = frame.where((F.col("at") >= F.lit(at(low))) & (F.col("at") < F.lit(at(high))))
        prior = telemetry.alert_step(prior, rule(part)).checkpoint()
        want = telemetry.alert_states(rule(frame.where(F.col("at") < F.lit(at(high)))))
        assert sorted(map(str, prior.drop("breach").collect())) == sorted(map(str, want.collect())), n


def test_archive_of_anomalies_takes_their_reports(spark, tmp_path, monkeypatch):
    day = lambda n: dt.datetime(2024, 1, n)
    make = lambda name, keys, time: StoredTable(spark, str(tmp_path / name), keys, time=time)
    table, archive, reports = make("a", ["window_start"], "detected_at"), make("b", ["window_start"], "detected_at"), make("r", ["anomaly_id", "created_at"], "created_at")
    table.insert(spark.createDataFrame([(f"x{n}", day(n), day(n)) for n in range(1, 9)], "anomaly_id string, detected_at timestamp, window_start timestamp"))
    reports.insert(spark.createDataFrame([(f"x{n}", day(n + 1)) for n in range(1, 9, 2)], "anomaly_id string, created_at timestamp"))
    monkeypatch.setattr(StoredTable, "move_older", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        retention.archive_anomalies(table, archive, reports, "2024-01-05 00:00:00")
    monkeypatch.undo()
    assert lifecycle.orphaned_reports(reports.read(), table.read()).count() == 0
    assert retention.archive_anomalies(table, archive, reports, "2024-01-05 00:00:00") == 4
    assert retention.archive_anomalies(table, archive, reports, "2024-01-05 00:00:00") == 0
    assert {r.anomaly_id for r in archive.read().collect()} == {"x1", "x2", "x3", "x4"} and {r.anomaly_id for r in reports.read().collect()} == {"x5", "x7"}


def test_figures_without_reading_rows(spark, views, tmp_path):
    views.anomalies.write.parquet(str(tmp_path / "a"))
    counts = lifecycle.stored_counts(spark, {"a": str(tmp_path / "a")})
    assert "PushedAggregation: [COUNT(*)]" in counts._jdf.queryExecution().executedPlan().toString() and counts.first()["rows"] == views.anomalies.count()
    assert warehouse.drop_month(spark, str(tmp_path), "2024_01") is False
    table = StoredTable(spark, str(tmp_path / "t"), ["anomaly_id"], time="detected_at")
    table.insert(views.anomalies.checkpoint())
    health = serving.system_health(views.order_events, table.stats()["newest"], views.as_of)
    assert health.collect() == serving.system_health(views.order_events, table.read(), views.as_of).collect()
    assert not any("/t/data/" in f for f in health.inputFiles())


@pytest.mark.parametrize("as_of,hours", [("2024-01-20 13:17:05", (24, 48)), ("2024-01-20 12:00:00", (24, 3)), ("2023-12-01 00:00:00", (24,))])
def test_drift_from_summaries(spark, views, tmp_path, as_of, hours):
    from revpulse.operators import drift

    upto = dt.datetime.fromisoformat(as_of)
    metrics = views.revenue_metrics.where(F.col("window_start") < F.lit(as_of).cast("timestamp_ntz")).checkpoint()
    anomalies = views.anomalies.where(F.col("window_start") < F.lit(as_of).cast("timestamp_ntz")).checkpoint()
    table = StoredTable(spark, str(tmp_path / "s"), ["hour", "measure", "value"], time="hour")
    table.put(drift.summarise(metrics).checkpoint())
    digits = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    names = ["window_hours", "anomaly_rate", "avg_score", "score_std", "psi_revenue", "psi_order_count", "drift_flag", "notes"]
    want = [r for h in hours for r in digits(drift.drift_report(metrics, anomalies, as_of, h).select(*names))]
    stored = table.read()
    stored = spark.createDataFrame([], "hour timestamp_ntz, measure string, value double, n long") if stored is None else stored
    assert digits(drift.drift_reports(stored, metrics, anomalies, upto, hours).select(*names)) == sorted(want)
