"""Keyed updates, layout, retention, dead letters, registry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from revpulse import schemas
from revpulse.functions.moments import latest
from revpulse.operators import deadletter, detect, ingest, investigate, lifecycle, ml, serving, tables, telemetry
from revpulse.sources import orders, warehouse

NOW = dt.datetime(2024, 3, 1)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, x string, y int")
    batch = spark.createDataFrame([(2, 21), (2, 22), (3, 30)], "k int, y int")
    once = tables.upsert(target, batch, ["k"], ["y"], newest=[F.desc("y")], defaults={"x": "-"})
    assert sorted(once.collect()) == [(1, "a", 10), (2, "b", 22), (3, "-", 30)]
    again = tables.upsert(once, batch, ["k"], ["y"], newest=[F.desc("y")], defaults={"x": "-"})
    assert sorted(again.collect()) == sorted(once.collect())


def test_upsert_takes_a_null_from_the_batch(spark):
    target = spark.createDataFrame([(1, "a")], "k int, x string")
    batch = spark.createDataFrame([(1, None)], "k int, x string")
    assert tables.upsert(target, batch, ["k"], ["x"], newest=[]).collect() == [(1, None)]


def test_insert_if_absent(spark):
    target = spark.createDataFrame([(1, "old")], "k int, x string")
    batch = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, x string")
    assert tables.insert_if_absent(target, batch, ["k"]).collect() == [(2, "a")]


def test_batches_replay_and_compact(spark, tmp_path):
    path, new = str(tmp_path / "t"), str(tmp_path / "t2")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    warehouse.write_batch(rows((1, 1), (2, 1)), path, 0)
    warehouse.write_batch(rows((2, 2), (3, 2)), path, 1)
    warehouse.write_batch(rows((2, 3)), path, 1)  # the batch is replayed with other rows
    want = [(1, 1), (2, 3)]
    assert sorted(map(tuple, warehouse.read_latest(spark, path, ["k"]).collect())) == want
    warehouse.compact_batches(spark, path, new, ["k"])
    assert sorted(map(tuple, warehouse.read_latest(spark, new, ["k"]).collect())) == want
    assert spark.read.parquet(new).count() == 2
    warehouse.compact_batches(spark, new, str(tmp_path / "t3"), ["k"], keep=F.col("v") >= 2)
    assert [tuple(r) for r in warehouse.read_latest(spark, str(tmp_path / "t3"), ["k"]).collect()] == [(2, 3)]


def test_window_gaps(spark):
    hours = [0, 0, 1, 4]
    metrics = spark.createDataFrame([(NOW + dt.timedelta(hours=h),) for h in hours], "window_start timestamp")
    counts = lambda df: [(r.hour.hour, r.windows) for r in df.orderBy("hour").collect()]
    assert counts(lifecycle.window_gaps(metrics)) == [(0, 2), (1, 1), (4, 1)]
    assert counts(lifecycle.window_gaps(metrics, 4, fill=True)) == [(1, 1), (2, 0), (3, 0), (4, 1)]


def test_monthly_layout_prunes_folders(spark, views, tmp_path):
    path = str(tmp_path / "monthly")
    warehouse.write_monthly(views.order_lines, path)
    stored = spark.read.parquet(path)
    some = warehouse.prune_months(stored, "1997-03-15 00:00:00", "1997-05-02 00:00:00")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "event_month" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r[0] for r in some.select("event_month").distinct().collect()} == {"1997_03", "1997_04", "1997_05"}
    direct = views.order_lines.where("event_timestamp >= '1997-03-15' and event_timestamp < '1997-05-02'")
    assert some.count() == direct.count()
    sizes = lifecycle.partition_bytes(spark, path).agg(F.sum("files"), F.count("*"), F.min("bytes")).first()
    assert sizes[1] == lifecycle.partition_report(stored).count() and sizes[2] > 0


def test_busy_month_is_written_by_many_tasks(spark, views, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "10KB")
    try:
        warehouse.write_monthly(views.order_events.repartition(8), str(tmp_path / "hot"))
    finally:
        spark.conf.set(size, before)
    assert len(list((tmp_path / "hot").glob("event_month=*/*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "hot")).count() == views.order_events.count()


def test_archive_keeps_every_row(spark):
    rows = [(1, NOW), (2, NOW - dt.timedelta(days=90)), (3, NOW - dt.timedelta(days=91)), (4, None)]
    frame = spark.createDataFrame(rows, "i int, event_timestamp timestamp")
    kept, old = lifecycle.archive_events(frame, NOW)
    assert sorted(r.i for r in kept.collect()) == [1, 2, 4] and [r.i for r in old.collect()] == [3]


def test_region_order_is_split_but_kept(spark, views):
    out = orders.partition_by_region(views.order_events).withColumn("p", F.spark_partition_id()).collect()
    assert out == sorted(out, key=lambda r: (r.p, r.region, r.event_timestamp))
    seen = {}
    for r in out:
        assert seen.get(r.region, r.event_timestamp) <= r.event_timestamp
        seen[r.region] = r.event_timestamp


def wire(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


GOOD = ('{"schema_version":1,"event_id":"e1","event_type":"order_placed","timestamp":"2024-01-01T10:00:00.5+00:00","order_id":"o",'
        '"product_id":"p","product_name":"n","category":"Home","quantity":2,"unit_price":9.99,"total_amount":19.98,"region":"Delhi",'
        '"payment_method":"credit_card"}')


def test_routing(spark):
    raw = wire(spark, GOOD, GOOD.replace("19.98", "20.00"), GOOD.replace('"event_id":"e1",', ""), GOOD.replace("2024-01-01T", "x"), "{oops", "")
    good, dead = ingest.route_dead_letters(ingest.validate_events(orders.parse_order_events(raw)), "2024-01-02 00:00:00")
    row = good.first()
    assert good.count() == 1 and str(row.total_amount) == "19.98" and row.event_timestamp == dt.datetime(2024, 1, 1, 10, 0, 0, 500000)
    errors = [r.error for r in dead.collect()]
    assert len(errors) == 5 and sum(e.startswith("malformed") for e in errors) >= 1
    assert {"amount_mismatch", "missing_event_id", "missing_event_timestamp"} <= set(errors)
    assert set(dead.columns) == set(schemas.DLQ_EVENTS.names)


def test_message_is_parsed_once(spark):
    raw = wire(spark, GOOD)
    good, _ = ingest.route_dead_letters(ingest.validate_events(orders.parse_order_events(raw)))
    assert good._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def test_retry(spark):
    letter = lambda i, data, n=0, done=False: (str(i), data, "first", n, NOW, None, done)
    dlq = spark.createDataFrame(
        [letter(1, GOOD), letter(2, "{oops", 3), letter(3, GOOD, 5), letter(4, "{oops", 1, True)], schemas.DLQ_EVENTS)
    recovered, after = deadletter.retry_dead_letters(dlq, "2024-03-02 00:00:00")
    state = {r.dlq_id: (r.resolved, r.retry_count, r.error.split(",")[0]) for r in after.collect()}
    assert state == {"1": (True, 0, "first"), "2": (False, 4, "malformed"), "3": (False, 5, "first"), "4": (True, 1, "first")}
    assert recovered.count() == 1
    assert deadletter.exhausted_dead_letters(after).count() == 1
    row = serving.dlq_stats(after).first()
    assert (row.total, row.pending, row.exhausted) == (4, 2, 1)


def test_registry_gate_and_rollback(spark):
    row = lambda v, f1, status, n=5000, a=100: (v, NOW, f1, n, a, "h", status)
    registry = spark.createDataFrame([row("1", 0.8, "archived"), row("2", 0.9, "production")], schemas.MODEL_REGISTRY)
    status = lambda df: {r.version: r.status for r in df.collect()}
    new = lambda *a: spark.createDataFrame([row(*a)], schemas.MODEL_REGISTRY)
    assert status(ml.promotion_gate(registry, new("3", 0.95, "candidate"))) == {"1": "archived", "2": "archived", "3": "production"}
    assert status(ml.promotion_gate(registry, new("3", 0.85, "candidate")))["3"] == "candidate"
    assert status(ml.promotion_gate(registry, new("3", 0.99, "candidate", 999)))["3"] == "candidate"
    assert status(ml.promotion_gate(registry, new("3", 0.99, "candidate", 5000, 0)))["2"] == "production"
    assert status(ml.promotion_gate(registry.where("false"), new("3", 0.1, "candidate")))["3"] == "production"
    assert status(ml.rollback(registry, "1")) == {"1": "production", "2": "archived"}
    assert status(ml.rollback(registry, "7")) == status(registry)


def test_fingerprint_ignores_order(spark):
    rows = [(i, f"x{i % 7}") for i in range(500)]
    a, b = spark.createDataFrame(rows, "i int, s string"), spark.createDataFrame(rows[::-1], "i int, s string").repartition(7)
    c = spark.createDataFrame([*rows[1:], (9999, "x")], "i int, s string")
    ha, hb, hc = (ml.data_fingerprint(f).first()[0] for f in (a, b, c))
    assert ha == hb != hc and len(ha) == 16


def test_detection_is_idempotent(spark, views):
    none = views.anomalies.where("false")
    first = detect.detection_job(views.revenue_metrics, none, views.as_of, minutes=60 * 24 * 40)
    again = detect.detection_job(views.revenue_metrics, first, views.as_of, minutes=60 * 24 * 40)
    assert first.count() > 0 and again.count() == 0


def test_open_window_is_not_scored(spark):
    rows = [(NOW, NOW + dt.timedelta(minutes=5), "Home", "Delhi", 1, 5.0, 5.0)]
    metrics = spark.createDataFrame(rows, "window_start timestamp, window_end timestamp, category string, region string, "
                                          "order_count bigint, total_revenue double, avg_order_value double")
    none = spark.createDataFrame([], schemas.ANOMALIES)
    at = NOW + dt.timedelta(minutes=2)
    assert detect.unscored_windows(metrics, none, at).count() == 0
    assert detect.unscored_windows(metrics, none, at, closed_only=False).count() == 1


def test_uninvestigated_ignores_reports_without_anomaly(spark, views):
    reports = views.copilot_reports.withColumn("anomaly_id", F.lit(None).cast("string"))
    assert investigate.uninvestigated_anomalies(views.anomalies, reports, None).count() == views.anomalies.where("status = 'open'").count()
    assert lifecycle.orphaned_reports(reports, views.anomalies).count() == 0


def test_page_bounds(spark, views):
    assert serving.page_anomalies(views.anomalies, 100).count() == 100
    for refused in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"offset": serving.MAX_OFFSET + 1}, {"status": "confirmed"}):
        with pytest.raises(ValueError):
            serving.page_anomalies(views.anomalies, **refused)
    with pytest.raises(ValueError):
        serving.kpis_api(views.revenue_metrics, views.anomalies, views.copilot_reports, views.as_of, 1441)


def test_pages_by_key_walk_the_whole_table(views):
    small = views.anomalies.where("category = 'Home'").checkpoint()
    seen, last = [], None
    while rows := serving.page_after(small, "detected_at", "anomaly_id", 30, last).collect():
        seen += [r.anomaly_id for r in rows]
        last = (str(rows[-1].detected_at), rows[-1].anomaly_id)
    want = small.orderBy(F.desc("detected_at"), "anomaly_id").select("anomaly_id").collect()
    assert seen == [r.anomaly_id for r in want]


def test_identical_dead_letters_are_told_apart_by_their_place(spark):
    raw = spark.createDataFrame([("{oops", 0, 1), ("{oops", 0, 2), ("{oops", 0, 2)], "value string, partition int, offset long")
    checked = ingest.validate_events(orders.parse_order_events(raw, keep=orders.POSITION))
    good, dead = ingest.route_dead_letters(checked, position=orders.POSITION)
    assert dead.select("dlq_id").distinct().count() == 2 and not set(orders.POSITION) & {*good.columns, *dead.columns}


def test_a_replayed_batch_leaves_no_month_of_the_failed_attempt(spark, tmp_path):
    path = str(tmp_path / "t")
    months = lambda *m: spark.createDataFrame([(x, 1) for x in m], "event_month string, n int")
    warehouse.write_batch(months("2024_01", "2024_02"), path, 0, ["event_month"])
    warehouse.write_batch(months("2024_03"), path, 1, ["event_month"])
    warehouse.write_batch(months("2024_01"), path, 0, ["event_month"])
    assert sorted(r.event_month for r in spark.read.parquet(path).collect()) == ["2024_01", "2024_03"]


def test_histogram_has_empty_bins(spark):
    import numpy as np

    from revpulse.operators import drift
    values = [0.0] * 50 + [1.0] * 30 + [2.0] * 20
    frame = spark.createDataFrame([(v, s, "k") for v in values for s in ("expected",)], "value double, slice string, g string")
    edges = np.unique(np.percentile(values, np.arange(0, 101, 10)))
    want, _ = np.histogram(values, edges)
    got = {r.bin: r.expected_rows for r in drift.histogram(frame, ["g"]).collect()}
    assert [got[i] for i in range(len(want))] == list(want) and len(got) == len(want) and 0 in got.values()


def test_status_lights_push_their_time_bound(spark, views, tmp_path):
    path = str(tmp_path / "events")
    views.order_events.orderBy("ingested_at").write.parquet(path)
    stored = spark.read.parquet(path)
    for row in (serving.throughput(stored, views.as_of), serving.ingest_latency(stored, as_of=views.as_of)):
        plan = row._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(ingested_at" in plan or "ingested_at" in plan.split("PushedFilters", 1)[1][:400]
    assert serving.ingest_latency(stored, 5, views.as_of, 1).first() == serving.ingest_latency(stored, 5).first()
    late = views.as_of.select((F.col(views.as_of.columns[0]) + F.expr("INTERVAL 9 DAYS")).alias("t"))
    assert serving.throughput(stored, late).first() == (0.0, stored.agg(F.max("ingested_at")).first()[0])


def test_reading_on_walks_the_whole_table(views):
    small = views.anomalies.where("category = 'Home'").checkpoint()
    seen, last = [], None
    while rows := serving.read_since(small, last, 30).collect():
        seen += [r.anomaly_id for r in rows]
        last = (str(rows[-1].detected_at), rows[-1].anomaly_id)
    assert len(seen) == len(set(seen)) == small.count()


def test_histogram_quantile(spark):
    frame = spark.createDataFrame([(x / 10,) for x in range(1, 101)], "v double")
    buckets = telemetry.bucket_histogram(frame, "v", [1.0, 5.0, 8.0])
    assert [r.cumulative for r in buckets.orderBy("le").collect()] == [10, 50, 80, 100]
    assert telemetry.histogram_quantile(buckets, 0.3).first()[0] == pytest.approx(3.0)
    assert telemetry.histogram_quantile(buckets, 0.05).first()[0] == pytest.approx(0.5)
    assert telemetry.histogram_quantile(buckets, 0.99).first()[0] == 8.0


def test_counter_reset(spark):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 1, 2, 3)]
    samples = spark.createDataFrame([("c", "x", t, v) for t, v in zip(at, [10.0, 14.0, 3.0, 5.0])], "name string, label string, ts timestamp, value double")
    assert [r.delta for r in telemetry.counter_deltas(samples).orderBy("ts").collect()] == [4.0, 3.0, 2.0]
    assert telemetry.total_alert(samples, 4).first().breach


def test_breach_must_hold_and_gaps_break_it(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(t(0), True), (t(5), True), (t(10), True), (t(15), False), (t(20), True), (t(30), True), (t(35), True)]
    out = telemetry.sustained_breach(spark.createDataFrame(rows, "window_start timestamp, breach boolean"), "10 MINUTES")
    assert [r.firing for r in out.orderBy("window_start").collect()] == [False, False, True, False, False, False, False]


def test_latest(views):
    assert latest(views.order_events, "event_timestamp").first()[0] == views.as_of.first()[0]


def test_kafka_options():
    dev, prod = orders.kafka_options("h:1"), orders.kafka_options("h:1", env=" Production ")
    assert (dev["startingOffsets"], dev["failOnDataLoss"]) == ("earliest", "false")
    assert (prod["startingOffsets"], prod["failOnDataLoss"], prod["maxOffsetsPerTrigger"]) == ("latest", "true", "10000")
