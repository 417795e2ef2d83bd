"""The streaming tables equal the batch operators on the same accepted events."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from revpulse import schemas
from revpulse.operators.detect import critical_alerts, detection_job
from revpulse.operators.telemetry import consecutive_failures
from revpulse.operators.windows import feature_store, revenue_metrics
from revpulse.sources.keyed import StoredTable, adaptive
from revpulse.streaming import streams

DRAIN = {"availableNow": True}


def message(i, stamp, amount=10.0, **other):
    return json.dumps({
        "event_id": f"e{i}", "event_type": "order_placed", "timestamp": stamp, "order_id": f"o{i}", "product_id": "p",
        "product_name": "n", "category": ["Home", "Apparel"][i % 2], "quantity": 1, "unit_price": amount,
        "total_amount": amount, "region": "Delhi", "payment_method": "credit_card", **other})


def stamp(minute, second=0):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:{second:02d}Z"


class Feed:
    """Writes one file per slice with rising modification times."""

    def __init__(self, folder):
        self.folder, self.n = folder, 0
        folder.mkdir()

    def add(self, *messages):
        path = self.folder / f"slice-{self.n:03d}.json"
        path.write_text("\n".join(messages))
        os.utime(path, (1_700_000_000 + 10 * self.n,) * 2)
        self.n += 1


def run(spark, base):
    with streams.BatchLog(spark, str(base / "log")):
        streams.await_streams(streams.run_streams(spark, str(base / "in"), str(base / "out"), str(base / "cp"), DRAIN, max_per_trigger=1))
    return streams.batch_log(spark, str(base / "log"))


@pytest.fixture
def base(tmp_path):
    return tmp_path


def rows(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


def test_stream_equals_batch_with_duplicates_late_and_bad_messages(spark, base):
    feed = Feed(base / "in")
    feed.add(*[message(i, stamp(i, 3), 10.0 + i) for i in range(0, 30)])
    feed.add(message(29, stamp(29, 3), 39.0), *[message(i, stamp(i), 10.0 + i) for i in range(30, 50)])  # 29 repeats
    feed.add(message(900, "not a time"), message(901, stamp(50), 5.0, total_amount=6.0), "{oops", message(50, stamp(50)))
    feed.add(message(51, stamp(90)))
    feed.add(message(52, stamp(91)))
    feed.add(message(902, stamp(10)), message(53, stamp(92)))  # 902 is far too late
    log = run(spark, base)

    out = str(base / "out")
    accepted = streams.current_orders(spark, out)
    assert {r.event_id for r in accepted.select("event_id").collect()} == {f"e{i}" for i in range(54)}
    metric = ["window_start", "window_end", "category", "region", "order_count", "total_revenue", "avg_order_value"]
    assert rows(streams.current_metrics(spark, out), *metric) == rows(revenue_metrics(accepted), *metric)
    batch = feature_store(accepted)
    assert rows(streams.current_features(spark, out), *batch.columns) == rows(batch, *batch.columns)

    dead = spark.read.parquet(f"{out}/dlq_events")
    assert sorted(r.error.split(",")[0] for r in dead.collect()) == ["amount_mismatch", "malformed", "missing_event_timestamp"]
    late = dict(log.groupBy("sink").agg(F.sum("late_rows")).collect())
    assert late["order_events"] == 1 and late["revenue_metrics"] >= 1
    assert log.where("failed").count() == 0
    health = consecutive_failures(log)
    assert health.count() == log.count() and health.where("not healthy").count() == 0


def test_restart_resumes_where_it_stopped(spark, base):
    feed = Feed(base / "in")
    feed.add(*[message(i, stamp(i)) for i in range(10)])
    run(spark, base)
    feed.add(*[message(i, stamp(i)) for i in range(8, 20)])  # 8 and 9 again
    run(spark, base)
    run(spark, base)  # nothing new
    out = str(base / "out")
    assert streams.current_orders(spark, out).count() == 20
    assert streams.current_metrics(spark, out).agg(F.sum("order_count")).first()[0] == 20


def test_a_new_checkpoint_counts_its_batches_anew(spark, base):
    feed = Feed(base / "in")
    feed.add(*[message(i, stamp(i)) for i in range(5)])
    run(spark, base)
    for name in ("order_events", "revenue_metrics", "dlq_events"):
        shutil.rmtree(base / "cp" / name)
    feed.add(*[message(i, stamp(i)) for i in range(5, 9)])
    run(spark, base)
    assert streams.current_orders(spark, str(base / "out")).count() == 9
    agree(spark, str(base / "out"))


def test_repeat_after_the_watermark_is_counted_once_in_the_table(spark, base):
    feed = Feed(base / "in")
    feed.add(message(1, stamp(0)))
    feed.add(message(2, stamp(60)))
    feed.add(message(3, stamp(61)))
    feed.add(message(1, stamp(62)))  # the dedup state has expired
    run(spark, base)
    out = str(base / "out")
    orders = streams.current_orders(spark, out)
    assert orders.count() == 3 and orders.where("event_id = 'e1'").first().event_timestamp.hour == 1
    agree(spark, out)
    assert streams.current_metrics(spark, out).agg(F.sum("order_count")).first()[0] == 3


METRIC = ["window_start", "window_end", "category", "region", "order_count", "total_revenue", "avg_order_value"]


def agree(spark, out):
    """Metrics and features are those of the accepted orders."""
    accepted = streams.current_orders(spark, out)
    assert rows(streams.current_metrics(spark, out), *METRIC) == rows(revenue_metrics(accepted), *METRIC)
    features = feature_store(accepted)
    assert rows(streams.current_features(spark, out), *features.columns) == rows(features, *features.columns)


def test_late_repeats_move_between_windows_and_days(spark, base):
    """Ids that come again after the watermark, in another window, category and day, some of them twice."""
    feed = Feed(base / "in")
    feed.add(*[message(i, stamp(i % 3), 10.0 + i) for i in range(6)])
    feed.add(message(50, stamp(200)))
    feed.add(message(51, stamp(201)))
    feed.add(message(0, stamp(202), 99.0), message(3, stamp(203), 5.0, category="Toys"), message(52, stamp(1)))  # 52 is too late
    feed.add(message(60, "2024-01-02T03:00:00Z"))
    feed.add(message(61, "2024-01-02T03:01:00Z"))
    feed.add(message(0, "2024-01-02T03:02:00Z", 1.0), message(1, "2024-01-02T03:02:00Z"))
    run(spark, base)
    out = str(base / "out")
    got = {r.event_id: (r.event_timestamp.day, float(r.total_amount)) for r in streams.current_orders(spark, out).collect()}
    assert got == {"e0": (2, 1.0), "e1": (2, 10.0), "e2": (1, 12.0), "e3": (1, 5.0), "e4": (1, 14.0), "e5": (1, 15.0), "e50": (1, 10.0), "e51": (1, 10.0), "e60": (2, 10.0), "e61": (2, 10.0)}
    agree(spark, out)


@pytest.mark.parametrize("after", ["order_ids", "order_events", "metric_corrections", "feature_store"])
def test_crash_between_two_commits_of_a_batch(spark, base, monkeypatch, after):
    """The batch that replaces an event is stopped right after one of its commits, and replayed."""
    out = str(base / "out")
    good = lambda *m: spark.createDataFrame([(x,) for x in m], "value string")

    def events(*messages):
        found = streams.route_dead_letters(streams.validate_events(streams.parse_order_events(good(*messages))))[0]
        return found.withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp")).checkpoint()

    first = events(*[message(i, stamp(i)) for i in range(4)])
    second = events(message(1, "2024-01-03T00:00:00Z", 7.0), message(9, stamp(61)))
    for n, batch in enumerate((first, second)):
        streams.metrics_table(spark, out).put(revenue_metrics(batch))  # what the other query stores
        streams.refresh_features(revenue_metrics(batch).checkpoint(), out)
        if n:
            commit = StoredTable._commit

            def dies(self, *a, **k):
                done = commit(self, *a, **k)
                if self.path.endswith(after):
                    raise RuntimeError("killed")
                return done

            monkeypatch.setattr(StoredTable, "_commit", dies)
            with pytest.raises(RuntimeError):
                streams.accept_orders(batch, out, n)
            monkeypatch.undo()
        streams.accept_orders(batch, out, n)
    agree(spark, out)
    assert streams.current_orders(spark, out).count() == 5
    streams.accept_orders(second, out, 1)
    agree(spark, out)


def test_files_read_by_a_batch_do_not_grow(spark, base):
    """Over 50 batches the pieces that a probe of the id index reads stay bounded."""
    from pyspark.sql import Row
    table = streams.ids_table(spark, str(base / "out"))
    table.buckets, table.most_pieces = 2, 4
    most = []
    for n in range(50):
        table.upsert(spark.createDataFrame([Row(event_id=f"e{n}", x=n), Row(event_id=f"f{n}", x=n), Row(event_id=f"e{n // 2}", x=n)]).checkpoint(), newest=[F.desc("x")], once=("w", n))
        most.append(table.stats()["pieces"])
    assert max(most) <= 2 * 5 and table.read().count() == 100 and table.stats()["rows"] == 100
    assert {r.event_id: r.x for r in table.read().collect()} == {**{f"e{n}": max(2 * n + 1, n) if n < 25 else n for n in range(50)}, **{f"f{n}": n for n in range(50)}}


def test_replayed_batch_changes_nothing(spark, base):
    feed = Feed(base / "in")
    feed.add(*[message(i, stamp(i)) for i in range(10)])
    run(spark, base)
    out = str(base / "out")
    before = rows(streams.current_features(spark, out), "*"), rows(streams.current_metrics(spark, out), "*")
    again = streams.current_metrics(spark, out).checkpoint()
    table = streams.metrics_table(spark, out)
    table.put(again)
    assert table.upsert(again).number == table.version().number  # nothing differs, so there is no commit
    streams.refresh_features(again, out)
    assert (rows(streams.current_features(spark, out), "*"), rows(streams.current_metrics(spark, out), "*")) == before


def test_old_features_are_purged_in_the_stream(spark, base):
    feed = Feed(base / "in")
    for hour in range(0, 30, 3):
        feed.add(message(hour, f"2024-01-0{1 + hour // 24}T{hour % 24:02d}:00:00Z"))
    events = streams.clean_events(streams.route_dead_letters(streams.validate_events(streams.parse_order_events(
        streams.read_order_stream(spark, str(base / "in"), max_per_trigger=1))))[0])
    streams.await_streams([streams.start_revenue_metrics(events, str(base / "out"), str(base / "cp"), DRAIN, feature_hours=2, purge_every=2)])
    times = [r.computed_at.hour + 24 * (r.computed_at.day - 1) for r in streams.current_features(spark, str(base / "out")).collect()]
    assert times and min(times) >= 20
    assert streams.current_metrics(spark, str(base / "out")).count() == 10


def test_retention_through_run_streams(spark, base):
    feed = Feed(base / "in")
    for hour in range(0, 30, 3):
        feed.add(message(hour, f"2024-01-0{1 + hour // 24}T{hour % 24:02d}:00:00Z"))
    streams.await_streams(streams.run_streams(spark, str(base / "in"), str(base / "out"), str(base / "cp"), DRAIN, max_per_trigger=1, feature_hours=2, purge_every=2))
    times = [r.computed_at for r in streams.current_features(spark, str(base / "out")).collect()]
    assert times and min(times).isoformat() >= "2024-01-01T22:00:00"


def test_detection_grades_closed_windows_once(spark, base):
    """Ten micro-batches with late rows: the stored anomalies are those of the batch job on the final closed windows."""
    feed = Feed(base / "in")
    for n in range(9):
        late = [message(1000 + n, stamp(7 * (n - 4) + 1), 400_000.0)] if n > 4 else []  # closed long ago
        feed.add(*[message(100 * n + i, stamp(7 * n + i % 7, i), 10.0 if n % 3 else 90_000.0) for i in range(8)], *late)
    feed.add(message(5000, stamp(64), 500_000.0))  # opens a window that the watermark never closes
    out = str(base / "out")

    def go():
        streams.await_streams(streams.run_streams(spark, str(base / "in"), out, str(base / "cp"), DRAIN, max_per_trigger=1, detection=True))

    go()
    accepted = streams.current_orders(spark, out)
    assert accepted.where("event_id like 'e10__' and total_amount = 400000").count() == 0
    closed = revenue_metrics(accepted).where("window_end <= timestamp'2024-01-01 01:02:00'")  # newest event less two minutes
    nothing = spark.createDataFrame([], schemas.ANOMALIES)
    want = rows(detection_job(closed, nothing, "2024-01-01 01:02:00", minutes=10_000), *schemas.ANOMALIES.names)
    got = rows(streams.current_anomalies(spark, out), *schemas.ANOMALIES.names)
    assert got == want and len(want) > 5
    assert rows(streams.current_alerts(spark, out), "anomaly_id", "text") == rows(critical_alerts(streams.current_anomalies(spark, out)), "anomaly_id", "text")
    assert not any("5000" in str(r) or "01:00:00" in r[2] and r[2] < r[3] and r[2] == "2024-01-01 01:00:00" for r in got)
    ((writer, last),) = streams.anomalies_table(spark, out).version().done.items()
    streams.grade_windows(closed.checkpoint(), out, last, writer=writer)  # the last batch again
    streams.grade_windows(closed.checkpoint(), out, 10_000)  # and all windows in a batch of their own
    assert rows(streams.current_anomalies(spark, out), *schemas.ANOMALIES.names) == want
    go()
    assert rows(streams.current_anomalies(spark, out), *schemas.ANOMALIES.names) == want


def test_empty_batches_write_nothing(spark, base):
    feed = Feed(base / "in")
    feed.add("{oops")
    run(spark, base)
    assert sorted(p.name for p in (base / "out").iterdir()) == ["dlq_events"]
    feed.add(message(1, stamp(1)))
    run(spark, base)
    assert [p.name for p in (base / "out" / "dlq_events").iterdir() if p.name.startswith("batch")] == ["batch_id=0"]


def test_one_failure_stops_the_others(spark, base):
    rate = spark.readStream.format("rate").load()

    def start(name, sink):
        return rate.writeStream.foreachBatch(sink).queryName(name).option("checkpointLocation", str(base / name)).trigger(processingTime="0 seconds").start()

    def broken(batch, batch_id):
        raise ValueError("broken sink")

    queries = [start("endless", lambda batch, batch_id: None), start("broken", broken)]
    with pytest.raises(Exception, match="broken sink"):
        streams.await_streams(queries)
    assert not any(q.isActive for q in queries)


def test_batch_log_counts_on_after_a_restart(spark, base):
    feed = Feed(base / "in")
    feed.add(*[message(i, stamp(i)) for i in range(4)])
    assert [r.batch_id for r in run(spark, base).where("sink = 'dlq_events'").orderBy("batch_id").collect()] == [0]
    feed.add(message(9, stamp(9)))

    def sink(batch, batch_id):
        raise ValueError("broken sink")

    raw = streams.read_order_stream(spark, str(base / "in"))
    with streams.BatchLog(spark, str(base / "log")):
        q = raw.writeStream.foreachBatch(sink).queryName("dlq_events").option("checkpointLocation", str(base / "cp" / "dlq_events")).trigger(**DRAIN).start()
        with pytest.raises(Exception, match="broken sink"):
            q.awaitTermination()
    log = streams.batch_log(spark, str(base / "log")).where("sink = 'dlq_events'").orderBy("batch_id").collect()
    assert [(r.batch_id, r.failed) for r in log] == [(0, False), (1, True)]


def test_anomaly_feed_stream(spark, views, base):
    path = str(base / "anomalies")
    views.anomalies.write.parquet(path)
    feed = streams.read_anomaly_stream(spark, path, views.anomalies.schema)
    q = feed.writeStream.format("memory").queryName("live").trigger(**DRAIN).option("checkpointLocation", str(base / "c")).start()
    q.awaitTermination()
    assert spark.table("live").count() == views.anomalies.count()


def test_a_batch_over_many_days_writes_a_file_a_day(spark, base):
    """A stream's session has adaptive execution off; the pieces are still gathered by day, and the setting stays as it was."""
    feed = Feed(base / "in")
    feed.add(*[message(i, f"2024-01-{1 + i % 20:02d}T{i // 20:02d}:00:00Z") for i in range(200)])
    run(spark, base)
    for name in ("order_events", "revenue_metrics", "feature_store"):
        pieces = [p for p in (base / "out" / name / "data").glob("*/stored_part=*")]
        assert len(pieces) >= 20
        assert [len(list(p.glob("*.parquet"))) for p in pieces] == [1] * len(pieces), name
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(ValueError), adaptive(spark):
            assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
            raise ValueError
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
