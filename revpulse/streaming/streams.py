"""The streaming queries and their sinks.

Orders, metric windows, features, anomalies and alerts are stored tables (``sources.keyed``): a micro-batch adds a piece and a version, and
writing it again changes nothing.  Rejected messages go to batch-numbered folders, which a replayed batch replaces.  Errors are not
swallowed; a failed batch stops its query and is replayed on restart.  An empty batch writes nothing.

A sink runs the micro-batch exactly once: as one write, or held in the checkpoint folder for several steps.

The deduplication forgets an id when the watermark has passed it.  An index of all ids, a fixed number of buckets, tells the orders'
sink which accepted events are such late repeats: the newer row replaces the older one, and what the older one added to its metric
window is kept as a correction, so orders, metrics and features agree.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from revpulse import schemas
from revpulse.functions.money import cents, from_cents, mean_of_cents
from revpulse.operators.baseline import engineer_features
from revpulse.operators.detect import WINDOW_KEY, as_anomalies, critical_alerts, rule_anomalies, score_windows
from revpulse.operators.ingest import dedup_events, route_dead_letters, validate_events, with_event_time
from revpulse.operators.windows import KEY, features_from_windows, revenue_metrics
from revpulse.sources.files import Folder
from revpulse.sources.keyed import StoredTable, held
from revpulse.sources.orders import POSITION, parse_order_events, read_order_stream
from revpulse.sources.warehouse import write_batch

METRIC_KEYS = ["window_start", "window_end", *KEY]
FEATURE_KEYS = ["computed_at", *KEY]
_HOUR = dt.timedelta(hours=1)
_STEP = dt.timedelta(minutes=5)


def clean_events(checked_good: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Watermarked and de-duplicated order events."""
    return dedup_events(with_event_time(checked_good, delay))


def _writer(spark: SparkSession, checkpoint_dir: str, name: str) -> str:
    """Who numbers the batches of a query: the id that its checkpoint was given.  A query that starts over with a new checkpoint
    counts from 0 again, and its batches must not be taken for those of the old one."""
    return f"{name}:{json.loads(Folder(spark, f'{checkpoint_dir}/{name}').read('metadata'))['id']}"


def _start(frame: DataFrame, sink, mode: str, name: str, checkpoint_dir: str, trigger: dict) -> StreamingQuery:
    return (
        frame.writeStream.foreachBatch(sink).outputMode(mode).queryName(name)
        .option("checkpointLocation", f"{checkpoint_dir}/{name}").trigger(**trigger).start()
    )


def orders_table(spark: SparkSession, sink_dir: str) -> StoredTable:
    return StoredTable(spark, f"{sink_dir}/order_events", ["event_id"], time="event_timestamp", most_pieces=24)


def ids_table(spark: SparkSession, sink_dir: str) -> StoredTable:
    return StoredTable(spark, f"{sink_dir}/order_ids", ["event_id"], buckets=4)  # all are probed in every batch


def metrics_table(spark: SparkSession, sink_dir: str) -> StoredTable:
    return StoredTable(spark, f"{sink_dir}/revenue_metrics", METRIC_KEYS, time="window_start", most_pieces=16)


def corrections_table(spark: SparkSession, sink_dir: str) -> StoredTable:
    return StoredTable(spark, f"{sink_dir}/metric_corrections", ["event_id", "window_start"], time="window_start")


def features_table(spark: SparkSession, sink_dir: str) -> StoredTable:
    return StoredTable(spark, f"{sink_dir}/feature_store", FEATURE_KEYS, time="computed_at", most_pieces=16)


def anomalies_table(spark: SparkSession, sink_dir: str) -> StoredTable:
    return StoredTable(spark, f"{sink_dir}/anomalies", WINDOW_KEY, time="detected_at")


def alerts_table(spark: SparkSession, sink_dir: str) -> StoredTable:
    return StoredTable(spark, f"{sink_dir}/alerts", ["anomaly_id"], time="detected_at")


def accept_orders(batch: DataFrame, sink_dir: str, batch_id: int, writer: str = "order_events") -> int:
    """Stores one (held) batch of accepted events; returns how many of them replaced an earlier event of their id.

    The commits, in this order, are the id index, the orders, the corrections and the features.  Each remembers the batch, and
    what the later ones need is read from the index's change feed, so a replay after a crash between any two ends in the same tables.
    """
    spark, once = batch.sparkSession, (writer, batch_id)
    ids, orders = ids_table(spark, sink_dir), orders_table(spark, sink_dir)
    ids.upsert(batch.select("event_id", "event_timestamp", *KEY, "order_id", "total_amount"), once=once, feed="updates")
    commit = ids.commit_of(once)
    if commit is None or not commit.updates:
        orders.put(batch, once=once)
        return 0
    replaced = held(ids.changes_of([commit]).where("kind = 'update'").select("before.*", F.col("after.event_timestamp").alias("now")))
    elsewhere = replaced.where(F.to_date("event_timestamp") != F.to_date("now")).select("event_id", "event_timestamp", F.lit(True).alias("__gone"))
    orders.put(batch.withColumn("__gone", F.lit(False)).unionByName(elsewhere, allowMissingColumns=True), once=once)
    frame = F.window("event_timestamp", "5 minutes")
    lost = held(replaced.select("event_id", frame["start"].alias("window_start"), frame["end"].alias("window_end"), *KEY,
                                F.when(F.col("order_id").isNotNull(), 1).otherwise(0).cast("long").alias("orders"), cents("total_amount").alias("cents")))
    corrections_table(spark, sink_dir).upsert(lost, once=once)
    refresh_features(lost, sink_dir)
    return commit.updates


def start_order_events(events: DataFrame, sink_dir: str, checkpoint_dir: str, trigger: dict) -> StreamingQuery:
    """Keeps clean events, one row per id: the one accepted last."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = held(batch.withColumn("ingested_at", F.current_timestamp()))
        if not rows.isEmpty():
            accept_orders(rows, sink_dir, batch_id, _writer(batch.sparkSession, checkpoint_dir, "order_events"))

    return _start(events, sink, "append", "order_events", checkpoint_dir, trigger)


def start_dead_letters(dead: DataFrame, sink_dir: str, checkpoint_dir: str, trigger: dict) -> StreamingQuery:
    """Keeps rejected messages.  Stateless, so it never waits for a watermark."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = held(batch)
        if not rows.isEmpty():
            write_batch(rows, f"{sink_dir}/dlq_events", batch_id)

    return _start(dead, sink, "append", "dlq_events", checkpoint_dir, trigger)


def refresh_features(changed: DataFrame, sink_dir: str) -> None:
    """Feature rows touched by one (held) batch of metric windows.

    A changed window affects the feature rows of the following hour.  They are recomputed
    from the metric table, so no sliding-window state is kept and no event is copied into
    twelve windows.  If another sink refreshes the same days meanwhile, they are computed again from what is stored then.
    """
    spark = changed.sparkSession
    low, high = changed.agg(F.min("window_end"), F.max("window_end")).first()
    if low is None:
        return
    first, last = low - _HOUR - _STEP, high + _HOUR - _STEP
    touched = changed.select(
        F.explode(F.sequence("window_end", F.col("window_end") + F.expr("INTERVAL 55 MINUTES"), F.expr("INTERVAL 5 MINUTES")))
        .alias("computed_at"), *KEY,
    ).distinct()
    table = features_table(spark, sink_dir)

    def attempt(base):
        metrics = current_metrics(spark, sink_dir, lambda day: str(first)[:10] <= day <= str(last)[:10])
        metrics = metrics.where((F.col("window_end") > F.lit(low - _HOUR)) & (F.col("window_end") <= F.lit(last))).join(changed.select(*KEY).distinct(), KEY, "left_semi")
        fresh = features_from_windows(metrics).withColumn("__gone", F.lit(False))
        rows = touched.join(fresh, FEATURE_KEYS, "left").withColumn("__gone", F.col("__gone").isNull())  # no window is left below a row that goes
        return table.put(rows.select(*fresh.columns), base=base)

    table.retry(attempt)


def start_revenue_metrics(
    events: DataFrame, sink_dir: str, checkpoint_dir: str, trigger: dict, feature_hours: int | None = None, purge_every: int = 10,
) -> StreamingQuery:
    """Stores changed 5-minute windows and the feature rows that depend on them; only the days they lie in are read.

    With ``feature_hours`` every ``purge_every`` batches remove feature rows that much older than the newest.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        changed = held(batch)  # the stateful plan runs once
        if not changed.isEmpty():
            metrics_table(batch.sparkSession, sink_dir).put(changed, once=(_writer(batch.sparkSession, checkpoint_dir, "revenue_metrics"), batch_id))
            refresh_features(changed, sink_dir)
        if feature_hours is not None and batch_id % purge_every == purge_every - 1:
            table = features_table(batch.sparkSession, sink_dir)
            newest = metrics_table(batch.sparkSession, sink_dir).stats()["newest"]
            if newest is not None:
                table.move_older(str(dt.datetime.fromisoformat(newest) + _STEP - dt.timedelta(hours=feature_hours)))

    return _start(revenue_metrics(events), sink, "update", "revenue_metrics", checkpoint_dir, trigger)


def grade_windows(closed: DataFrame, sink_dir: str, batch_id: int, model=None, writer: str = "detection") -> None:
    """Grades one (held) batch of closed windows; what is found goes by key into the stored anomalies, critical ones into the alerts."""
    spark, once = closed.sparkSession, (writer, batch_id)
    wide = engineer_features(closed)
    found = held(as_anomalies(rule_anomalies(wide) if model is None else score_windows(model, wide)))
    anomalies_table(spark, sink_dir).insert(found, once=once)
    alerts_table(spark, sink_dir).insert(critical_alerts(found), once=once)


def start_detection(events: DataFrame, sink_dir: str, checkpoint_dir: str, trigger: dict, model=None) -> StreamingQuery:
    """Grades each window once, when the watermark has closed it; a window still filling is not in the output of this query."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        closed = held(batch)
        if not closed.isEmpty():
            grade_windows(closed, sink_dir, batch_id, model, _writer(batch.sparkSession, checkpoint_dir, "detection"))

    return _start(revenue_metrics(events), sink, "append", "detection", checkpoint_dir, trigger)


def run_streams(
    spark: SparkSession, source, sink_dir: str, checkpoint_dir: str, trigger: dict | None = None, *,
    starting: str = "earliest", max_per_trigger: int = 10000, delay: str = "2 minutes",
    feature_hours: int | None = None, purge_every: int = 10, detection: bool = False, model=None,
) -> list[StreamingQuery]:
    """Starts all queries on one source and returns them, each with its own checkpoint.

    ``feature_hours`` and ``purge_every`` set how long and how often old features are purged, see :func:`start_revenue_metrics`; with
    ``detection`` closed windows are graded, by rules or by ``model``.

    ``trigger`` is ``{"availableNow": True}`` to drain the source and stop, or for example
    ``{"processingTime": "10 seconds"}``.  Malformed messages are routed aside before the
    watermark: their event time is null, and null times never expire.
    """
    trigger = trigger or {"processingTime": "10 seconds"}

    def checked() -> tuple[DataFrame, DataFrame]:
        raw = read_order_stream(spark, source, starting=starting, max_per_trigger=max_per_trigger)
        place = [c for c in POSITION if c in raw.columns]
        return route_dead_letters(validate_events(parse_order_events(raw, keep=place)), position=place)

    good, dead = checked()
    events = clean_events(good, delay)
    queries = [
        start_order_events(events, sink_dir, checkpoint_dir, trigger),
        start_revenue_metrics(events, sink_dir, checkpoint_dir, trigger, feature_hours, purge_every),
        start_dead_letters(dead, sink_dir, checkpoint_dir, trigger),
    ]
    if detection:
        queries.append(start_detection(events, sink_dir, checkpoint_dir, trigger, model))
    return queries


def await_streams(queries: Iterable[StreamingQuery], poll: float = 1.0) -> None:
    """Waits until all queries have ended.  The first error in any of them stops the others and is raised, also while
    another would run on for ever."""
    waiting = list(queries)
    while waiting:
        for q in list(waiting):
            try:
                ended = q.awaitTermination(poll / len(waiting))
            except Exception:
                for other in waiting:
                    other.stop()
                raise
            if ended:
                waiting.remove(q)


def _stored(table: StoredTable, schema, parts=None) -> DataFrame:
    rows = table.read(parts)
    return table.spark.createDataFrame([], schema) if rows is None else rows


def current_metrics(spark: SparkSession, sink_dir: str, days: Callable[[str], bool] | None = None) -> DataFrame:
    """Metric windows without what replaced events had added to them; only the days asked for are read."""
    rows = _stored(metrics_table(spark, sink_dir), schemas.REVENUE_METRICS, days)
    lost = corrections_table(spark, sink_dir).read(days)
    if lost is None:
        return rows
    lost = lost.groupBy(*METRIC_KEYS).agg(F.sum("orders").alias("__orders"), F.sum("cents").alias("__cents"))
    orders = F.col("order_count") - F.coalesce("__orders", F.lit(0))
    total = cents("total_revenue") - F.coalesce("__cents", F.lit(0))
    return rows.join(lost, METRIC_KEYS, "left").withColumns({"__left": orders, "__total": total}).where("__left > 0").select(
        *METRIC_KEYS, F.col("__left").alias("order_count"), from_cents("__total").alias("total_revenue"),
        mean_of_cents(F.col("__total"), F.col("__left")).alias("avg_order_value"))


def current_features(spark: SparkSession, sink_dir: str) -> DataFrame:
    return _stored(features_table(spark, sink_dir), schemas.FEATURE_STORE)


def current_orders(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Accepted events, one per id."""
    return _stored(orders_table(spark, sink_dir), schemas.ORDER_EVENTS)


def current_anomalies(spark: SparkSession, sink_dir: str) -> DataFrame:
    return _stored(anomalies_table(spark, sink_dir), schemas.ANOMALIES)


def current_alerts(spark: SparkSession, sink_dir: str) -> DataFrame:
    return _stored(alerts_table(spark, sink_dir), "anomaly_id string, detected_at timestamp, text string")


def supervise(
    starts: Mapping[str, Callable[[], StreamingQuery]], threshold: int = 5, backoff: float = 1.0, longest: float = 60.0,
    streaks: Mapping[str, int] | None = None, poll: float = 0.2,
) -> None:
    """Runs queries until all have ended, restarting one that fails after a pause that doubles with every failure in a row.

    A finished micro-batch ends the streak.  When a streak reaches ``threshold`` all queries are stopped and the last error is raised.
    ``streaks`` carries streaks over from an earlier run, see :func:`failure_streaks`.
    """
    streak = dict.fromkeys(starts, 0) | dict(streaks or {})
    running = {name: start() for name, start in starts.items()}
    due: dict[str, float] = {}
    try:
        while running or due:
            for name in [n for n, at in due.items() if time.monotonic() >= at]:
                del due[name]
                running[name] = starts[name]()
            for name, query in list(running.items()):
                try:
                    ended = query.awaitTermination(poll / len(running))
                    error = None
                except Exception as e:
                    ended, error = True, e
                if any(p.batchId >= 0 and p.batchDuration is not None for p in query.recentProgress):
                    streak[name] = 0
                if not ended:
                    continue
                del running[name]
                if error is not None:
                    streak[name] += 1
                    if streak[name] >= threshold:
                        raise error
                    due[name] = time.monotonic() + min(longest, backoff * 2 ** (streak[name] - 1))
            if not running:
                time.sleep(poll)
    finally:
        for query in running.values():
            query.stop()


def failure_streaks(spark: SparkSession, path: str) -> dict[str, int]:
    """Failures in a row at the end of each sink's batch log; one row per sink."""
    rows = batch_log(spark, path).groupBy("sink").agg(F.max(F.when(~F.col("failed"), F.col("finished_at"))).alias("well"))
    log = batch_log(spark, path).join(rows, "sink").where("failed and (well is null or finished_at > well)")
    return {r["sink"]: r["count"] for r in log.groupBy("sink").count().collect()}


class BatchLog(StreamingQueryListener):
    """Appends a row to the batch-log table for every micro-batch of the queries named, and one for a batch that failed.

    The rows come from Spark's events as they happen and are written ``at_once`` or every ``seconds``, when a query ends, and on leaving.
    A failed batch has no progress event: its number is the one after the last finished batch.  Use as a context manager; leaving
    it waits for the events of ended queries, and fails if they do not come.
    """

    def __init__(self, spark: SparkSession, path: str, names: Iterable[str] = ("order_events", "revenue_metrics", "dlq_events", "detection"),
                 at_once: int = 100, seconds: float = 60.0, patience: float = 60.0):
        self.spark, self.path, self.names = spark, path, set(names)
        self.at_once, self.seconds, self.patience = at_once, seconds, patience
        self.of: dict = {}
        self.last: dict = {}
        self.open: set = set()
        self.rows: list = []
        self.written = time.monotonic()
        self.lock = threading.Lock()

    def __enter__(self) -> BatchLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        until = time.monotonic() + self.patience
        while self.open and time.monotonic() < until:  # the end of a query is told after it has ended
            time.sleep(0.1)
        self.spark.streams.removeListener(self)
        self._flush()
        if self.open:
            raise TimeoutError(f"the end of {sorted(self.of[i] for i in self.open)} was not told within {self.patience} seconds; its last rows are missing")

    def onQueryStarted(self, event) -> None:
        if event.name in self.names:
            self.of[event.runId], self.last[event.runId] = event.name, None
            self.open.add(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.runId not in self.of:
            return
        self.last[p.runId] = p.batchId
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        finished = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")) + dt.timedelta(milliseconds=p.batchDuration)
        self._add(p.name, p.batchId, finished, p.batchDuration, p.numInputRows, late, False)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId not in self.of:
            return
        if event.exception is not None:
            last = self.last[event.runId]
            name = self.of[event.runId]
            if last is None:  # failed at once after a restart: the log knows the batch before
                self._flush()
                known = batch_log(self.spark, self.path).where((F.col("sink") == name) & ~F.col("failed")).agg(F.max("batch_id")).first()[0]
                last = -1 if known is None else known
            self._add(name, last + 1, dt.datetime.now(dt.timezone.utc), None, None, None, True)
        self._flush()
        self.open.discard(event.runId)

    def _add(self, *row) -> None:
        with self.lock:
            self.rows.append(row)
            due = len(self.rows) >= self.at_once or time.monotonic() - self.written >= self.seconds
        if due:
            self._flush()

    def _flush(self) -> None:
        with self.lock:
            rows, self.rows, self.written = self.rows, [], time.monotonic()
        if rows:
            self.spark.createDataFrame(rows, schemas.BATCH_LOG).coalesce(1).write.mode("append").parquet(self.path)


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a :class:`BatchLog` wrote; none before the first."""
    try:
        return spark.read.schema(schemas.BATCH_LOG).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.BATCH_LOG)


def read_anomaly_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New anomaly rows as they are appended, for a live feed."""
    return spark.readStream.schema(schema).parquet(path)
