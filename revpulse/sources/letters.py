"""The dead-letter loop on stored tables: letters that are good by now move to the orders, the others wait or give up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse import fixed
from revpulse.functions.moments import AsOf
from revpulse.operators import deadletter
from revpulse.sources.keyed import StoredTable, held


def store_letters(table: StoredTable, letters: DataFrame, once: tuple[str, int] | None = None) -> None:
    """Adds letters that are not known; of equal ones the first failure counts."""
    table.insert(held(letters), first=[F.asc("first_failed")], once=once)


def retry_stored(letters: StoredTable, orders: StoredTable, batch_id: int, as_of: AsOf, *, n: int | None = None,
                 max_retries: int = fixed.MAX_RETRIES, writer: str = "dlq_retry") -> dict[str, int]:
    """One round over the pending letters, or the ``n`` oldest: recovered events go to ``orders``, then the letters are updated.

    Both tables remember the batch.  A letter is resolved only if its event is in ``orders`` when the letters are written; so after a crash
    between the two, the same call stores no event twice and resolves those that have landed, and a letter that came in
    meanwhile stays pending.  Calling it again for a finished batch does nothing.
    """
    once = (writer, batch_id)
    base = letters.version()
    if base is None or letters._known(once, base):
        return {"recovered": 0, "kept": 0}
    stored = letters.read(version=base)
    asked = deadletter.pending(stored, max_retries) if n is None else deadletter.dlq_retry_batch(stored, n, max_retries)
    judged = held(deadletter.judged(asked, as_of, max_retries))
    events = judged.where("good").select("event.*")
    orders.insert(held(events.withColumn("ingested_at", F.current_timestamp())), once=once)
    there = orders.read([r[0] for r in events.select(orders.part()).distinct().collect()])
    landed = events.select("event_id").distinct().join(there.select("event_id").distinct(), "event_id", "left_semi").withColumn("__landed", F.lit(True)) if there is not None else None
    after = judged.select("after.*", F.col("event.event_id").alias("__id"), "good")
    if landed is not None:
        after = after.join(landed, after["__id"] == landed["event_id"], "left").drop("event_id")
    else:
        after = after.withColumn("__landed", F.lit(None).cast("boolean"))
    after = held(after.where(~F.col("good") | F.col("__landed")).drop("__id", "__landed"))  # good ones that have not landed wait for the next round
    told = {r["good"]: r["count"] for r in after.groupBy("good").count().collect()}
    letters.upsert(after.drop("good"), ["error", "retry_count", "last_retried", "resolved"], once=once)
    return {"recovered": told.get(True, 0), "kept": told.get(False, 0)}
