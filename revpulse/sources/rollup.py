"""The last-hour rollup per category as a stored table that is moved forward, not computed anew."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.operators.serving import rollup_rows, rollup_step
from revpulse.sources.keyed import StoredTable, held

_AS_OF = "as_of"


class Rollup:
    """Running sums of the last ``span`` in a stored table keyed by ``key``, each row with the time it holds for.

    A refresh adds the events that came into the span and subtracts those that left it, so it reads two slices as long as the step.  Where the
    events change behind that time, late ones or corrections, call it with ``corrected``.
    """

    def __init__(self, table: StoredTable, key: str = "category", span: dt.timedelta = dt.timedelta(hours=1)):
        self.table, self.key, self.span = table, key, span

    def as_of(self, version=None) -> dt.datetime | None:
        sums = self.table.read(version=version)
        return None if sums is None else sums.agg(F.max(_AS_OF)).first()[0]

    def refresh(self, events: DataFrame, now: dt.datetime, corrected: bool = False) -> None:
        """The sums over ``now - span < event_timestamp``, up to and with ``now``.  The first refresh, one after a pause longer than the span, and a
        ``corrected`` one read the whole span; the same or an earlier ``now`` changes nothing otherwise."""
        def attempt(base):
            before = self.as_of(base)
            if before is not None and now <= before and not corrected:
                return base
            between = lambda a, b: events.where((F.col("event_timestamp") > F.lit(a)) & (F.col("event_timestamp") <= F.lit(b)))
            whole = before is None or corrected or now - before >= self.span
            stored = None if whole else self.table.read(version=base)
            entering = between(now - self.span if whole else before, now)
            leaving = events.limit(0) if whole else between(before - self.span, now - self.span)
            sums = rollup_step(stored, entering, leaving, self.key)
            if whole and base is not None:  # keys that have no event any more keep a row with nothing in it
                sums = sums.unionByName(self.table.read(version=base).select(self.key, F.lit(0).cast("long").alias("cents"), F.lit(0).cast("long").alias("orders")))
                sums = sums.groupBy(self.key).agg(F.sum("cents").alias("cents"), F.sum("orders").alias("orders"))
            return self.table.put(held(sums.withColumn(_AS_OF, F.lit(now))), base=base)

        self.table.retry(attempt)

    def rows(self) -> DataFrame | None:
        sums = self.table.read()
        return None if sums is None else rollup_rows(sums, self.key)
