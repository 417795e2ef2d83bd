"""Retention over several stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from revpulse.sources.keyed import DataFrame, StoredTable, held


def archive_anomalies(anomalies: StoredTable, archive: StoredTable, reports: StoredTable, cutoff: str) -> int:
    """Moves the anomalies detected before ``cutoff`` into the archive and takes out their reports; returns how many anomalies went.

    First the archive takes them, then the reports go, then the anomalies: a run that dies in between leaves no report without its
    anomaly, and the next run does the rest.
    """
    base = anomalies.version()
    if base is None:
        return 0
    old = anomalies.read(lambda day: day <= cutoff[:10], base)
    old = held(old.where(F.col("detected_at") < F.lit(cutoff).cast(old.schema["detected_at"].dataType)))
    if old.isEmpty():
        return 0
    archive.insert(old)
    stored = reports.read()
    if stored is not None:
        reports.delete(held(_of(stored, old).select(*{*reports.keys, *([reports.time] if reports.time else [])})))
    return anomalies.move_older(cutoff)


def _of(reports: DataFrame, anomalies: DataFrame) -> DataFrame:
    return reports.join(anomalies.select("anomaly_id"), "anomaly_id", "left_semi")
