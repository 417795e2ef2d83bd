"""The model registry as stored tables: one row per trained model, and one pointer to the one in production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpulse.operators import ml
from revpulse.sources.keyed import Conflict, StoredTable, Version, held

_POINTER = "name string, version string, former string"
_NAME = "production"


class ModelRegistry:
    """Models by version, and a pointer that is moved by compare-and-set: of two promotions at once the second is judged again against the
    first, so there is always one current model, and the one before it is known."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.models = StoredTable(spark, f"{path}/registry", ["version"], buckets=1)
        self.pointer = StoredTable(spark, f"{path}/pointer", ["name"], buckets=1)

    def add(self, rows: DataFrame, model=None) -> None:
        """Registers candidates (see ``ml.registry_row``).  A version that is there already stays as it is; ``model`` is saved beside it, before
        its row, so a registered version can be loaded."""
        rows = held(rows.withColumn("status", F.lit("candidate")))
        if model is not None:
            version = rows.first()["version"]
            ml.save_model(model, f"{self.path}/models", version, rows)
        self.models.insert(rows)

    def _at(self, base: Version | None):
        return self.pointer.read(version=base).first() if base else None

    def current(self) -> str | None:
        """The version in production, None before the first promotion."""
        now = self._at(self.pointer.version())
        return now["version"] if now else None

    def _move(self, base: Version | None, version: str) -> None:
        now = self._at(base)
        row = self.spark.createDataFrame([(_NAME, version, now["version"] if now else None)], _POINTER)
        self.pointer.change(base, row, lambda old, new: self.pointer._images(old, new, None, {}), feed=True)

    def promote(self, version: str, min_samples: int = 1000) -> bool:
        """Puts a registered version into production if the gate lets it pass; returns whether it did."""
        for _ in range(20):
            base = self.pointer.version()
            now, rows = self._at(base), self.models.read()
            former = rows.where(F.col("version") == (now["version"] if now else "")).withColumn("status", F.lit("production"))
            judged = ml.promotion_gate(former, rows.where(F.col("version") == version), min_samples).where(F.col("version") == version).first()
            if judged is None or judged["status"] != "production":
                return False
            if now and now["version"] == version:
                return True
            try:
                self._move(base, version)
                return True
            except Conflict:
                continue
        raise Conflict(f"{self.path}: the pointer keeps moving")

    def rollback(self, version: str | None = None) -> str | None:
        """Points to ``version``, by default to the one before the current; returns the current version afterwards.  An unknown version
        changes nothing."""
        base = self.pointer.version()
        now = self._at(base)
        wanted = version or (now["former"] if now else None)
        if wanted is None or self.models.read() is None or self.models.read().where(F.col("version") == wanted).isEmpty():
            return now["version"] if now else None
        if now is None or now["version"] != wanted:
            self._move(base, wanted)
        return wanted

    def rows(self) -> DataFrame:
        """The registry with each model's status: in production, archived (it once was), or candidate."""
        changes = self.pointer.changes()
        models = self.models.read()
        if changes is None or models is None:
            return models
        ever = changes.select(F.col("after.version").alias("version")).distinct().withColumn("__ever", F.lit(True))
        status = F.when(F.col("version") == self.current(), "production").when(F.col("__ever"), "archived").otherwise("candidate")
        return models.join(ever, "version", "left").withColumn("status", status).drop("__ever")

    def load(self):
        """The model in production."""
        version = self.current()
        return None if version is None else ml.load_model(f"{self.path}/models", version)

    def metadata(self) -> DataFrame:
        """What was saved with it."""
        version = self.current()
        return ml.load_metadata(self.spark, f"{self.path}/models", version) if version else self.spark.createDataFrame([], T.StructType([]))
