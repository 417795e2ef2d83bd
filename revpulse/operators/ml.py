"""Training, evaluation and the model registry."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpulse import fixed, schemas
from revpulse.functions.moments import AsOf, lookback
from revpulse.operators.detect import METRIC_COLUMNS, WINDOW_KEY
from revpulse.sources.warehouse import use_shared_checkpoints


def label_windows(metrics: DataFrame, anomalies: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """Metric windows of the last days with ``is_anomaly``: 1 when an anomaly exists for the
    window that nobody marked as a false positive."""
    recent = lookback(metrics, "window_start", as_of, f"{days} DAYS").select(*METRIC_COLUMNS)
    positive = (
        lookback(anomalies, "window_start", as_of, f"{days} DAYS")
        .where(F.col("status") != "false_positive")
        .select(*WINDOW_KEY, F.lit(1).alias("__hit"))
    )
    labelled = recent.join(positive, WINDOW_KEY, "left")
    return labelled.withColumn("is_anomaly", F.coalesce("__hit", F.lit(0))).drop("__hit")


def feature_vector(features: DataFrame) -> DataFrame:
    numbers = features.withColumns({f"__f_{c}": F.col(c).cast("double") for c in fixed.FEATURES})
    vector = VectorAssembler(inputCols=[f"__f_{c}" for c in fixed.FEATURES], outputCol="features")
    return vector.transform(numbers).drop(*[f"__f_{c}" for c in fixed.FEATURES])


def class_balance(labelled: DataFrame) -> DataFrame:
    """One row: normal and anomalous rows and the weight that evens them out."""
    normal, hit = F.count_if(F.col("is_anomaly") == 0), F.count_if(F.col("is_anomaly") == 1)
    return labelled.agg(
        normal.alias("normal_rows"), hit.alias("anomaly_rows"),
        F.when(hit > 0, normal / hit).otherwise(1.0).alias("positive_weight"),
    )


def split(labelled: DataFrame, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the window key and label, the same share of each class."""
    slot = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in WINDOW_KEY], F.col("is_anomaly"), F.lit(seed)), F.lit(10000))
    in_test = slot < int(test_size * 10000)
    return labelled.where(~in_test), labelled.where(in_test)


def train(
    labelled: DataFrame, *, test_size: float = 0.2, trees: int = 200, depth: int = 5, lr: float = 0.1, seed: int = 42,
) -> tuple[GBTClassificationModel, DataFrame]:
    """(model, predictions on the held-out part with ``label`` and ``prediction``)."""
    use_shared_checkpoints(labelled.sparkSession)
    # Read by the class balance, the training and the evaluation: computed once.
    fit_rows, test_rows = split(labelled.checkpoint(), test_size, seed)
    balance = class_balance(fit_rows).first()
    if not balance.normal_rows or not balance.anomaly_rows:
        raise ValueError("training data must hold both normal and anomalous windows")
    weight = F.when(F.col("is_anomaly") == 1, F.lit(float(balance.positive_weight))).otherwise(F.lit(1.0))
    ready = feature_vector(fit_rows).select(
        "features", F.col("is_anomaly").cast("double").alias("label"), weight.alias("weight")
    )
    booster = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight",
        maxIter=trees, maxDepth=depth, stepSize=lr, seed=seed, checkpointInterval=10,
    )
    model = booster.fit(ready)
    scored = model.transform(feature_vector(test_rows)).withColumn("label", F.col("is_anomaly").cast("double"))
    return model, scored


def area_under_pr(predictions: DataFrame) -> float:
    """Area under the precision-recall curve of scored rows."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    return BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderPR"
    ).evaluate(predictions)


def feature_importances(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(fixed.FEATURES, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from ``label`` and ``prediction``."""
    counts = predictions.groupBy(
        F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")
    ).count()
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("actual"), F.lit(0).cast("bigint").alias("said"),
                 F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(F.lit(0)).alias("both")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("count").alias("said"),
                 F.lit(0).cast("bigint").alias("both")),
    )).alias("r")).select("r.*").groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("said").alias("said"), F.sum("both").alias("both")
    )
    precision = F.coalesce(F.try_divide("both", "said"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("both", "support"), F.lit(0.0))
    return sides.select("class", precision.alias("precision"), recall.alias("recall"), "support").withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    ).select("class", "precision", "recall", "f1", "support")


# --- registry -----------------------------------------------------------------------

def data_fingerprint(df: DataFrame) -> DataFrame:
    """One row with 16 hex digits that do not depend on the order of rows or columns.

    The SHA-256 of each row's text is cut to 60 bits and summed, so any engine can check it.  Times are written to the
    second, fractions with six digits, nulls as a backslash and N.
    """
    def written(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.format_string("%.6f", c.cast("double"))
        return F.coalesce(c.cast("string"), F.lit("\\N"))

    line = F.concat_ws("|", *[written(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    row = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    folded = F.concat_ws(":", F.coalesce(F.sum(row), F.lit(0)).cast("string"), F.count("*").cast("string"))
    return df.agg(F.substring(F.sha2(folded, 256), 1, 16).alias("data_hash"))


def registry_row(version: str, trained_at: AsOf, report: DataFrame, labelled: DataFrame) -> DataFrame:
    """One candidate row for the registry."""
    now = F.lit(str(trained_at)).cast("timestamp")
    return report.where(F.col("class") == 1).select(
        F.lit(version).alias("version"), now.alias("trained_at"), "f1",
        labelled.agg(F.count("*")).scalar().alias("num_samples"),
        labelled.agg(F.count_if(F.col("is_anomaly") == 1)).scalar().alias("num_anomalies"),
        data_fingerprint(labelled).scalar().alias("data_hash"),
        F.lit("candidate").alias("status"),
    )


def promotion_gate(registry: DataFrame, candidate: DataFrame, min_samples: int = 1000) -> DataFrame:
    """The registry with the candidate in it: in production when trained on enough samples of
    both classes and not worse than the current F1, else kept as a candidate.

    The registry holds one row per trained model, so its size follows the number of
    trainings, not the data.
    """
    current = F.coalesce(
        registry.where(F.col("status") == "production").agg(F.max("f1")).scalar(), F.lit(0.0)
    )
    passes = (
        (F.col("num_samples") >= min_samples) & (F.col("num_anomalies") > 0)
        & (F.col("num_anomalies") < F.col("num_samples")) & (F.col("f1") >= current)
    )
    judged = candidate.withColumn("status", F.when(passes, F.lit("production")).otherwise(F.lit("candidate")))
    promoted = judged.agg(F.bool_or(F.col("status") == "production")).scalar()
    kept = registry.withColumn(
        "status", F.when((F.col("status") == "production") & promoted, F.lit("archived")).otherwise(F.col("status"))
    )
    return kept.unionByName(judged)


def rollback(registry: DataFrame, version: str) -> DataFrame:
    """The registry with ``version`` in production and the former one archived; unchanged when
    the version is unknown."""
    known = F.coalesce(registry.agg(F.bool_or(F.col("version") == version)).scalar(), F.lit(False))
    moved = F.when(F.col("version") == version, F.lit("production")).when(
        F.col("status") == "production", F.lit("archived")
    ).otherwise(F.col("status"))
    return registry.withColumn("status", F.when(known, moved).otherwise(F.col("status")))


def model_versions(registry: DataFrame) -> DataFrame:
    """Newest first."""
    return registry.select("version", "f1", "data_hash", "status").orderBy(F.desc("version"))


def save_model(model: GBTClassificationModel, path: str, version: str, metrics: DataFrame) -> None:
    """Model and its metrics under their own version folder; an existing version is an error."""
    model.write().save(f"{path}/{version}/model")
    metrics.coalesce(1).write.mode("errorifexists").json(f"{path}/{version}/metadata")


def load_model(path: str, version: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(f"{path}/{version}/model")


def load_metadata(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.json(f"{path}/{version}/metadata", schema=schemas.MODEL_REGISTRY)
