"""Training data, model, registry on disk."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import grids
from revpulse.operators import baseline, detect, ml
from revpulse.sources import warehouse


@pytest.fixture(scope="module")
def grid(spark):
    return grids.build_training_grid(spark, days=2, seed=7).cache()


@pytest.fixture(scope="module")
def trained(grid):
    ready = grid.withColumns({
        "category_enc": baseline.seasonal.category_code(F.col("category")),
        "region_enc": baseline.seasonal.region_code(F.col("region")),
    })
    return ml.train(ready, trees=8)


def test_grid(grid):
    row = grid.agg(
        F.count("*").alias("n"), F.avg("is_anomaly").alias("rate"), F.min("order_count").alias("least"),
        F.max(F.when(F.col("is_anomaly") == 0, F.abs(F.col("total_revenue") / F.col("expected_revenue") - 1))).alias("noise"),
    ).first()
    assert row.n == 2 * 288 * 25 and abs(row.rate - 0.05) < 0.01 and row.least >= 1 and row.noise < 0.16
    drops = grid.where("is_anomaly = 1 and total_revenue < expected_revenue").count() / grid.where("is_anomaly = 1").count()
    assert abs(drops - 0.7) < 0.06


def test_grid_is_repeatable(spark, grid):
    assert ml.data_fingerprint(grids.build_training_grid(spark, days=2, seed=7).repartition(3)).first() == ml.data_fingerprint(grid).first()


def test_split_keeps_class_shares(grid):
    fit, test = ml.split(grid)
    assert fit.count() + test.count() == grid.count()
    share = grid.where("is_anomaly = 1").count()
    assert abs(test.where("is_anomaly = 1").count() / share - 0.2) < 0.05


def test_model_finds_anomalies(trained):
    model, scored = trained
    report = {r["class"]: r for r in ml.classification_report(scored).collect()}
    assert report[1].f1 > 0.9 and report[0].f1 > 0.95
    assert ml.area_under_pr(scored) > 0.9


def test_model_roundtrip_and_scoring(spark, trained, tmp_path):
    model, scored = trained
    report = ml.classification_report(scored)
    row = ml.registry_row("20240101_000000", "2024-01-01 00:00:00", report, scored.select("window_start", "is_anomaly"))
    ml.save_model(model, str(tmp_path), "20240101_000000", row)
    assert ml.load_metadata(spark, str(tmp_path), "20240101_000000").first().f1 == pytest.approx(row.first().f1)
    loaded = ml.load_model(str(tmp_path), "20240101_000000")
    start = dt.datetime(2026, 3, 6, 12)
    rows = [(start, start, "Electronics", "Delhi", 10, 50.0, 5.0), (start, start, "Electronics", "Karnataka", 5, 676.2, 135.24)]
    metrics = spark.createDataFrame(rows, "window_start timestamp, window_end timestamp, category string, region string, "
                                          "order_count bigint, total_revenue double, avg_order_value double")
    out = detect.score_windows(loaded, baseline.engineer_features(metrics)).collect()
    assert [r.region for r in out] == ["Delhi"]
    assert out[0].severity == "critical" and 0.5 < out[0].anomaly_score <= 1.0
    assert ml.feature_importances(spark, loaded).count() == 9


def test_one_class_is_refused(grid):
    with pytest.raises(ValueError):
        ml.train(grid.where("is_anomaly = 0").withColumns({"category_enc": F.lit(0), "region_enc": F.lit(0)}), trees=1)


def test_csv_roundtrip(spark, grid, tmp_path):
    path = str(tmp_path / "csv")
    warehouse.write_training_csv(grid, path)
    back = warehouse.read_training_csv(spark, path)
    assert back.count() == grid.count() and back.agg(F.sum("is_anomaly")).first() == grid.agg(F.sum("is_anomaly")).first()
    assert back.where(F.col("window_start").isNull()).count() == 0
