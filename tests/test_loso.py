import datetime as dt
import warnings

import numpy as np
import pandas as pd
import pytest
from conftest import MEAN_MODEL, make_network
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from climspark import (
    Columns,
    loso_predict_full_series,
    loso_predict_full_series_fast,
    loso_train_predict_station,
    metrics_dict,
)
from climspark.plans.forest import forest_params
from climspark.plans.loso import attach_observed

SMALL = {"n_estimators": 5, "max_depth": 4, "random_state": 1}


def test_observed_days_by_hand(spark, sparse, tmp_path):
    """The pool holds 1, 3 and 11 of the others; of station 4's two days up to New Year's Eve one has a value."""
    out, scores, model, features = loso_train_predict_station(
        sparse,
        4,
        rf_params=MEAN_MODEL,
        end="1999-12-31",
        save_predictions_path=f"{tmp_path}/days.csv",
        save_metrics_path=f"{tmp_path}/scores",
    )
    assert [tuple(r) for r in out.collect()] == [(dt.date(1999, 12, 30), 4, 2.0, 5.0)]
    assert metrics_dict(scores)["daily"] == {"MAE": 3.0, "RMSE": 3.0, "R2": None}
    assert features == ["latitude", "longitude", "altitude", "year", "month", "doy"]
    assert model.stages[0].getInputCols() == features
    assert spark.read.csv(f"{tmp_path}/days.csv", header=True).count() == 1
    stored = spark.read.json(f"{tmp_path}/scores")
    assert {r["grain"] for r in stored.filter("mae = 3.0").collect()} == {"daily", "monthly", "annual"}


def test_pool_is_unclipped_and_excludes_the_station(spark, network):
    out, _, _, _ = loso_train_predict_station(network, 1, rf_params=MEAN_MODEL, start="2000-01-05", end="2000-01-06")
    others = make_network((2, 3))["prec"].mean()
    assert [r["y_pred"] for r in out.collect()] == [pytest.approx(others)] * 2


def test_leaked_rows_join_the_pool(network):
    out, _, _, _ = loso_train_predict_station(network, 1, rf_params=MEAN_MODEL, include_target_pct=100)
    assert out.first()["y_pred"] == pytest.approx(make_network()["prec"].mean())


def test_errors_are_told(spark, network):
    with pytest.raises(ValueError, match="not observed in this window"):
        loso_train_predict_station(network, 1, rf_params=SMALL, start="2010-01-01")
    with pytest.raises(ValueError, match="No row is left to train on"):
        loso_train_predict_station(network.filter("station = 1"), 1, rf_params=SMALL)
    with pytest.raises(ValueError, match="Station 9 does not occur"):
        loso_predict_full_series(network, 9, rf_params=SMALL)
    with pytest.raises(ValueError, match="lacks the columns"):
        loso_predict_full_series(network.drop("altitude"), 1, rf_params=SMALL)
    with pytest.raises(TypeError, match="fast"):
        loso_predict_full_series(network, 1, k_neighbors=2)


def test_full_series_covers_every_day(network, tmp_path):
    series, scores, _, _ = loso_predict_full_series(
        network, 1, start="2000-01-20", end="2000-03-20", rf_params=MEAN_MODEL, save_series_path=str(tmp_path / "s.csv")
    )
    assert series.columns == ["date", "station", "y_pred_full", "y_true"]
    assert series.count() == 61 and series.filter("y_true is not null").count() == 41
    assert metrics_dict(scores)["daily"]["MAE"] is not None
    assert scores.filter("grain = 'daily'").first()["n"] == 41


def test_full_series_with_neighbors_and_training_window(network):
    options = dict(start="2000-01-01", end="2000-02-10", rf_params=MEAN_MODEL, train_start="2000-01-01", train_end="2000-01-10")
    series, _, _, _ = loso_predict_full_series_fast(network, 2, k_neighbors=2, neighbor_map={2: [3, 1], 1: [2]}, **options)
    early = make_network(days=10)
    assert series.count() == 41
    assert series.first()["y_pred_full"] == pytest.approx(early[early.station != 2]["prec"].mean())
    near, _, _, _ = loso_predict_full_series_fast(network, 1, k_neighbors=1, **options)
    assert near.first()["y_pred_full"] == pytest.approx(early[early.station == 2]["prec"].mean())
    with pytest.warns(UserWarning, match="ignored"):
        loso_predict_full_series_fast(network, 2, neighbor_map={2: [1]}, **options)


def test_duplicate_days_multiply(network):
    twice = network.unionByName(network.filter("station = 1"))
    series, _, _, _ = loso_predict_full_series(twice, 1, start="2000-01-01", end="2000-01-31", rf_params=MEAN_MODEL)
    assert series.count() == 62


def test_covariates_come_from_a_table(spark):
    pdf = make_network()
    pdf["WIND"] = pdf["prec"] * 2
    df = spark.createDataFrame(pdf)
    options = dict(start="2000-01-01", end="2000-01-31", rf_params=SMALL, var_cols=["wind"])
    with pytest.raises(ValueError, match="covariates"):
        loso_predict_full_series_fast(df, 1, **options)
    table = df.filter("station = 1").select("station", "date", "WIND")
    with pytest.raises(ValueError, match="more than once"):
        loso_predict_full_series_fast(df, 1, covariates=table.unionByName(table.limit(1)), **options)
    series, _, _, features = loso_predict_full_series_fast(df, 1, covariates=table, **options)
    assert "WIND" in features and series.count() == 31


def test_other_column_names(spark):
    names = Columns("id", "day", "lat", "lon", "elev", "tmin")
    df = spark.createDataFrame(make_network()).toDF("id", "day", "lat", "lon", "elev", "tmin")
    out, _, _, _ = loso_train_predict_station(df, 2, columns=names, rf_params=MEAN_MODEL)
    assert out.columns == ["day", "station", "y_true", "y_pred"] and out.count() == 60
    series, _, _, _ = loso_predict_full_series(df, 2, columns=names, rf_params=MEAN_MODEL, start="2000-01-01", end="2000-01-02")
    assert series.columns == ["day", "station", "y_pred_full", "y_true"] and series.count() == 2


def test_any_spark_regressor_can_be_used(network):
    out, _, model, _ = loso_train_predict_station(network, 1, model=DecisionTreeRegressor(maxDepth=2))
    assert out.count() == 60 and type(model.stages[-1]).__name__ == "DecisionTreeRegressionModel"


def test_one_feature_is_not_all_features(spark):
    assert forest_params({"max_features": 1})["featureSubsetStrategy"] == "1"
    assert forest_params({"max_features": 1.0})["featureSubsetStrategy"] == "all"


def test_other_criteria_are_refused(spark):
    assert "criterion" not in forest_params({"criterion": "squared_error"})
    with pytest.raises(ValueError, match="squared error"):
        forest_params({"criterion": "absolute_error"})


def test_days_without_covariates_keep_a_row(spark):
    pdf = make_network()
    pdf["wind"] = 1.0
    df = spark.createDataFrame(pdf)
    table = df.filter("station = 2 and day(date) % 3 = 0").select("date", "wind")
    series, _, _, _ = loso_predict_full_series_fast(
        df, 1, covariates=table, var_cols="wind", rf_params=MEAN_MODEL, start="2000-01-01", end="2000-01-31"
    )
    rows = series.collect()
    assert len(rows) == 31
    assert {r["date"].day for r in rows if r["y_pred_full"] is not None} == {d for d in range(1, 32) if d % 3 == 0}


def test_observations_are_clipped_at_the_scan(spark, tmp_path):
    make = spark.createDataFrame(make_network(days=400)).withColumn("date", F.to_date("date"))
    make.write.parquet(f"{tmp_path}/obs")
    observed = spark.read.parquet(f"{tmp_path}/obs")
    days = spark.createDataFrame([(dt.date(2000, 6, 1), 1, 2.0)], "date date, station long, y_pred_full double")
    plan = attach_observed(days, observed, Columns(), "2000-06-01", "2000-06-30")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2000-06-01)" in plan and "LessThanOrEqual(date,2000-06-30)" in plan


def test_forest_parameters(spark):
    got = forest_params({"n_estimators": 20, "max_depth": None, "random_state": 3, "n_jobs": -1, "max_features": "sqrt"})
    assert (got["numTrees"], got["maxDepth"], got["seed"], got["featureSubsetStrategy"]) == (20, 30, 3, "sqrt")
    assert forest_params({"max_features": None})["featureSubsetStrategy"] == "all" and got["maxBins"] == 400
    with pytest.warns(UserWarning, match="limit"):
        assert forest_params({"max_depth": 50})["maxDepth"] == 30
    with pytest.raises(ValueError, match="Unknown forest parameter"):
        forest_params({"n_trees": 3})


@pytest.fixture(scope="module")
def planted(spark):
    """A signal of place and season that space and time alone can explain."""
    rng = np.random.default_rng(8)
    rows = []
    for s in range(1, 13):
        lat, lon = 14 + s, -110 + s
        for d in pd.date_range("2000-01-01", "2001-12-31", freq="3D"):
            value = 2 * lat + 10 * np.sin(2 * np.pi * d.dayofyear / 365.25) + rng.normal(scale=0.5)
            rows.append((s, d.date(), float(lat), float(lon), 100.0, float(value)))
    return spark.createDataFrame(rows, "station long, date date, latitude double, longitude double, altitude double, prec double")


def test_forest_learns_a_planted_signal(planted):
    params = {"n_estimators": 10, "max_depth": 8, "random_state": 1}
    out, scores, _, _ = loso_train_predict_station(planted, 6, rf_params=params)
    _, mean_scores, _, _ = loso_train_predict_station(planted, 6, rf_params=MEAN_MODEL)
    assert metrics_dict(scores)["daily"]["RMSE"] < 0.5 * metrics_dict(mean_scores)["daily"]["RMSE"]
    low, high = planted.filter("station <> 6").agg(F.min("prec"), F.max("prec")).first()
    assert out.filter((F.col("y_pred") < low) | (F.col("y_pred") > high)).count() == 0


def test_forest_does_not_depend_on_row_order(planted):
    params = {"n_estimators": 5, "max_depth": 5, "random_state": 7}
    draw = lambda df: {r["date"]: r["y_pred"] for r in loso_train_predict_station(df, 6, rf_params=params)[0].collect()}
    first = draw(planted)
    assert first == draw(planted.repartition(7).orderBy(F.desc("date")))
    assert first != draw_with_seed(planted, 8)


def draw_with_seed(df, seed):
    out, _, _, _ = loso_train_predict_station(df, 6, rf_params={"n_estimators": 5, "max_depth": 5, "random_state": seed})
    return {r["date"]: r["y_pred"] for r in out.collect()}


def test_text_dates_and_nan_targets(spark):
    pdf = make_network()
    pdf.loc[pdf.index[:5], "prec"] = np.nan
    pdf["date"] = pdf["date"].astype(str)
    pdf.loc[pdf.index[5], "date"] = "bad"
    out, _, _, _ = loso_train_predict_station(spark.createDataFrame(pdf), 1, rf_params=MEAN_MODEL)
    assert out.count() == 54 and out.agg(F.min("date")).first()[0] == dt.datetime(2000, 1, 7)
