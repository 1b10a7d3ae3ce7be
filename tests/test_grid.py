import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import MEAN_MODEL, make_network
from pyspark.sql import functions as F

from climspark import (
    Columns,
    GlobalModelMeta,
    grid_nan_report,
    predict_at_point_daily_with_global_model,
    predict_grid_daily_with_global_model,
    predict_points_daily_with_global_model,
    train_global_rf_target,
)
from climspark.plans.grid import dedupe_grid, normalize_points
from climspark.plans.shards import deal_trees

FOREST = {"n_estimators": 5, "max_depth": 4, "random_state": 42}
SPAN = {"start": "1991-01-01", "end": "1991-01-03"}


@pytest.fixture(scope="module")
def daily(spark):
    return spark.createDataFrame(make_network(days=10, first=dt.date(1991, 1, 1)))


@pytest.fixture(scope="module")
def trained(daily, tmp_path_factory):
    root = tmp_path_factory.mktemp("global")
    paths = {"model_path": f"{root}/model", "meta_path": f"{root}/meta"}
    model, meta, summary = train_global_rf_target(daily, min_rows_per_station=5, rf_params=FOREST, **paths)
    return paths, model, meta, summary


@pytest.fixture(scope="module")
def grid(daily):
    return daily.select("station", "latitude", "longitude", "altitude").distinct()


def test_metadata_by_hand(spark, sparse, tmp_path):
    """Stations 4 and 5 have two values each; station 6 has one and is left out."""
    paths = {"model_path": f"{tmp_path}/forest", "meta_path": f"{tmp_path}/notes"}
    names = Columns(id="gauge", lat="phi", lon="lam", alt="h", target="rain")
    table = sparse.toDF("gauge", "date", "phi", "lam", "h", "rain")
    _, meta, used = train_global_rf_target(
        table, columns=names, start="1999-12-01", end="2000-06-30", min_rows_per_station=2, add_cyclic=False, rf_params=MEAN_MODEL, **paths
    )
    assert [tuple(r) for r in used.collect()] == [(4, 2), (5, 2)]
    assert meta == GlobalModelMeta.load(spark, paths["meta_path"])
    assert meta.columns == names and meta.window == ("1999-12-01", "2000-06-30") and meta.n_train_rows == 4
    assert meta.features == ["phi", "lam", "h", "year", "month", "doy"]
    assert [r["gauge"] for r in meta.stations_used_sorted(spark, paths["meta_path"]).collect()] == [4, 5]
    grid = spark.createDataFrame([(1, 5.0, 6.0, 7.0)], "cell int, a double, b double, c double")
    out = predict_grid_daily_with_global_model(
        grid, columns=Columns(id="cell", lat="a", lon="b", alt="c"), start="2001-01-01", end="2001-01-02", **paths
    )
    assert [tuple(r)[2:] for r in out.collect()] == [(5.0, 6.0, 7.0, 3.0)] * 2


def test_pool_is_not_counted_again(spark, daily, tmp_path, monkeypatch):
    """The count that lays the pool out is that of the stations; rows without a station are in neither."""
    told = []

    def told_pool(pool, *args, count=None, **options):
        told.append((count, pool.count()))
        return real(pool, *args, count=count, **options)

    from climspark.plans import grid as module

    real = module.fit_pool
    monkeypatch.setattr(module, "fit_pool", told_pool)
    lost = daily.withColumn("station", F.when(F.col("station") != 3, F.col("station")))
    paths = {"model_path": f"{tmp_path}/m", "meta_path": f"{tmp_path}/j"}
    for table, rows in ((daily, 30), (lost, 20)):
        _, meta, used = train_global_rf_target(table, min_rows_per_station=5, rf_params=MEAN_MODEL, **paths)
        assert told.pop() == (rows, rows) and meta.n_train_rows == rows and used.count() == rows // 10


def test_station_threshold(spark, daily, tmp_path):
    short = daily.filter("station <> 3 or date <= '1991-01-04'")
    paths = {"model_path": f"{tmp_path}/m", "meta_path": f"{tmp_path}/j"}
    _, meta, _ = train_global_rf_target(short, min_rows_per_station=5, rf_params=MEAN_MODEL, **paths)
    assert meta.n_stations_used == 2 and meta.n_train_rows == 20
    with pytest.raises(ValueError, match="at most 10, wanted 50"):
        train_global_rf_target(short, min_rows_per_station=50, rf_params=MEAN_MODEL, **paths)
    with pytest.raises(ValueError, match="No row has every feature"):
        train_global_rf_target(short, start="2001-01-01", rf_params=MEAN_MODEL, **paths)


def test_grid_prediction(spark, trained, grid, tmp_path):
    paths = trained[0]
    out = predict_grid_daily_with_global_model(grid, **SPAN, **paths)
    assert out.columns == ["station", "date", "latitude", "longitude", "altitude", "y_pred_full"]
    assert out.schema["y_pred_full"].dataType.simpleString() == "float"
    pdf = out.toPandas()
    assert len(pdf) == 9 and np.isfinite(pdf["y_pred_full"]).all()
    written = f"{tmp_path}/grid"
    assert predict_grid_daily_with_global_model(grid, out_path=written, parquet_compression="zstd", **SPAN, **paths) is None
    back = spark.read.parquet(written).toPandas()
    key = ["station", "date"]
    pd.testing.assert_frame_equal(back.sort_values(key, ignore_index=True), pdf.sort_values(key, ignore_index=True))


def test_small_grid_is_spread_over_tasks(spark, trained, grid):
    out = predict_grid_daily_with_global_model(grid, start="1991-01-01", end="1999-12-31", **trained[0])
    per_task = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1


def test_public_names_are_restored(spark, trained, grid):
    names = Columns(id="cell", lat="y", lon="x", alt="z")
    out = predict_grid_daily_with_global_model(grid.toDF("cell", "y", "x", "z"), columns=names, **SPAN, **trained[0])
    assert out.columns == ["cell", "date", "y", "x", "z", "y_pred_full"] and out.count() == 9


def test_grid_checks(spark, trained, grid):
    paths = trained[0]
    predict = lambda g, **o: predict_grid_daily_with_global_model(g, **(SPAN | o), **paths)
    with pytest.raises(ValueError, match="lacks the columns"):
        predict(grid.drop("altitude"))
    with pytest.raises(ValueError, match="no cell"):
        predict(grid.limit(0))
    with pytest.raises(ValueError, match="holds no day"):
        predict(grid, end="1990-01-01")
    holes = grid.withColumn("altitude", F.when(F.col("station") != 2, F.col("altitude")))
    with pytest.raises(ValueError, match="1 grid cells lack"):
        predict(holes)
    assert predict(holes, on_null="drop").count() == 6
    # A complete copy wins over one that lacks a coordinate.
    assert predict(holes.unionByName(grid.filter("station = 2"))).filter("station = 2").count() == 3
    assert predict(grid.unionByName(grid)).count() == 9


def test_trees_are_dealt_by_their_nodes():
    assert deal_trees([(0, 5), (1, 5), (2, 9), (3, 1), (4, 30), (5, 2)], 10) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


@pytest.mark.parametrize("bound", [1, 40])
def test_forest_dealt_over_tasks_predicts_the_same(spark, trained, grid, bound, monkeypatch):
    """Groups of one tree, and of some; several parts; a public name of one's own."""
    monkeypatch.setattr("climspark.plans.shards.predict_by_trees.__defaults__", (4,))
    names = Columns(id="cell", lat="y", lon="x", alt="z")
    run = lambda **o: predict_grid_daily_with_global_model(
        grid.toDF("cell", "y", "x", "z"), columns=names, **SPAN, **trained[0], **o
    )
    whole, dealt = run(), run(nodes_per_task=bound)
    assert dealt.columns == whole.columns and dealt.dtypes == whole.dtypes
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want, got = key(whole), key(dealt)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-6)


def test_forest_dealt_over_tasks_with_covariates_and_gaps(spark, daily, grid, tmp_path):
    """A day without its covariate has no prediction, on either path."""
    wet = F.when(F.col("station") == 2, 1.5).otherwise(F.col("station") * 2.0)
    paths = {"model_path": f"{tmp_path}/m", "meta_path": f"{tmp_path}/j"}
    train_global_rf_target(
        daily.withColumn("wet", wet), min_rows_per_station=5, extra_feature_cols=["wet"], rf_params=FOREST, **paths
    )
    days = daily.select("station", "date", F.when(F.col("date") != dt.date(1991, 1, 2), wet).alias("wet"))
    run = lambda **o: predict_grid_daily_with_global_model(grid, covariates=days, **SPAN, **paths, **o)
    as_map = lambda df: {(r[0], str(r[1])[:10]): r[5] for r in df.collect()}
    want, got = as_map(run()), as_map(run(nodes_per_task=1))
    assert want.keys() == got.keys() and len(got) == 9
    assert sum(v is None for v in got.values()) == 3
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-5) for k, v in want.items())


def test_dedupe_keeps_one_row(spark):
    rows = [(1, 2.0, 1.0, 5.0), (1, 1.0, 9.0, 7.0), (1, 1.0, 9.0, 6.0), (2, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "station int, latitude double, longitude double, altitude double")
    assert sorted(tuple(r) for r in dedupe_grid(df).collect()) == [(1, 1.0, 9.0, 6.0), (2, 0.0, 0.0, 0.0)]


def test_covariates_of_the_grid(spark, daily, grid, tmp_path):
    paths = {"model_path": f"{tmp_path}/m", "meta_path": f"{tmp_path}/j"}
    df = daily.withColumn("wind", F.col("prec") * 2)
    _, meta, _ = train_global_rf_target(
        df, min_rows_per_station=5, rf_params=FOREST, extra_feature_cols=["wind", "absent"], **paths
    )
    assert "wind" in meta.features and "absent" not in meta.features
    with pytest.raises(ValueError, match="lacks model inputs \\['wind'\\]"):
        predict_grid_daily_with_global_model(grid, **SPAN, **paths)
    assert predict_grid_daily_with_global_model(grid.withColumn("wind", F.lit(1.0)), **SPAN, **paths).count() == 9
    table = df.select("station", "date", "wind")
    assert predict_grid_daily_with_global_model(grid, covariates=table, **SPAN, **paths).count() == 9


def test_null_report(spark):
    rows = [(1, 1.0, 2.0, None), (2, float("nan"), 3.0, 4.0)]
    df = spark.createDataFrame(rows, "station int, latitude double, longitude double, altitude double")
    assert tuple(grid_nan_report(df).first()) == (0, 1, 0, 1)
    assert tuple(grid_nan_report(df.drop("longitude")).first()) == (0, 1, None, 1)


@pytest.mark.parametrize(
    "points, ids",
    [
        ([(19.0, -99.0, 2200.0), (20.0, -98.0, 2000.0)], [1, 2]),
        ([(7, 19.0, -99.0, 2200), (9, "20.5", -98.0, 2000.0)], [7, 9]),
        ([("a", 19.0, -99.0, 2200)], ["a"]),
        ((19.0, -99.0, 2200.0), [1]),
        ((5, 19.0, -99.0, 2200.0), [5]),
        (("a", 19.0, -99.0, 2200.0), ["a"]),
        (((19.0, -99.0, 2200.0), (20.0, -98.0, 2000.0)), [1, 2]),
        ({"station": 4, "latitude": 19.0, "longitude": -99.0, "altitude": 1.0}, [4]),
        ([{"station": 4, "latitude": 19.0, "longitude": -99.0, "altitude": 1.0}], [4]),
    ],
)
def test_point_forms(spark, points, ids):
    grid = normalize_points(spark, points)
    assert grid.columns == ["station", "latitude", "longitude", "altitude"]
    assert [r[0] for r in grid.orderBy("station").collect()] == ids
    assert grid.filter("latitude is null").count() == 0


@pytest.mark.parametrize(
    "points, error, text",
    [
        ([], ValueError, "no points"),
        ([(1, 2)], TypeError, "Points come as"),
        ("here", TypeError, "Points come as"),
        ([(1, "x", 2, 3)], ValueError, "no number"),
        ([(1, None, 2, 3)], ValueError, "no number"),
        ([(1, 1, 2, 3), (1, 2, 3, 4)], ValueError, "share an id"),
        ([{"station": 1, "latitude": 2}], ValueError, "lacks"),
    ],
)
def test_point_errors(spark, points, error, text):
    with pytest.raises(error, match=text):
        normalize_points(spark, points)


def test_a_point_is_a_grid_of_one_cell(spark, trained):
    """The same place gives the same days, as a cell, among points and alone."""
    place = {"latitude": 26.0, "longitude": -91.5, "altitude": 500.0}
    span = {"start": "1992-02-27", "end": "1992-03-01"}
    cell = spark.createDataFrame([(12, *place.values())], "station int, latitude double, longitude double, altitude double")
    days = lambda df: [(r["station"], r["date"], r["y_pred_full"]) for r in df.orderBy("station", "date").collect()]
    alone = days(predict_at_point_daily_with_global_model(spark, station=12, **place, **span, **trained[0]))
    assert len(alone) == 4 and alone == days(predict_grid_daily_with_global_model(cell, **span, **trained[0]))
    points = [{"station": 3, **place, "altitude": 90.0}, {"station": 12, **place}]
    among = days(predict_points_daily_with_global_model(spark, points, **span, **trained[0]))
    assert [r for r in among if r[0] == 12] == alone and len(among) == 8
