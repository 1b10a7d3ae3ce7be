import numpy as np
import pandas as pd
import pytest
from conftest import MEAN_MODEL, make_network
from pyspark.sql import functions as F

from climspark import (
    Columns,
    evaluate_all_stations,
    evaluate_all_stations_fast,
    export_full_series_batch,
    export_full_series_station,
    loso_predict_full_series_fast,
    loso_train_predict_station,
    metrics_dict,
    widen_scores,
)
from climspark.operators.scoring import SCORE_COLUMNS
from climspark.sources import staging
from climspark.sources.staging import BUCKET, stage_features

SCOREBOARD = ["station", "n_rows", "seconds", *SCORE_COLUMNS, "include_target_pct", "latitude", "longitude", "altitude", "error"]


def test_scoreboard_by_hand(spark, sparse, tmp_path):
    """In December and January, station 4 has 2 and 6, station 5 has 1 and station 6 has 11."""
    path = f"{tmp_path}/board.csv"
    table = evaluate_all_stations_fast(
        sparse, end="2000-01-31", rf_params=MEAN_MODEL, include_target_pct=50, save_table_path=path
    )
    assert table.columns == SCOREBOARD
    rows = {r["station"]: r for r in table.collect()}
    assert {s: r["n_rows"] for s, r in rows.items()} == {4: 2, 5: 1, 6: 1}
    # Half of a station's rows, rounded up, joins its pool: 20 / 4 and 20 / 4 in two of the cases.
    assert rows[5]["MAE_d"] == pytest.approx(abs(1 - 20 / 4)) and rows[6]["MAE_d"] == pytest.approx(abs(11 - 20 / 4))
    assert rows[4]["MAE_d"] in (pytest.approx((abs(2 - 14 / 3) + abs(6 - 14 / 3)) / 2), pytest.approx(2.0))
    assert (rows[6]["latitude"], rows[6]["altitude"]) == (19.0, 9.0) and rows[4]["R2_d"] is not None
    assert spark.read.csv(path, header=True).count() == 3


def test_broken_off_run_goes_on_from_its_log(spark, network, tmp_path, monkeypatch):
    from climspark.plans import many

    fitted = []
    own = many.fit_pool
    monkeypatch.setattr(many, "fit_pool", lambda *a, **o: fitted.append(1) or own(*a, **o))
    options = dict(rf_params=MEAN_MODEL, start="2000-01-01", end="2000-12-31", log_csv=f"{tmp_path}/log.csv", flush_every=1)
    evaluate_all_stations_fast(network, station_ids=[1, 3], **options)
    table = evaluate_all_stations_fast(network, station_ids=[1, 2, 3], **options)
    assert len(fitted) == 3
    whole = evaluate_all_stations_fast(network, station_ids=[1, 2, 3], **options | {"log_csv": None})
    scores = lambda t: [tuple(r) for r in t.select("station", "n_rows", F.round("MAE_d", 9)).collect()]
    assert scores(table) == scores(whole)
    assert spark.read.csv(f"{tmp_path}/log.csv", header=True).count() == 3
    # Scores of other models are not gone on from.
    for other in ({"k_neighbors": 2}, {"rf_params": MEAN_MODEL | {"random_state": 1}}, {"end": "2000-06-30"}):
        with pytest.raises(ValueError, match="other options"):
            evaluate_all_stations_fast(network, station_ids=[1, 2], **options | other)


def test_a_failure_of_all_is_raised(network):
    class Broken:
        def copy(self):
            raise RuntimeError("the cluster is lost")

    with pytest.raises(RuntimeError, match="cluster is lost"):
        evaluate_all_stations_fast(network, model=Broken())


@pytest.mark.parametrize("k, pct", [(None, 0.0), (None, 30.0), (2, 0.0), (2, 30.0)])
def test_one_pool_and_seed_make_one_forest(spark, k, pct):
    """The same forest from the one-station plan and from both plans for many stations."""
    forest = {"n_estimators": 5, "max_depth": 5, "random_state": 7}
    df = spark.createDataFrame(make_network((1, 2, 3, 4), 120, skip=3))
    leak = dict(include_target_pct=pct, include_target_seed=5)
    fast = evaluate_all_stations_fast(df, rf_params=forest, k_neighbors=k, **leak).filter("station = 3").first()
    series, scores, _, _ = loso_predict_full_series_fast(
        df, 3, rf_params=forest, k_neighbors=k, start="2000-01-01", end="2000-04-29", **leak
    )
    assert fast["RMSE_d"] == pytest.approx(metrics_dict(scores)["daily"]["RMSE"], rel=1e-9)
    if k is None:
        plain = evaluate_all_stations(df, rf_params=forest, **leak).filter("station = 3").first()
        _, scores, _, _ = loso_train_predict_station(df, 3, rf_params=forest, **leak)
        assert plain["RMSE_d"] == pytest.approx(fast["RMSE_d"], rel=1e-9)
        assert metrics_dict(scores)["daily"]["RMSE"] == pytest.approx(fast["RMSE_d"], rel=1e-9)


def test_forest_does_not_depend_on_the_session(spark):
    forest = {"n_estimators": 5, "max_depth": 5, "random_state": 7}
    df = spark.createDataFrame(make_network((1, 2, 3, 4), 120, skip=3))
    draw = lambda: [r["y_pred"] for r in loso_train_predict_station(df, 2, rf_params=forest)[0].orderBy("date").collect()]
    first = draw()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert draw() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scores_of_several_series_are_no_dict(spark):
    schema = "station long, grain string, n long, mae double, rmse double, r2 double"
    scores = spark.createDataFrame([(s, "daily", 1, 1.0, 1.0, None) for s in (1, 2)], schema)
    with pytest.raises(ValueError, match="several series"):
        metrics_dict(scores)
    assert metrics_dict(scores.filter("station = 1"))["daily"]["MAE"] == 1.0


def test_stations_without_rows_keep_a_row(network):
    rows = evaluate_all_stations_fast(
        network, station_ids=[1, 77], rf_params=MEAN_MODEL, end="2000-12-31", k_neighbors=1, neighbor_map={77: [1]}
    ).collect()
    assert [(r["station"], r["n_rows"]) for r in rows] == [(1, 0), (77, 0)]
    assert "No row is left to train on" in rows[0]["error"] and "not observed" in rows[1]["error"]
    assert rows[0]["RMSE_d"] is None and rows[0]["latitude"] is not None and rows[1]["latitude"] is None


def test_neighbor_pools_and_leak(network):
    options = dict(rf_params=MEAN_MODEL, start="2000-01-01", end="2000-12-31", station_ids=[1])
    near = evaluate_all_stations_fast(network, k_neighbors=1, **options).first()
    pdf = make_network()
    truth = pdf[pdf.station == 1]["prec"]
    assert near["MAE_d"] == pytest.approx((truth - pdf[pdf.station == 2]["prec"].mean()).abs().mean())
    leaked = evaluate_all_stations_fast(network, include_target_pct=100, **options).first()
    assert leaked["MAE_d"] == pytest.approx((truth - pdf["prec"].mean()).abs().mean())
    assert leaked["include_target_pct"] == 100


def test_covariate_by_name(spark):
    pdf = make_network()
    pdf["Wind"] = 1.0
    pdf.loc[pdf.station == 1, "Wind"] = np.nan
    rows = evaluate_all_stations_fast(spark.createDataFrame(pdf), var_col="WIND", rf_params=MEAN_MODEL).collect()
    assert [r["n_rows"] for r in rows] == [0, 60, 60]


def test_plain_evaluation_sorts_and_agrees_with_one_station(network):
    table = evaluate_all_stations(network, rf_params=MEAN_MODEL, start="2000-01-01", end="2000-01-31", order_by=("MAE_d", False))
    rows = table.collect()
    assert table.columns == ["station", "n_rows", *SCORE_COLUMNS, "error"]
    assert [r["MAE_d"] for r in rows] == sorted((r["MAE_d"] for r in rows), reverse=True)
    _, scores, _, _ = loso_train_predict_station(network, 3, rf_params=MEAN_MODEL, start="2000-01-01", end="2000-01-31")
    one = widen_scores(scores).first()
    many = next(r for r in rows if r["station"] == 3)
    assert all(many[c] == pytest.approx(one[c]) if one[c] is not None else many[c] is None for c in SCORE_COLUMNS)
    assert evaluate_all_stations(network, rf_params=MEAN_MODEL, start="2010-01-01", order_by=("nope", True)).filter("n_rows = 0").count() == 3


def test_export_of_one_station(spark, network, tmp_path):
    series, scores, path = export_full_series_station(
        network,
        1,
        out_dir=str(tmp_path),
        rf_params=MEAN_MODEL,
        start="2000-01-01",
        end="2000-02-09",
        save_metrics_path=str(tmp_path / "metrics"),
    )
    assert path.endswith("loso_fullseries_1_20000101_20000209.parquet") and spark.read.parquet(path).count() == 40
    assert {r["grain"] for r in spark.read.json(str(tmp_path / "metrics")).collect()} == {"daily", "monthly", "annual"}
    near, _, path = export_full_series_station(
        network, 1, out_dir=str(tmp_path), rf_params=MEAN_MODEL, start="2000-01-01", end="2000-02-09", k_neighbors=1, file_format="csv"
    )
    assert path.endswith(".csv") and near.first()["y_pred_full"] == pytest.approx(make_network((2,))["prec"].mean())
    with pytest.raises(ValueError, match="file_format"):
        export_full_series_station(network, 1, out_dir=str(tmp_path), file_format="xlsx")


@pytest.mark.parametrize("schema, form", [("input_like", "csv"), ("compact", "parquet")])
def test_filled_series_by_hand(spark, sparse, tmp_path, schema, form):
    """Trained before 2000, station 5 is filled with the mean of station 4's only value of 1999, station 4 with 1."""
    manifest = export_full_series_batch(
        sparse,
        station_ids=[4, 5, 30],
        out_dir=f"{tmp_path}/out",
        rf_params=MEAN_MODEL,
        start="1999-12-29",
        end="2000-01-02",
        train_end="1999-12-31",
        file_format=form,
        combine_output_path=f"{tmp_path}/all",
        combine_format=form,
        combine_schema=schema,
    )
    rows = {r["station"]: r for r in manifest.collect()}
    assert rows[4]["coverage_pct"] == pytest.approx(40) and rows[5]["coverage_pct"] == pytest.approx(20)
    assert rows[30]["path"] is None and "does not occur" in rows[30]["error"]
    combined = spark.read.format(form).option("header", True).load(f"{tmp_path}/all")
    shape = {"input_like": ["station", "latitude", "longitude", "altitude", "date", "prec"],
             "compact": ["station", "y_pred_full", "y_true", "date", "prec"]}
    assert combined.columns == shape[schema]
    found = {(int(r["station"]), str(r["date"])[8:10]): float(r["prec"]) for r in combined.collect()}
    assert found == {
        **{(4, d): v for d, v in zip(("29", "30", "31", "01", "02"), (1.0, 2.0, 1.0, 6.0, 1.0))},
        **{(5, d): v for d, v in zip(("29", "30", "31", "01", "02"), (2.0, 2.0, 1.0, 2.0, 2.0))},
    }
    one = spark.read.format(form).option("header", True).load(rows[5]["path"])
    assert one.count() == 5


def test_export_of_no_known_station(network, tmp_path):
    manifest = export_full_series_batch(
        network, station_ids=[77], out_dir=str(tmp_path), rf_params=MEAN_MODEL, start="2000-01-01", end="2000-01-05",
        combine_output_path=str(tmp_path / "c.csv"), manifest_path=str(tmp_path / "m.csv"),
    ).collect()
    assert len(manifest) == 1 and manifest[0]["error"] and manifest[0]["coverage_pct"] is None


def test_export_arguments(network, tmp_path):
    with pytest.raises(ValueError, match="combine_schema"):
        export_full_series_batch(network, out_dir=str(tmp_path), combine_schema="wide")
    with pytest.raises(ValueError, match="holds no day"):
        export_full_series_batch(network, out_dir=str(tmp_path), start="2001-01-01", end="2000-01-01")


def test_staged_layout_splits_a_hot_station(spark, monkeypatch):
    """A third of the rows belong to one station; no task may hold them all."""
    monkeypatch.setattr(staging, "TASKS_PER_BUCKET", 2)
    pdf = pd.concat([make_network((1,), 400), make_network(tuple(range(2, 42)), 20)])
    names = Columns()
    staged = stage_features(spark.createDataFrame(pdf), names, ["latitude"], rows_per_task=100)
    assert staged.buckets == 6 and staged.frame.count() == len(pdf)
    per_file = staged.frame.groupBy(F.input_file_name(), "station").count().filter("station = 1").collect()
    assert len(per_file) >= 3 and max(r["count"] for r in per_file) < 250
    picked = staged.rows_of([1, 5])
    assert picked.count() == 420
    read = picked.select(F.col(BUCKET)).distinct().count()
    assert read <= 2
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"{BUCKET}#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    again = stage_features(spark.createDataFrame(pdf.sample(frac=1, random_state=3)), names, ["latitude"], rows_per_task=100)
    sizes = lambda s: sorted(r["count"] for r in s.frame.groupBy(F.input_file_name()).count().collect())
    assert sizes(staged) == sizes(again)
