"""Forests without a cut: one pass over all targets instead of a fit a target."""

import numpy as np
import pandas as pd
import pytest
from conftest import MEAN_MODEL, make_network
from pyspark.sql import functions as F

from climspark import evaluate_all_stations, evaluate_all_stations_fast, export_full_series_batch
from climspark.plans import growth, many
from climspark.plans.growth import Growth
from climspark.schema import Columns
from climspark.sources.staging import stage_features


@pytest.fixture(scope="module")
def network(spark):
    """Six stations; one has no value before March, the last has none at all."""
    pdf = make_network(range(1, 7), 90, skip=4)
    pdf.loc[(pdf.station == 6) | ((pdf.station == 5) & (pdf.date < pd.Timestamp("2000-03-01").date())), "prec"] = np.nan
    return spark.createDataFrame(pdf)


def both(monkeypatch, run):
    """Rows by a fit a station, and in one pass, in which nothing may be fitted."""
    monkeypatch.setattr(many, "FEW_FITS", 99)
    fits = run()

    def refused(*_, **__):
        raise AssertionError("a fit for one station")

    monkeypatch.setattr(many, "FEW_FITS", 1)
    monkeypatch.setattr(many, "fit_pool", refused)
    return fits, run()


def same(a, b):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for c in x.asDict():
            if c != "seconds" and not (c == "error" and x[c] and y[c]):
                assert y[c] == (pytest.approx(x[c], rel=1e-9) if isinstance(x[c], float) else x[c]), (x, y)


OPTIONS = [{}, {"include_target_pct": 30.0}]


@pytest.mark.parametrize("options", OPTIONS)
def test_evaluation_in_one_pass(network, monkeypatch, options):
    run = lambda: evaluate_all_stations(network, rf_params=MEAN_MODEL, start="2000-01-10", end="2000-02-28", **options).collect()
    same(*both(monkeypatch, lambda: sorted(run(), key=lambda r: r.station)))


@pytest.mark.parametrize("options", [*OPTIONS, {"k_neighbors": 2}, {"k_neighbors": 2, "include_target_pct": 30.0}, {"k_neighbors": 1, "neighbor_map": {1: [2], 3: [6], 4: [5, 4]}}])
def test_fast_evaluation_in_one_pass(network, monkeypatch, options):
    run = lambda: evaluate_all_stations_fast(network, rf_params=MEAN_MODEL, end="2000-03-10", **options).collect()
    same(*both(monkeypatch, run))


@pytest.mark.parametrize("options", [*OPTIONS, {"k_neighbors": 2}, {"station_ids": [1, 5, 6, 77]}])
def test_export_in_one_pass(spark, network, monkeypatch, tmp_path, options):
    def run():
        out = f"{tmp_path}/{many.FEW_FITS}"
        manifest = export_full_series_batch(
            network, out_dir=out, rf_params=MEAN_MODEL, start="1999-12-30", end="2000-01-20", train_end="2000-02-20", **options
        ).drop("path")
        series = spark.read.parquet(f"{out}/loso_fullseries_19991230_20000120.parquet")
        return manifest.collect() + series.orderBy("station", "date").collect()

    same(*both(monkeypatch, run))


def test_export_with_covariates_in_one_pass(spark, network, monkeypatch, tmp_path):
    """A day that the covariates lack has a row without a prediction."""
    rows = network.withColumn("wind", F.lit(1.0))
    days = network.select("date").distinct().filter(F.dayofmonth("date") % 3 != 0).withColumn("wind", F.lit(2.0))

    def run():
        out = f"{tmp_path}/{many.FEW_FITS}"
        export_full_series_batch(
            rows, out_dir=out, rf_params=MEAN_MODEL, start="2000-01-01", end="2000-01-20", feature_cols=["latitude", "month", "wind"], covariates=days
        )
        return spark.read.parquet(f"{out}/loso_fullseries_20000101_20000120.parquet").orderBy("station", "date").collect()

    fits, one = both(monkeypatch, run)
    same(fits, one)
    assert {r.date.day % 3 == 0 for r in one if r.y_pred_full is None} == {True}


def test_the_others_lose_no_digits(spark):
    """One station's values are 10^17 times the others': taken off a sum, nothing would be left of those."""
    pdf = make_network(range(1, 30), 3)
    pdf["prec"] = np.where(pdf.station == 7, 1e17, pdf.station.astype(float))
    staged = stage_features(spark.createDataFrame(pdf), Columns(), ["latitude"])
    got = {r.target: r.mean for r in growth.root_means(staged, None, None, [7, 99], Columns()).collect()}
    assert got[7] == pytest.approx(np.mean([s for s in range(1, 30) if s != 7]), rel=1e-12) and got[99] == pytest.approx(pdf["prec"].mean())


def test_only_forests_that_spark_grows_alike():
    assert Growth.same_by_spark(MEAN_MODEL) and Growth.same_by_spark(MEAN_MODEL | {"n_estimators": 4})
    for other in ({"max_depth": 1}, {"bootstrap": True}, {"max_samples": 0.5}, {"max_features": "sqrt"}):
        assert Growth.same_by_spark(MEAN_MODEL | other) is None
    assert Growth.same_by_spark({"max_depth": 0, "n_estimators": 1}) is None


def test_quick_passes_of_a_logged_run_grow(spark, network, monkeypatch, tmp_path):
    """Six stations, one a pass at first: passes of 1, 2 and 3 while they are quick, else of one each."""
    passes, own = [], many.widen_scores
    monkeypatch.setattr(many, "widen_scores", lambda *a: passes.append(1) or own(*a))
    options = dict(rf_params=MEAN_MODEL, k_neighbors=2, flush_every=1, grow_together=True)
    boards = []
    for quick, count in ((1e9, 3), (0.0, 6)):
        monkeypatch.setattr(many, "QUICK_PASS", quick)
        passes.clear()
        boards.append(evaluate_all_stations_fast(network, log_csv=f"{tmp_path}/{count}.csv", **options).collect())
        assert len(passes) == count and spark.read.csv(f"{tmp_path}/{count}.csv", header=True).count() == 6
    same(*boards)


@pytest.fixture(scope="module")
def odd(spark):
    """Twenty stations: rows that come twice, without a value, off midnight, at both ends of the span and beyond, or none in it."""
    pdf = make_network(range(1, 21), 60, skip=3)
    pdf["date"] = pd.to_datetime(pdf["date"])
    pdf.loc[pdf.index % 7 == 0, "prec"] = np.nan
    pdf.loc[pdf.index % 11 == 0, "date"] += pd.Timedelta(hours=5)
    pdf = pd.concat([pdf, pdf[pdf.index % 5 == 0], pdf[pdf.station == 4], pdf[pdf.station == 4]])
    pdf = pdf[(pdf.station != 9) | (pdf.date < pd.Timestamp("2000-01-10"))]
    rows = [(int(s), d.to_pydatetime(), *map(float, p), None if np.isnan(v) else float(v)) for s, d, *p, v in pdf.itertuples(index=False)]
    schema = "station long, date timestamp_ntz, latitude double, longitude double, altitude double, prec double"
    return spark.createDataFrame([*rows, (None, rows[0][1], 1.0, 1.0, 1.0, 1.0), (21, None, 1.0, 1.0, 1.0, 1.0)], schema)


SPAN = dict(rf_params=MEAN_MODEL, start="2000-01-10", end="2000-02-20")


def exported(spark, data, out, **options):
    """Rows of the manifest, the written series and the combined table, in order."""
    options = SPAN | dict(combine_output_path=f"{out}/all", combine_format="parquet") | options
    manifest = export_full_series_batch(data, out_dir=out, **options).drop("path", "seconds")
    series = spark.read.parquet(f"{out}/loso_fullseries_20000110_20000220.parquet")
    return [sorted(map(tuple, t.select(sorted(t.columns)).collect()), key=repr) for t in (manifest, series, spark.read.parquet(f"{out}/all"))]


def close(a, b):
    for x, y in zip(a, b, strict=True):
        assert len(x) == len(y) > 0
        for r, s in zip(x, y, strict=True):
            assert [pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in r] == list(s)


@pytest.mark.parametrize("per_task", [30, 10**6])
def test_days_of_odd_rows(spark, odd, monkeypatch, tmp_path, per_task):
    """In one pass as by a fit a station, also where a station has more rows than a task may hold."""
    monkeypatch.setattr(many, "FEW_FITS", 99)
    fits = exported(spark, odd, f"{tmp_path}/fits")
    monkeypatch.setattr(many, "FEW_FITS", 1)
    monkeypatch.setattr(many, "ROWS_PER_TASK", per_task)
    close(fits, exported(spark, odd, f"{tmp_path}/one"))


def counting(spark, df):
    """The same rows, and how many of them were made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), made


def test_an_export_makes_its_rows_once(spark, odd, monkeypatch, tmp_path):
    """rows were made anew for positions, counts, features and values."""
    rows, made = counting(spark, odd)
    exported(spark, rows, f"{tmp_path}/out")
    assert made.value <= odd.count()


def test_an_export_reads_no_folder_a_station(spark, odd, monkeypatch, tmp_path):
    """manifest and combined table were made from what had been written, thrice."""

    def refused(*_, **__):
        raise AssertionError("read again")

    monkeypatch.setattr(many, "_read_series", refused)
    exported(spark, odd, f"{tmp_path}/out")


def test_an_export_by_neighbors_stages_no_features(spark, odd, monkeypatch, tmp_path):
    """means need sums of stations, not their rows in an order."""

    def refused(*_, **__):
        raise AssertionError("features staged")

    monkeypatch.setattr(many, "stage_features", refused)
    exported(spark, odd, f"{tmp_path}/out", k_neighbors=2)


def test_an_export_makes_its_covariates_once(spark, odd, monkeypatch, tmp_path):
    """they were made for the check of their keys and for each table. By date, or by station and date in any order."""
    wind = odd.withColumn("wind", F.lit(1.0))
    keys = odd.filter("station is not null and date is not null").select("station", F.to_date("date").alias("date")).distinct()
    inputs = ["latitude", "doy", "wind"]
    for days in (keys.select("date").distinct(), keys):
        rows, made = counting(spark, days.withColumn("wind", F.lit(2.0)))
        _, series, _ = exported(spark, wind, f"{tmp_path}/{len(days.columns)}", feature_cols=inputs, covariates=rows)
        assert made.value == days.count()
        held = {tuple(r) for r in days.collect()}
        assert all((p is not None) == ((d,) in held or (s, d) in held) for d, s, p, _ in series)


def test_many_folders_are_read_in_few_tasks(spark, monkeypatch, tmp_path):
    """Tasks follow from the bytes, not from the number of files; no row is lost."""
    from climspark.sources import tables

    monkeypatch.setattr(tables, "TASKS_PER_CORE", 1)
    spark.range(400).selectExpr("id", "id % 200 as station").repartition(1).write.partitionBy("station").parquet(f"{tmp_path}/t")
    table = tables.read_folders(spark, f"{tmp_path}/t")
    assert table.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < spark.read.parquet(f"{tmp_path}/t").rdd.getNumPartitions()
    assert sorted((r.id, r.station) for r in table.collect()) == [(i, i % 200) for i in range(400)]
