import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import make_network
from pyspark.sql import functions as F

from climspark import Columns, compare_sources
from climspark.plans.compare import smooth_rows


@pytest.fixture(scope="module")
def data(spark):
    pdf = make_network()
    pdf["nasa"] = pdf["prec"] + 1
    pdf = pdf[(pdf.station != 1) | (pdf.date.map(lambda d: d.day % 4 != 0))]
    return pdf, spark.createDataFrame(pdf)


def predicted(spark, days=60):
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(days=i), 6.0 + i % 5) for i in range(days)]
    return spark.createDataFrame(rows, "date date, y_pred_full double")


def brute(pdf, rule, agg, smooth):
    obs = pdf[pdf.station == 1].assign(date=lambda d: pd.to_datetime(d["date"])).set_index("date")
    rf = pd.Series([6.0 + i % 5 for i in range(60)], index=pd.date_range("2000-01-01", periods=60))
    out = {}
    for name, s in (("obs", obs["prec"]), ("nasa", obs["nasa"]), ("rf", rf)):
        s = s.sort_index()
        if rule:
            s = getattr(s.resample(rule), agg)()
        if smooth:
            s = s.rolling(smooth, min_periods=1, center=True).mean()
        out[name] = s
    return pd.DataFrame(out)


@pytest.mark.parametrize("freq, rule", [("D", "D"), ("W", "W"), ("M", "ME"), (None, None)])
@pytest.mark.parametrize("agg, smooth", [("mean", None), ("sum", 3), ("median", 4)])
def test_sources_match_pandas(spark, data, freq, rule, agg, smooth):
    pdf, df = data
    aligned, scores = compare_sources(
        df, station_id=1, product_col="nasa", predicted=predicted(spark), resample_to=freq, agg=agg, smooth=smooth
    )
    want = brute(pdf, rule, agg, smooth)
    got = aligned.toPandas().set_index("date").sort_index()
    got.index = pd.DatetimeIndex(got.index)
    pd.testing.assert_frame_equal(got[["obs", "nasa", "rf"]], want, check_names=False, check_freq=False, check_index_type=False, check_dtype=False)
    for row in scores.collect():
        pair = want[["obs", row["source"]]].dropna()
        assert row["n"] == len(pair)
        assert row["mae"] == pytest.approx((pair["obs"] - pair[row["source"]]).abs().mean())


def test_all_stations_in_one_job(data):
    _, scores = compare_sources(data[1], product_col="nasa", start="2000-01-01", end="2000-01-31")
    rows = scores.collect()
    assert {(r["station"], r["source"]) for r in rows} == {(1, "nasa"), (2, "nasa"), (3, "nasa")}
    assert all(r["mae"] == pytest.approx(1.0) for r in rows)


def test_extra_table_and_vector(spark, data):
    extra = predicted(spark, 20).select(F.col("date").alias("when"), F.col("y_pred_full").alias("v"))
    _, scores = compare_sources(data[1], station_id=2, extra=extra, extra_date_col="when", extra_value_col="v", end="2000-01-10")
    assert [(r["source"], r["n"]) for r in scores.collect()] == [("extra", 10)]
    _, scores = compare_sources(data[1], station_id=2, extra=[1.0, 2.0], resample_to="M", agg="mean")
    months = make_network((2,)).assign(m=lambda d: d["date"].map(lambda x: x.month)).groupby("m")["prec"].mean()
    assert scores.first()["mae"] == pytest.approx(np.mean(np.abs(months.to_numpy() - [1.0, 2.0])))
    with pytest.raises(ValueError, match="1 values for 2 observed"):
        compare_sources(data[1], station_id=2, extra=[1.0], resample_to="M")
    with pytest.raises(ValueError, match="extra_value_col"):
        compare_sources(data[1], station_id=2, extra=extra)
    with pytest.raises(TypeError, match="neither a DataFrame"):
        compare_sources(data[1], station_id=2, extra="x")


def test_missing_inputs(spark, data):
    with pytest.raises(ValueError, match="Station 9 does not occur"):
        compare_sources(data[1], station_id=9)
    with pytest.raises(ValueError, match="lacks the columns"):
        compare_sources(data[1], product_col="nope")
    with pytest.raises(ValueError, match="station_id"):
        compare_sources(data[1], predicted=predicted(spark))
    aligned, scores = compare_sources(data[1], station_id=1)
    assert aligned.columns == ["station", "date", "obs"] and scores.count() == 0


@pytest.mark.parametrize("width", [2, 3, 7, 10])
def test_smoothing_in_stretches(spark, width):
    """A hot series is cut into stretches far shorter than itself."""
    rng = np.random.default_rng(width)
    times = pd.Timestamp("2000-01-01") + pd.to_timedelta(np.sort(rng.choice(10**6, 500, replace=False)), unit="s")
    pdf = pd.DataFrame({"k": [1] * 497 + [2] * 3, "date": times, "v": rng.normal(size=500)})
    df = spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("timestamp_ntz"))
    got = smooth_rows(df, ["k"], "v", width, rows_per_task=20).toPandas().sort_values(["k", "date"])
    want = pdf.groupby("k")["v"].apply(lambda s: s.rolling(width, min_periods=1, center=True).mean()).to_numpy()
    assert len(got) == 500 and np.allclose(got["v"], want)
    assert Columns().target == "prec"
