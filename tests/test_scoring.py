import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from climspark.functions.metrics import score_pairs
from climspark.operators.medians import grouped_median
from climspark.operators.scoring import aggregate_and_score, metrics_dict, resample, score_grains, widen_scores

RULES = {"D": "D", "W": "W", "M": "ME", "Q": "QE", "Y": "YE"}


def brute(y, p):
    """MAE, RMSE, R2 of plain arrays; None where undefined."""
    y, p = np.asarray(y, float), np.asarray(p, float)
    if len(y) == 0:
        return None, None, None
    mae, rmse = np.abs(y - p).mean(), math.sqrt(((y - p) ** 2).mean())
    if (y == y[0]).all():
        return mae, rmse, 1.0 if np.allclose(y, p) else None
    return mae, rmse, 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def brute_bins(pdf, freq, agg):
    series = pdf.assign(date=pd.to_datetime(pdf["date"])).set_index("date")[["y_true", "y_pred"]].sort_index()
    return series.resample(RULES[freq]).agg(agg).dropna()


def assert_scores(row, expected, n):
    assert row["n"] == n
    for name, value in zip(("mae", "rmse", "r2"), expected):
        assert row[name] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-9)), name


def test_perfect_prediction(spark):
    rows = [(dt.date(2001, 1, 1) + dt.timedelta(days=i), float(i), float(i)) for i in range(30)]
    scores, bins = aggregate_and_score(spark.createDataFrame(rows, "date date, y_true double, y_pred double"))
    row = scores.first()
    assert (row["mae"], row["rmse"]) == (0.0, 0.0) and bins.count() == 1
    assert row["r2"] == pytest.approx(1.0)


@pytest.mark.parametrize("freq", list(RULES))
@pytest.mark.parametrize("agg", ["sum", "mean", "median"])
def test_resampled_scores_match_pandas(spark, pairs_pdf, freq, agg):
    scores, bins = aggregate_and_score(spark.createDataFrame(pairs_pdf), keys=["station"], freq=freq, agg=agg)
    got = {r["station"]: r for r in scores.collect()}
    sizes = {r["station"]: r["count"] for r in bins.groupBy("station").count().collect()}
    for station, group in pairs_pdf.groupby("station"):
        want = brute_bins(group, freq, agg)
        assert sizes[station] == len(want)
        assert_scores(got[station], brute(want["y_true"], want["y_pred"]), len(want))


@pytest.mark.parametrize("agg", ["sum", "mean", "median"])
def test_three_grains_match_pandas(spark, pairs_pdf, agg):
    long = score_grains(spark.createDataFrame(pairs_pdf), agg=agg)
    got = {(r["station"], r["grain"]): r for r in long.collect()}
    assert len(got) == 9
    for station, group in pairs_pdf.groupby("station"):
        for grain, freq in (("daily", None), ("monthly", "M"), ("annual", "Y")):
            want = group if freq is None else brute_bins(group, freq, agg)
            assert_scores(got[station, grain], brute(want["y_true"], want["y_pred"]), len(want))
    wide = {r["station"]: r for r in widen_scores(long).collect()}
    assert wide[2]["RMSE_m"] == got[2, "monthly"]["rmse"] and wide[2]["n_rows"] == got[2, "daily"]["n"]


def test_unkeyed_grains(spark, pairs_pdf):
    one = pairs_pdf[pairs_pdf.station == 3]
    got = metrics_dict(score_grains(spark.createDataFrame(one), []))
    assert got["daily"]["MAE"] == pytest.approx(brute(one["y_true"], one["y_pred"])[0])
    assert set(got) == {"daily", "monthly", "annual"}


def test_daily_spread_is_stable_far_from_zero(spark):
    """Values near 1e6 with a spread of 1e-2: a sum of squares would lose it."""
    rng = np.random.default_rng(0)
    y = 1e6 + rng.normal(scale=1e-2, size=400)
    p = y + rng.normal(scale=1e-3, size=400)
    days = pd.date_range("2001-01-01", periods=400).date
    rows = spark.createDataFrame(pd.DataFrame({"station": 1, "date": days, "y_true": y, "y_pred": p}))
    row = score_grains(rows).filter("grain = 'daily'").first()
    assert row["r2"] == pytest.approx(brute(y, p)[2], abs=1e-6)


def test_constant_truth_and_missing_values(spark):
    rows = [(1, 4.0, 4.0), (1, 4.0, 4.0 + 1e-9), (2, 4.0, 4.0), (2, 4.0, 5.0), (3, 1.0, float("nan")), (3, 1.0, None), (3, 1.0, 2.0), (3, 2.0, 2.0)]
    got = {r["k"]: r for r in score_pairs(spark.createDataFrame(rows, "k int, y double, p double"), ["k"], "y", "p").collect()}
    assert got[1]["r2"] == 1.0 and got[2]["r2"] is None
    assert got[3]["n"] == 2 and got[3]["mae"] == 0.5
    empty = score_pairs(spark.createDataFrame([], "y double, p double"), [], "y", "p").first()
    assert empty["n"] == 0 and empty["mae"] is None and empty["r2"] is None


def test_empty_bins_count_as_zero_unless_dropped(spark):
    rows = [(dt.date(2001, 1, 5), 3.0, 4.0), (dt.date(2001, 4, 5), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date date, y_true double, y_pred double")
    assert aggregate_and_score(df, agg="sum")[0].first()["n"] == 4
    assert aggregate_and_score(df, agg="sum", empty_bins="drop")[0].first()["n"] == 2
    assert aggregate_and_score(df, agg="mean")[0].first()["n"] == 2


def test_null_only_bin_sums_to_zero(spark):
    rows = [(dt.date(2001, 1, 5), None, 4.0), (dt.date(2001, 2, 5), 1.0, 1.0)]
    _, bins = aggregate_and_score(spark.createDataFrame(rows, "date date, y_true double, y_pred double"))
    assert sorted(tuple(r) for r in bins.collect())[0] == (dt.date(2001, 1, 31), 0.0, 4.0)


def test_unknown_aggregate(spark, pairs_pdf):
    with pytest.raises(ValueError, match="Unknown agg"):
        aggregate_and_score(spark.createDataFrame(pairs_pdf), agg="max")
    with pytest.raises(ValueError, match="Unknown agg"):
        score_grains(spark.createDataFrame(pairs_pdf), agg="max")


def test_resample_keeps_empty_bins_as_null(spark):
    rows = spark.createDataFrame([(dt.date(2001, 1, 5), 3.0), (dt.date(2001, 3, 5), 1.0)], "date date, v double")
    got = sorted(tuple(r) for r in resample(rows, [], ["v"], freq="M", agg="mean").collect())
    assert got == [(dt.date(2001, 1, 31), 3.0), (dt.date(2001, 2, 28), None), (dt.date(2001, 3, 31), 1.0)]


def test_medians_by_rank_selection(spark):
    """One group holds most rows; the limit sends it down the ranged path, the others not."""
    rng = np.random.default_rng(5)
    hot = pd.DataFrame({"k": "hot", "a": rng.normal(size=4001), "b": rng.integers(0, 5, 4001).astype(float)})
    cold = pd.DataFrame({"k": rng.choice(list("xyz"), 300), "a": rng.normal(size=300), "b": np.nan})
    pdf = pd.concat([hot, cold])
    want = pdf.groupby("k")[["a", "b"]].median()
    for limit in (50, 2000, 10**6):
        got = grouped_median(spark.createDataFrame(pdf), ["k"], ["a", "b"], group_limit=limit).toPandas().set_index("k")
        pd.testing.assert_frame_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_even_sized_ranged_median_averages_the_middle(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in range(1000)], "k int, v double")
    assert grouped_median(rows, ["k"], ["v"], group_limit=10).first()["v"] == 499.5
