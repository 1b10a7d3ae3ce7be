"""How often rows are shuffled by medians and comparisons."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from climspark import compare_sources
from climspark.operators.medians import grouped_median
from climspark.plans.compare import smooth_rows


def shuffles(df):
    """Shuffles that ran, a reused one counted once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("ShuffleQueryStage") - plan.count("ReusedExchange")


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(2)
    first = dt.date(2000, 1, 1)
    rows = [(int(s), first + dt.timedelta(days=int(n)), float(v)) for s, n, v in zip(rng.integers(0, 5, 400), rng.integers(0, 90, 400), rng.normal(size=400))]
    return spark.createDataFrame(rows, "k int, date date, v double")


def test_medians_shuffle_their_rows_once(values):
    months = values.select("k", F.trunc("date", "month").alias("m"), "v", (F.col("v") * F.col("v")).alias("w"))
    assert shuffles(grouped_median(months, ["k", "m"], ["v", "w"])) <= 2


def test_medians_of_null_keys_and_of_nulls(spark):
    rows = [(None, 1, 2.0), (None, 1, 4.0), (None, None, 7.0), (1, 1, None), (2, 1, float("nan")), (2, 1, 5.0)]
    df = spark.createDataFrame(rows, "a int, b int, v double")
    for limit in (1, 100):
        got = {(r.a, r.b): r.v for r in grouped_median(df, ["a", "b"], ["v"], group_limit=limit).collect()}
        assert got == {(None, 1): 3.0, (None, None): 7.0, (1, 1): None, (2, 1): 5.0}


@pytest.mark.parametrize("options, most", [({"resample_to": None, "smooth": 3}, 3), ({"resample_to": "D"}, 3)])
def test_sources_are_shuffled_side_by_side(spark, values, options, most):
    data = values.groupBy(F.col("k").alias("station"), "date").agg(F.max("v").alias("prec"), F.min("v").alias("other"))
    data = spark.createDataFrame(data.toPandas(), "station long, date date, prec double, other double")
    data = data.withColumns({c: F.lit(1.0) for c in ("latitude", "longitude", "altitude")})
    predicted = data.select("station", "date", (F.col("prec") + 1).alias("y_pred_full"))
    aligned, scores = compare_sources(data, product_col="other", predicted=predicted, **options)
    assert shuffles(aligned) <= most and shuffles(scores) <= most + 1


def test_filled_spans_are_each_sources_own(spark):
    """The sum of a source is 0 between its own ends only, and a period between the ends of none is left out."""
    day = lambda m: dt.date(2000, m, 5)
    data = spark.createDataFrame([(1, day(1), 2.0), (1, day(3), 4.0)], "station long, date date, prec double")
    predicted = spark.createDataFrame([(1, day(3), 1.0), (1, day(6), 2.0), (2, day(1), 1.0)], "station long, date date, y_pred_full double")
    late = spark.createDataFrame([(1, day(9), 5.0)], "station long, date date, x double")
    names = dict(resample_to="M", agg="sum", predicted=predicted, extra=late, extra_value_col="x")
    got = {(r.station, r.date.month): (r.obs, r.rf, r.extra) for r in compare_sources(data, **names)[0].collect()}
    assert got == {
        (1, 1): (2.0, None, None), (1, 2): (0.0, None, None), (1, 3): (4.0, 1.0, None), (1, 4): (None, 0.0, None),
        (1, 5): (None, 0.0, None), (1, 6): (None, 2.0, None), (1, 9): (None, None, 5.0), (2, 1): (None, 1.0, None),
    }


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("per_task", [7, 10**6])
def test_columns_are_smoothed_over_their_own_rows(spark, width, per_task):
    rng = np.random.default_rng(width)
    pdf = pd.DataFrame({"k": [1.0] * 40 + [np.nan] * 20, "date": pd.date_range("2000-01-01", periods=60, freq="7h"), "a": rng.normal(size=60), "b": rng.normal(size=60)})
    pdf.loc[rng.random(60) < 0.3, "a"] = np.nan
    pdf.loc[(rng.random(60) < 0.3) & pdf.a.notna(), "b"] = np.nan
    df = spark.createDataFrame(pdf).select(F.nanvl("k", F.lit(None)).cast("int").alias("k"), F.col("date").cast("timestamp_ntz").alias("date"), *[F.nanvl(c, F.lit(None)).alias(c) for c in "ab"])
    got = smooth_rows(df, ["k"], ["a", "b"], width, rows_per_task=per_task).toPandas().sort_values("date")
    assert len(got) == 60
    for c in "ab":
        want = pdf[pdf[c].notna()].groupby(pdf.k.fillna(0))[c].transform(lambda s: s.rolling(width, min_periods=1, center=True).mean())
        assert np.allclose(got[c].to_numpy(float), want.reindex(range(60)).to_numpy(), equal_nan=True)
