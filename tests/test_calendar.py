import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from climspark.functions.calendar import (
    add_time_features,
    clip_dates,
    count_days,
    ensure_datetime,
    explode_days,
    period_end,
    period_start,
    prepare_dates,
)


def test_zone_is_dropped_and_features_added(spark):
    rows = spark.createDataFrame([(d.to_pydatetime(), 1.0) for d in pd.date_range("2001-01-01", periods=3, tz="UTC")], "date timestamp, prec double")
    clean = ensure_datetime(rows)
    assert clean.schema["date"].dataType.simpleString() == "timestamp_ntz"
    first = add_time_features(clean, add_cyclic=True).orderBy("date").first()
    assert (first["year"], first["month"], first["doy"]) == (2001, 1, 1)
    assert {"doy_sin", "doy_cos"} <= set(first.asDict())


def test_unreadable_dates_are_dropped(spark):
    rows = spark.createDataFrame([("2001-01-05",), ("2001-01-05T10:30:00+02:00",), ("05/02/2001",), ("never",), (None,)], "date string")
    got = sorted(r[0] for r in ensure_datetime(rows, formats=["dd/MM/yyyy"]).collect())
    assert got == [dt.datetime(2001, 1, 5), dt.datetime(2001, 1, 5, 10, 30), dt.datetime(2001, 2, 5)]
    assert ensure_datetime(rows, drop_invalid=False).count() == 5


def test_numbers_are_no_dates(spark):
    with pytest.raises(ValueError, match="holds no dates"):
        ensure_datetime(spark.range(3).withColumnRenamed("id", "date"))


def test_clip_is_inclusive_and_ends_at_midnight(spark):
    times = [dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 3), dt.datetime(2001, 1, 3, 6)]
    rows = spark.createDataFrame([(t,) for t in times], "date timestamp_ntz")
    assert clip_dates(rows, "date", "2001-01-01", "2001-01-03").count() == 2
    assert clip_dates(rows, "date", "2001-01-02").count() == 2
    assert clip_dates(rows, "date").count() == 3


def test_clip_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(dt.date(2001, 1, 1), 1)], "date date, v int").write.parquet(str(tmp_path / "t"))
    rows = prepare_dates(spark.read.parquet(str(tmp_path / "t")), "date", "2001-01-01", "2001-06-01")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date" in plan


def test_narrow_features(spark):
    rows = add_time_features(spark.createDataFrame([(dt.date(2000, 12, 31),)], "date date"), add_cyclic=True, narrow=True)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    assert types == {"date": "date", "year": "smallint", "month": "tinyint", "doy": "smallint", "doy_sin": "float", "doy_cos": "float"}
    assert rows.first()["doy"] == 366


@pytest.mark.parametrize("freq, rule", [("D", "D"), ("W", "W"), ("M", "ME"), ("Q", "QE"), ("Y", "YE"), ("A", "YE"), ("ME", "ME")])
def test_period_labels_match_pandas(spark, freq, rule):
    days = [d.date() for d in pd.date_range("1999-12-20", "2001-03-10", freq="9D")]
    rows = spark.createDataFrame([(d,) for d in days], "date date")
    got = rows.select("date", period_end(period_start(F.col("date"), freq), freq).alias("label")).collect()
    for day, label in got:
        series = pd.Series([1], index=pd.DatetimeIndex([day]))
        assert series.resample(rule).sum().index[0].date() == label


def test_unknown_period(spark):
    with pytest.raises(ValueError, match="freq"):
        period_start(F.lit("2001-01-01"), "H")


@pytest.mark.parametrize("partitions", [0, 5])
def test_every_day_once(spark, partitions):
    cells = spark.createDataFrame([(1,), (2,)], "id int")
    days = explode_days(cells, "date", "1999-12-30", "2001-01-02", ["id"], partitions)
    assert days.count() == days.distinct().count() == 2 * count_days("1999-12-30", "2001-01-02") == 2 * 370
    bounds = days.agg(F.min("date"), F.max("date")).first()
    assert bounds == (dt.date(1999, 12, 30), dt.date(2001, 1, 2))


def test_empty_span():
    with pytest.raises(ValueError, match="holds no day"):
        count_days("2001-01-02", "2001-01-01")
