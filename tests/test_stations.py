import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import make_network
from pyspark.sql import functions as F

from climspark import (
    Columns,
    build_station_kneighbors,
    neighbor_correlation_table,
    neighbor_correlations,
    resolve_columns,
    sample_target_for_training,
    select_stations,
    slice_station_series,
    station_positions,
)
from climspark.operators import sampling
from climspark.operators.sampling import draw_sample
from climspark.operators.stations import stations_with_min_rows


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame(make_network((14, 205, 31), 4, skip=3))


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({}, [14, 31, 205]),
        ({"where": lambda c: c.between(20, 300)}, [31, 205]),
        ({"custom_filter": lambda s: s % 7 == 0}, [14]),
        ({"regex": "[0-9]+5"}, [205]),
        ({"prefix": ["3", "20"]}, [31, 205]),
        ({"station_ids": [8, 205], "prefix": "14"}, [8, 14, 205]),
        ({"regex": "1", "custom_filter": lambda s: s > 200}, [14, 205]),
    ],
)
def test_selectors(three, filters, expected):
    assert ids(select_stations(three, **filters)) == expected


def test_patterns_are_anchored(three):
    with pytest.warns(UserWarning, match="every station"):
        assert ids(select_stations(three, regex="05")) == [14, 31, 205]


def test_no_match_selects_all_or_raises(three):
    with pytest.warns(UserWarning, match="every station"):
        assert ids(select_stations(three, prefix="9")) == [14, 31, 205]
    with pytest.raises(ValueError, match="No station"):
        select_stations(three, prefix="9", strict=True)


def test_column_names_resolve(three):
    df = three.withColumnRenamed("prec", "PRECTOTCORR")
    assert resolve_columns(df, ["pretotcorr", "Latitude", "nope", None]) == ["PRECTOTCORR", "latitude"]
    assert resolve_columns(df, None) == [] and resolve_columns(df, "ALTITUDE") == ["altitude"]


def test_positions_are_medians(spark):
    pdf = pd.DataFrame({"station": [1, 1, 1, 2], "latitude": [1.0, 2.0, 9.0, np.nan], "longitude": [3.0, 4.0, 4.0, 5.0], "altitude": [1.0, 3.0, 2.0, 7.0]})
    got = {r[0]: tuple(r)[1:] for r in station_positions(spark.createDataFrame(pdf)).collect()}
    assert got == {1: (2.0, 4.0, 2.0), 2: (None, 5.0, 7.0)}


def test_min_rows(spark):
    pdf = pd.concat([make_network((1,), 10), make_network((2,), 4)])
    pdf.loc[pdf.index[:3], "prec"] = None
    kept = stations_with_min_rows(spark.createDataFrame(pdf).withColumn("prec", F.nanvl("prec", F.lit(None))), ["latitude"], 5)
    assert [tuple(r) for r in kept.collect()] == [(1, 7)]


def test_slice(spark, network):
    rows = slice_station_series(network.orderBy(F.desc("date")), 2).collect()
    assert len(rows) == 60 and [r["date"] for r in rows] == sorted(r["date"] for r in rows)
    assert slice_station_series(network, 99).count() == 0


def brute_knn(pdf, k):
    rad = np.deg2rad(pdf[["latitude", "longitude"]].to_numpy())
    out = {}
    for i, s in enumerate(pdf["station"]):
        d = np.round(np.sqrt(((rad - rad[i]) ** 2).sum(axis=1)), 12)
        order = sorted((d[j], t) for j, t in enumerate(pdf["station"]) if j != i)
        out[s] = [t for _, t in order[:k]]
    return out


def as_map(df):
    pdf = df.toPandas().sort_values(["station", "rank"])
    return pdf.groupby("station")["neighbor"].apply(list).to_dict()


@pytest.fixture(scope="module")
def clustered_points():
    """A third of the stations share one spot, a third crowd around it, the rest are scattered."""
    rng = np.random.default_rng(11)
    same = np.tile([[20.0, -100.0]], (40, 1))
    crowd = [20.0, -100.0] + rng.normal(scale=1e-4, size=(40, 2))
    wide = np.column_stack([rng.uniform(14, 33, 40), rng.uniform(-117, -86, 40)])
    coords = np.concatenate([same, crowd, wide])
    order = rng.permutation(len(coords))
    return pd.DataFrame({"station": order + 1, "latitude": coords[:, 0], "longitude": coords[:, 1], "altitude": 0.0})


@pytest.mark.parametrize("k", [1, 5, 60, 500])
def test_neighbors_are_exact(spark, clustered_points, k):
    """Ties (forty stations at one spot) go to the smaller id."""
    got = as_map(build_station_kneighbors(spark.createDataFrame(clustered_points), k=k))
    assert got == brute_knn(clustered_points, k)


def test_neighbors_of_some_stations(spark, clustered_points):
    got = as_map(build_station_kneighbors(spark.createDataFrame(clustered_points), k=4, targets=[3, 77, 9999]))
    want = brute_knn(clustered_points, 4)
    assert got == {s: want[s] for s in (3, 77)}


def test_neighbors_along_a_line(spark):
    pdf = make_network(tuple(range(1, 30)), 1)
    assert as_map(build_station_kneighbors(spark.createDataFrame(pdf), k=3)) == brute_knn(pdf, 3)


def test_lone_station_has_no_neighbors(spark):
    assert build_station_kneighbors(spark.createDataFrame(make_network((1,), 3)), k=2).count() == 0


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in (1, 2, 3):
        for d in pd.date_range("2000-01-01", periods=200):
            for _ in range(rng.integers(0, 3)):  # gaps and duplicate days
                rows.append((s, d.date(), float(rng.normal())))
    rows += [(4, d.date(), 1.0) for d in pd.date_range("2000-01-01", periods=200)]  # constant
    rows += [(5, dt.date(2000, 1, 2), 1.0)]
    pdf = pd.DataFrame(rows, columns=["station", "date", "prec"])
    got = neighbor_correlation_table(spark.createDataFrame(pdf), 1, neighbor_ids=[2, 3, 4, 5, 6], min_overlap=20).collect()
    wide = pdf.pivot_table(index="date", columns="station", values="prec", aggfunc="mean")
    table = {r["neighbor"]: r for r in got}
    for n in (2, 3):
        pair = wide[[1, n]].dropna()
        assert table[n]["corr"] == pytest.approx(np.corrcoef(pair[1], pair[n])[0, 1])
        assert table[n]["n_overlap"] == len(pair)
    assert table[4]["corr"] is None and table[4]["n_overlap"] > 20
    assert table[5]["corr"] is None and table[6]["n_overlap"] == 0
    defined = [r["corr"] for r in got if r["corr"] is not None]
    assert defined == sorted(defined, reverse=True) and [r["corr"] for r in got][-3:] == [None] * 3
    assert neighbor_correlation_table(spark.createDataFrame(pdf), 77, neighbor_ids=[1]).count() == 0


def test_correlation_of_all_pairs(spark):
    pdf = make_network((1, 2, 3), 90, skip=4)
    df = spark.createDataFrame(pdf)
    table = neighbor_correlations(df, build_station_kneighbors(df, k=2), end="2000-03-10", min_overlap=5).collect()
    wide = pdf[pdf.date <= dt.date(2000, 3, 10)].pivot(index="date", columns="station", values="prec")
    assert len(table) == 6
    for r in table:
        pair = wide[[r["station"], r["neighbor"]]].dropna()
        assert r["n_overlap"] == len(pair) and r["corr"] == pytest.approx(pair.corr().iloc[0, 1])


@pytest.mark.parametrize("pct, n", [(0, 0), (-5, 0), (1, 1), (10, 6), (33.4, 21), (100, 60), (250, 60)])
def test_leak_sample_is_exact_and_seeded(network, pct, n):
    draw = lambda seed: sample_target_for_training(
        network, feature_cols=["latitude"], station_id=2, include_target_pct=pct, random_state=seed
    )
    first = sorted(r["date"] for r in draw(0).collect())
    assert len(first) == n == len(set(first))
    assert first == sorted(r["date"] for r in draw(0).repartition(3).collect())
    if n == 6:
        assert first != sorted(r["date"] for r in draw(1).collect())


def test_leak_sample_with_one_hot_day(spark, monkeypatch):
    """Copies of one day all fall into one slice and are still ranked exactly."""
    monkeypatch.setattr(sampling, "SLICE_DIGITS", 1)
    pdf = pd.concat([make_network((1, 2), 50), *[make_network((1,), 1)] * 200])
    drawn = draw_sample(spark.createDataFrame(pdf), Columns(), pct=10).groupBy("station").count()
    assert {r[0]: r[1] for r in drawn.collect()} == {1: 25, 2: 5}


def test_station_table_without_rows(spark):
    empty = spark.createDataFrame([], "station long, date date, latitude double, longitude double, altitude double, prec double")
    assert station_positions(empty).count() == 0 and select_stations(empty).count() == 0


@pytest.mark.parametrize("k, places_per_part", [(1, 3), (4, 7), (4, 20), (30, 5)])
def test_neighbors_across_parts(spark, clustered_points, k, places_per_part):
    """Parts smaller than k, whose places must look into others, give what one part gives."""
    df = spark.createDataFrame(clustered_points)
    got = as_map(build_station_kneighbors(df, k=k, places_per_part=places_per_part))
    assert got == brute_knn(clustered_points, k)
    some = as_map(build_station_kneighbors(df, k=k, targets=[3, 77], places_per_part=places_per_part))
    assert some == {s: got[s] for s in (3, 77)}


def test_stations_of_one_place_and_of_a_ring(spark):
    """Ties of many: a place that holds most stations, and stations all at one distance."""
    rows = [(s, 10.0, 20.0) for s in range(100, 180)]
    rows += [(s, 10.0 + [1, 0, -1, 0][s % 4], 20.0 + [0, 1, 0, -1][s % 4]) for s in range(8)]
    df = spark.createDataFrame(
        [(s, dt.date(2000, 1, 1), x, y, 1.0) for s, x, y in rows],
        "station long, date date, latitude double, longitude double, prec double",
    )
    for places_per_part in (1, 2, 100):
        got = as_map(build_station_kneighbors(df, k=3, places_per_part=places_per_part))
        assert got[100] == [101, 102, 103] and got[179] == [100, 101, 102]
        assert got[0] == [4, 100, 101] and got[5] == [1, 100, 101] and len(got) == 88
