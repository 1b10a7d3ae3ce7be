"""Forests of many targets grown together."""

import datetime as dt

import numpy as np
import pytest
from conftest import MEAN_MODEL
from pyspark.sql import functions as F

from climspark import evaluate_all_stations_fast
from climspark.plans import growth as op

STEP = {"n_estimators": 1, "max_depth": 4, "bootstrap": False, "random_state": 7}


@pytest.fixture(scope="module")
def steps(spark):
    """Nine stations whose value is a step of place and season, with gaps, a null and one station without values."""
    places = [(40.0, 3.0), (40.5, 3.5), (41.0, 2.0), (44.0, 8.0), (44.5, 9.0), (45.0, 8.5), (50.0, 20.0), (51.0, 21.0), (50.5, 19.0)]
    rows = []
    for s, (x, y) in enumerate(places, 11):
        for n in range(0, 400, 2 + s % 3):
            day = dt.date(2001, 3, 1) + dt.timedelta(days=n)
            value = (5.0 if x > 48 else 1.0 if x > 43 else 3.0) + (10.0 if day.month > 6 else 0.0)
            rows.append((s, day, x, y, 100.0 * s, None if s == 19 or n == 60 else value))
    schema = "station long, date date, latitude double, longitude double, altitude double, prec double"
    return spark.createDataFrame(rows, schema)


def plain_tree(x, y, w, depth, least=1.0):
    """A regression tree by trying every cut; returns a function of one row."""
    mean = np.average(y, weights=w)
    best = (1e-12 * (1 + mean**2), None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for v in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= v
                if min(w[left].sum(), w[~left].sum()) < least:
                    continue
                a, b = np.average(y[left], weights=w[left]), np.average(y[~left], weights=w[~left])
                gain = (w[left].sum() * (a - mean) ** 2 + w[~left].sum() * (b - mean) ** 2) / w.sum()
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, v))
    if best[1] is None:
        return lambda row: mean
    f, v = best[1]
    left = x[:, f] <= v
    lower, upper = (plain_tree(x[s], y[s], w[s], depth - 1, least) for s in (left, ~left))
    return lambda row: lower(row) if row[f] <= v else upper(row)


def grown(spark, rows, growth, tasks=2):
    """rows: (target, key, y, a, b)."""
    df = spark.createDataFrame(rows, "target long, key long, y double, a double, b double").repartition(tasks)
    edges = op.bin_edges(df, ["a", "b"], growth.bins)
    trees = op.grow(df, ["a", "b"], edges, sorted({r[0] for r in rows}), growth)
    out = op.predictions(trees, df, ["a", "b"], "p").collect()
    return {(r.target, r.key): r.p for r in out}


def noisy(targets=(3, 8), n=60, seed=1):
    rng = np.random.default_rng(seed)
    return [
        (t, 1000 * t + i, float(np.round(rng.normal() + (a > 4) * t, 3)), float(a), float(rng.integers(0, 5)))
        for t in targets for i, a in enumerate(rng.integers(0, 9, n))
    ]


@pytest.mark.parametrize("depth, least", [(0, 1), (1, 1), (3, 1), (4, 6)])
def test_trees_are_those_of_a_full_search(spark, depth, least):
    rows = noisy()
    got = grown(spark, rows, op.Growth(1, depth, 5, 32, least, 0.0, False, 1.0))
    for t in (3, 8):
        mine = [r for r in rows if r[0] == t]
        x, y = np.array([r[3:] for r in mine]), np.array([r[2] for r in mine])
        tree = plain_tree(x, y, np.ones(len(y)), depth, least)
        assert np.allclose([got[t, r[1]] for r in mine], [tree(r[3:]) for r in mine])


def test_bootstrapped_trees_use_the_weights_of_row_tree_and_seed(spark):
    rows = noisy((3,))
    growth = op.Growth(3, 2, 11, 32, 1, 0.0, True, 1.0)
    got = grown(spark, rows, growth)
    x, y, keys = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    trees = []
    for t in range(3):
        w = op.poisson_weights(keys, t, 11, 1.0)
        trees.append(plain_tree(x[w > 0], y[w > 0], w[w > 0], 2))
    assert np.allclose([got[3, k] for k in keys], [np.mean([t(row) for t in trees]) for row in x])


def test_weights_are_poisson():
    w = np.concatenate([op.poisson_weights(np.arange(20_000), t, 1, 0.7) for t in range(5)])
    assert abs(w.mean() - 0.7) < 0.01 and abs(w.var() - 0.7) < 0.02 and abs((w == 0).mean() - np.exp(-0.7)) < 0.01


def test_a_forest_does_not_depend_on_its_company(spark):
    growth = op.Growth(4, 3, 2, 32, 1, 0.0, True, 1.0)
    together, alone = grown(spark, noisy((3, 8, 9)), growth, 5), grown(spark, [r for r in noisy((3, 8, 9)) if r[0] == 8], growth, 1)
    assert {k: v for k, v in together.items() if k[0] == 8} == pytest.approx(alone)


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def board(df, **options):
    options = {"start": None, "end": None, "k_neighbors": 3, "min_station_rows": None} | options
    return {r.station: r for r in evaluate_all_stations_fast(df, **options).collect()}


def test_jobs_follow_the_depth_not_the_targets(spark, steps):
    counts = [
        jobs_of(spark, f"growth{len(ids)}", lambda: board(steps, station_ids=ids, rf_params=STEP, grow_together=True))
        for ids in ([11, 14], list(range(11, 19)))
    ]
    assert counts[0] == counts[1]


@pytest.mark.parametrize("params", [MEAN_MODEL, STEP])
@pytest.mark.parametrize("pct", [0.0, 30.0])
def test_scores_are_those_of_single_fits(spark, steps, params, pct):
    """Means and steps leave a tree no choice, so both growers agree."""
    both = [board(steps, rf_params=params, include_target_pct=pct, grow_together=t, feature_cols=["latitude", "month"]) for t in (True, False)]
    assert both[0].keys() == both[1].keys()
    for s, r in both[0].items():
        assert r.error == both[1][s].error or (r.error and both[1][s].error)
        for c in ("RMSE_d", "MAE_d", "R2_d", "RMSE_m", "n_rows"):
            assert r[c] == (pytest.approx(both[1][s][c]) if both[1][s][c] is not None else None), (s, c)


def test_groups_of_targets_change_nothing(spark, steps, monkeypatch):
    whole = board(steps, rf_params=STEP, grow_together=True)
    monkeypatch.setattr(op, "NODES_HELD", 100)
    parts = board(steps, rf_params=STEP, grow_together=True)
    assert {s: r.RMSE_d for s, r in whole.items()} == {s: r.RMSE_d for s, r in parts.items()}


def test_what_it_cannot_grow_is_refused(spark, steps):
    with pytest.raises(ValueError, match="grow_together"):
        board(steps, rf_params=STEP | {"max_features": "sqrt"}, grow_together=True)
    with pytest.raises(ValueError, match="k_neighbors"):
        board(steps, rf_params=STEP, k_neighbors=None, grow_together=True)


def test_edges_are_midpoints_or_quantiles(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    edges = op.bin_edges(df, ["a", "b"], 8)
    assert len(edges[0]) == 7 and np.all(np.abs(edges[0] - np.arange(1, 8) * 125) < 10) and edges[1].tolist() == [0.5, 1.5]
    assert op.binned(np.array([[0.0, 0.0], [999.0, 1.0]]), edges).tolist() == [[0, 0], [7, 1]]
