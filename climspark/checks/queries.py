"""Every operator as a query over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from climspark.checks.network import observations, raw_rows, stations, table
from climspark.functions.calendar import add_time_features, ensure_datetime, prepare_dates
from climspark.operators.medians import grouped_median
from climspark.operators.neighbors import build_station_kneighbors, neighbor_correlation_table, neighbor_correlations
from climspark.operators.sampling import draw_sample
from climspark.operators.scoring import SCORE_COLUMNS, aggregate_and_score, resample, score_grains, widen_scores
from climspark.functions.metrics import score_pairs
from climspark.operators.stations import (
    count_valid_rows,
    leave_one_out,
    select_stations,
    slice_station_series,
    station_positions,
    valid_rows,
)
from climspark.plans.compare import compare_sources
from climspark.plans.forest import load_model, predict
from climspark.plans.grid import (
    GlobalModelMeta,
    dedupe_grid,
    grid_nan_report,
    normalize_points,
    predict_at_point_daily_with_global_model,
    predict_grid_daily_with_global_model,
    predict_points_daily_with_global_model,
    train_global_rf_target,
)
from climspark.plans.loso import (
    feature_frame,
    loso_predict_full_series,
    loso_predict_full_series_fast,
    loso_train_predict_station,
)
from climspark.plans.many import (
    evaluate_all_stations,
    evaluate_all_stations_fast,
    export_full_series_batch,
    export_full_series_station,
)
from climspark.schema import Columns
from climspark.sources.staging import new_folder
from climspark.sources.tables import read_folders, read_observations, write_json, write_table

COLUMNS = Columns()
# A forest of depth 0 predicts the mean of its pool, which SQL can state exactly.
MEAN_MODEL = {"n_estimators": 1, "max_depth": 0, "bootstrap": False, "random_state": 42}
# One full tree that sees all rows reproduces a target that is a step function of its features, which SQL can state.
TREE = {"n_estimators": 1, "max_depth": 14, "bootstrap": False, "random_state": 42}
SMALL_FOREST = {"n_estimators": 5, "max_depth": 5, "random_state": 42}
TARGET = 7
WINDOW = {"start": "1996-01-01", "end": "2000-12-31"}
HORIZON = {"start": "1998-01-01", "end": "1999-12-31"}
MONTH = {"start": "1999-02-01", "end": "1999-02-28"}
FITS = 8

Query = Callable[[SparkSession, str], DataFrame]


def r(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(name)


def d(name: str = "date") -> Column:
    return F.to_date(F.col(name)).cast("string").alias(name)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select(
        "station", "date", F.col("prec").alias("y_true"), F.col("prectotcorr").alias("y_pred")
    )


def _scores(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", r("mae"), r("rmse"), r("r2"))


# --- dates and features


def dirty_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_returnflag") != "R", F.col("l_shipdate").cast("string")).otherwise(F.lit("n/a"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("date"))
    return ensure_datetime(rows, "date").select("l_orderkey", "l_linenumber", d())


def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_time_features(observations(spark, sf_dir), "date", add_cyclic=True)
    return rows.select("station", d(), "year", "month", "doy", r("doy_sin"), r("doy_cos"))


def narrow_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensure_datetime(table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("date")))
    rows = add_time_features(rows, "date", add_cyclic=True, narrow=True)
    return rows.select(
        "event_id",
        *[F.col(c).cast("long").alias(c) for c in ("year", "month", "doy")],
        r("doy_sin", 4),
        r("doy_cos", 4),
    )


def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end bound is midnight: events later on the last day fall out."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("date"))
    clipped = prepare_dates(rows, "date", "2024-01-05", "2024-01-20")
    return clipped.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("date").cast("string").alias("last"))


def valid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, features = feature_frame(observations(spark, sf_dir), COLUMNS, **WINDOW)
    return count_valid_rows(frame, features).filter(F.col("valid_rows") >= 265)


# --- stations


def select_prefix_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_stations(
        observations(spark, sf_dir), prefix=["1", "27"], regex="[5-6]$|9.", station_ids=[3, 100001]
    )


def select_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_stations(
        observations(spark, sf_dir), where=lambda s: s < 12, custom_filter=lambda i: str(i)[0] == str(i)[-1]
    )


def station_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers spread over nations, so that positions differ within a group."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("station"),
        (F.col("c_acctbal") / 100).alias("latitude"),
        (F.col("c_custkey") / 7).alias("longitude"),
        F.length("c_name").cast("double").alias("altitude"),
    )
    return station_positions(rows).select("station", r("latitude"), r("longitude"), r("altitude"))


def station_medians_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank-selection path that groups with very many distinct values take."""
    rows = table(spark, sf_dir, "lineitem")
    out = grouped_median(rows, ["l_returnflag"], ["l_extendedprice", "l_discount"], group_limit=100)
    return out.select("l_returnflag", r("l_extendedprice"), r("l_discount"))


def knn_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = build_station_kneighbors(observations(spark, sf_dir), k=5)
    return out.select("station", "neighbor", "rank", r("distance", 9))


def knn_quadtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that several stations share: customers of a nation at rounded positions."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("station"),
        F.col("c_nationkey").cast("double").alias("latitude"),
        (F.floor(F.col("c_acctbal") / 1000) - 100).cast("double").alias("longitude"),
    )
    out = build_station_kneighbors(rows, k=3)
    return out.select("station", "neighbor", "rank", r("distance", 9))


def knn_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stations asked for by a table, searched in parts of the plane of a few places each."""
    rows = observations(spark, sf_dir)
    out = build_station_kneighbors(rows, k=5, targets=rows.select("station"), places_per_part=16)
    return out.select("station", "neighbor", "rank", r("distance", 9))


def neighbor_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_rows(spark, sf_dir)
    pairs = build_station_kneighbors(rows, k=5)
    out = neighbor_correlations(rows, pairs, **WINDOW)
    return out.select("station", "neighbor", r("corr"), "n_overlap")


def neighbor_corr_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_rows(spark, sf_dir)
    out = neighbor_correlation_table(rows, TARGET, neighbor_ids=[1, 2, 8, 10, 100001], min_overlap=10)
    return out.select("neighbor", r("corr"), "n_overlap")


def leave_one_out_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, own = leave_one_out(observations(spark, sf_dir), TARGET)
    both = rest.withColumn("part", F.lit("train")).unionByName(own.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("prec").alias("n_valid"))


def slice_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_station_series(observations(spark, sf_dir), TARGET).select("station", d(), r("prec"))


def leak_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, features = feature_frame(observations(spark, sf_dir), COLUMNS)
    sample = draw_sample(valid_rows(frame, features, "prec"), pct=10.0, seed=42)
    return sample.select("station", d(), r("prec"))


# --- scoring


def score_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(score_pairs(_pairs(spark, sf_dir), ["station"]), "station")


def _score(freq: str, agg: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = _pairs(spark, sf_dir).dropna(subset=["y_true"])
        scores, _ = aggregate_and_score(pairs, keys=["station"], freq=freq, agg=agg)
        return _scores(scores, "station")

    return query


def resampled_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls stay in: a month without any value sums to 0."""
    _, bins = aggregate_and_score(_pairs(spark, sf_dir), keys=["station"], freq="M", agg="sum")
    return bins.select("station", d(), r("y_true"), r("y_pred"))


def resampled_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty quarters stay in, as NULL."""
    bins = resample(_pairs(spark, sf_dir), ["station"], ["y_true"], freq="Q", agg="mean")
    return bins.select("station", d(), r("y_true"))


def _scoreboard(agg: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = widen_scores(score_grains(_pairs(spark, sf_dir), agg=agg))
        return wide.select("station", "n_rows", *[r(c) for c in SCORE_COLUMNS])

    return query


# --- leave one station out


def loso_observed_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _, _ = loso_train_predict_station(
        observations(spark, sf_dir), TARGET, rf_params=MEAN_MODEL, include_target_pct=10.0, **WINDOW
    )
    return out.select(d(), "station", r("y_true"), r("y_pred"))


def loso_full_series_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _, _ = loso_predict_full_series(
        observations(spark, sf_dir), TARGET, rf_params=MEAN_MODEL, add_cyclic=True, **HORIZON
    )
    return out.select(d(), "station", r("y_pred_full"), r("y_true"))


def loso_fast_knn_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows: several observations of a day multiply in the join with the horizon."""
    out, _, _, _ = loso_predict_full_series_fast(
        raw_rows(spark, sf_dir),
        TARGET,
        rf_params=MEAN_MODEL,
        k_neighbors=5,
        include_target_pct=10.0,
        train_start=WINDOW["start"],
        train_end=WINDOW["end"],
        **HORIZON,
    )
    return out.select(d(), "station", r("y_pred_full"), r("y_true"))


def loso_full_scores_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores, _, _ = loso_predict_full_series(
        observations(spark, sf_dir), TARGET, rf_params=MEAN_MODEL, **HORIZON
    )
    return _scores(scores, "station", "grain")


def evaluate_all_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate_all_stations(
        observations(spark, sf_dir), rf_params=MEAN_MODEL, include_target_pct=10.0, parallelism=FITS, **WINDOW
    )
    return out.select("station", "n_rows", *[r(c) for c in SCORE_COLUMNS])


def evaluate_fast_knn_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate_all_stations_fast(
        observations(spark, sf_dir),
        rf_params=MEAN_MODEL,
        k_neighbors=5,
        min_station_rows=265,
        parallelism=FITS,
        agg_for_metrics="mean",
        **WINDOW,
    )
    coords = [r(c) for c in COLUMNS.coords]
    return out.select("station", "n_rows", *[r(c) for c in SCORE_COLUMNS], "include_target_pct", *coords)


def evaluate_together_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate_all_stations_fast(
        observations(spark, sf_dir),
        rf_params=MEAN_MODEL,
        k_neighbors=5,
        min_station_rows=265,
        grow_together=True,
        agg_for_metrics="mean",
        **WINDOW,
    )
    coords = [r(c) for c in COLUMNS.coords]
    return out.select("station", "n_rows", *[r(c) for c in SCORE_COLUMNS], "include_target_pct", *coords)


def _exported(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, str]:
    """One export of every station: the manifest and the folder."""
    out = new_folder(spark, "export")
    manifest = export_full_series_batch(
        observations(spark, sf_dir),
        out_dir=out,
        rf_params=MEAN_MODEL,
        train_start=WINDOW["start"],
        train_end=WINDOW["end"],
        parallelism=FITS,
        **{k: v.format(out=out) if isinstance(v, str) else v for k, v in options.items()},
        **HORIZON,
    )
    return manifest, out


def export_filled_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = _exported(spark, sf_dir, combine_output_path="{out}/combined.csv")
    combined = read_observations(spark, f"{out}/combined.csv")
    return combined.select("station", r("latitude"), r("longitude"), r("altitude"), d(), r("prec"))


def export_series_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = _exported(spark, sf_dir)
    series = read_folders(spark, f"{out}/loso_fullseries_19980101_19991231.parquet")
    return series.select(F.col("station").cast("long").alias("station"), d(), r("y_pred_full"), r("y_true"))


def export_knn_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = _exported(spark, sf_dir, k_neighbors=5)
    series = read_folders(spark, f"{out}/loso_fullseries_19980101_19991231.parquet")
    return series.select(F.col("station").cast("long").alias("station"), d(), r("y_pred_full"), r("y_true"))


def export_covariates_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the covariates lack keep a row without a prediction."""
    rows = observations(spark, sf_dir)
    days = rows.groupBy("date").agg(F.max("prectotcorr").alias("prectotcorr")).filter(F.dayofmonth("date") % 3 != 0)
    inputs = [*COLUMNS.coords, "year", "month", "doy", "prectotcorr"]
    _, out = _exported(spark, sf_dir, feature_cols=inputs, covariates=days)
    series = read_folders(spark, f"{out}/loso_fullseries_19980101_19991231.parquet")
    return series.select(F.col("station").cast("long").alias("station"), d(), r("y_pred_full"), r("y_true"))


def manifest_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as its file has it."""
    manifest, out = _exported(spark, sf_dir, manifest_path="{out}/manifest.csv")
    stored = spark.read.schema(manifest.schema).csv(f"{out}/manifest.csv", header=True)
    return stored.select("station", r("coverage_pct"), *[r(c) for c in SCORE_COLUMNS], "error")


def export_compact_one_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    from climspark.plans.many import combined_series

    rows = observations(spark, sf_dir)
    series, _, _ = export_full_series_station(
        rows, TARGET, out_dir=new_folder(spark, "one"), rf_params=MEAN_MODEL, file_format="csv", **HORIZON
    )
    out = combined_series(series, station_positions(rows), schema="compact")
    return out.select("station", r("y_pred_full"), r("y_true"), d(), r("prec"))


# --- global model


_TRAIN = {"start": "1996-01-01", "end": "2000-12-31", "min_rows_per_station": 265}


def _global_model(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The mean model of the whole network: its folder and the stations used."""
    path = new_folder(spark, "global")
    _, _, summary = train_global_rf_target(
        observations(spark, sf_dir), model_path=f"{path}/model", meta_path=f"{path}/meta", rf_params=MEAN_MODEL, **_TRAIN
    )
    return path, summary


def _paths(path: str) -> dict[str, str]:
    return {"model_path": f"{path}/model", "meta_path": f"{path}/meta"}


def train_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _global_model(spark, sf_dir)[1]


def train_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _global_model(spark, sf_dir)
    meta = GlobalModelMeta.load(spark, f"{path}/meta")
    used = meta.stations_used_sorted(spark, f"{path}/meta")
    return used.agg(
        F.lit(meta.n_train_rows).cast("long").alias("n_train_rows"),
        F.lit(meta.n_stations_used).cast("long").alias("n_stations_used"),
        F.min("station").alias("first_station"),
        F.count(F.lit(1)).alias("n_listed"),
        F.lit(",".join(meta.features)).alias("features"),
    )


def _grid_columns(df: DataFrame) -> DataFrame:
    return df.select("station", d(), r("latitude"), r("longitude"), r("altitude", 4), r("y_pred_full", 3))


def grid_predict_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _global_model(spark, sf_dir)
    return _grid_columns(predict_grid_daily_with_global_model(stations(spark, sf_dir), **_paths(path), **HORIZON))


def grid_written_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under other column names, and through the Parquet sink."""
    path, _ = _global_model(spark, sf_dir)
    names = Columns(id="cell", lat="lat", lon="lon", alt="elev")
    grid = stations(spark, sf_dir).toDF("cell", "lat", "lon", "elev")
    out = new_folder(spark, "grid")
    predict_grid_daily_with_global_model(
        grid, columns=names, out_path=out, parquet_compression="gzip", **_paths(path), **MONTH
    )
    return spark.read.parquet(out).select("cell", d(), r("lat"), r("lon"), r("elev", 4), r("y_pred_full", 3))


def _customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("station"),
        (F.col("c_nationkey") + 10).cast("string").alias("latitude"),
        (F.col("c_nationkey") - 110).cast("string").alias("longitude"),
        F.col("c_acctbal").cast("string").alias("altitude"),
    )


def points_predict_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _global_model(spark, sf_dir)
    points = _customer_points(spark, sf_dir)
    return _grid_columns(predict_points_daily_with_global_model(spark, points, **_paths(path), **MONTH))


def point_predict_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _global_model(spark, sf_dir)
    out = predict_at_point_daily_with_global_model(
        spark, latitude=19.5, longitude=-99.25, altitude=2240, station=99, **_paths(path), **HORIZON
    )
    return _grid_columns(out)


def points_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize_points(spark, _customer_points(spark, sf_dir))
    return out.select("station", r("latitude"), r("longitude"), r("altitude", 4))


def grid_null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = observations(spark, sf_dir).select(
        "station",
        F.col("prec").alias("latitude"),
        F.when(F.col("prectotcorr") > 15, F.lit(float("nan"))).otherwise(F.col("longitude")).alias("longitude"),
    )
    return grid_nan_report(grid)


def grid_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("station"),
        (F.col("c_acctbal") / 100).alias("latitude"),
        (F.col("c_custkey") / 8).alias("longitude"),
        F.lit(5.0).alias("altitude"),
    )
    return dedupe_grid(grid).select("station", r("latitude"), r("longitude"), r("altitude"))


def grid_dedupe_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that lack a coordinate lose against complete ones."""
    grid = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("station"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 100).alias("latitude"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") / 8).alias("longitude"),
        F.lit(5.0).alias("altitude"),
    )
    return dedupe_grid(grid).select("station", r("latitude"), r("longitude"), r("altitude"))


# --- comparison of sources


def _sources(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    rows = observations(spark, sf_dir)
    predicted = raw_rows(spark, sf_dir).groupBy("station", "date").agg(
        (F.max("prectotcorr") + 1).alias("y_pred_full")
    )
    return compare_sources(rows, product_col="prectotcorr", predicted=predicted, **options)


def compare_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = _sources(spark, sf_dir, resample_to="D", agg="mean", **WINDOW)
    return _scores(scores, "station", "source")


def compare_monthly_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = _sources(spark, sf_dir, resample_to="M", agg="sum")
    return _scores(scores, "station", "source")


def compare_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned, _ = _sources(spark, sf_dir, resample_to="M", agg="mean", smooth=4)
    return aligned.select("station", d(), r("obs"), r("nasa"), r("rf"))


def compare_smoothed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned, _ = _sources(spark, sf_dir, resample_to=None, smooth=3)
    return aligned.select("station", d(), r("obs"), r("nasa"), r("rf"))


def compare_extra_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without stations belongs to the station that is asked for."""
    rows = observations(spark, sf_dir)
    extra = raw_rows(spark, sf_dir).groupBy(F.col("date").alias("day")).agg(F.avg("prec").alias("all_stations"))
    _, scores = compare_sources(
        rows,
        station_id=TARGET,
        product_col="prectotcorr",
        extra=extra,
        extra_date_col="day",
        extra_value_col="all_stations",
        resample_to="M",
        agg="mean",
    )
    return _scores(scores, "station", "source")


def compare_extra_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare list takes the dates of the observed series, in order."""
    rows = observations(spark, sf_dir).filter("prec is not null")
    n = rows.filter(F.col("station") == TARGET).count()
    aligned, _ = compare_sources(rows, station_id=TARGET, extra=[float(i % 31) for i in range(n)], resample_to=None)
    return aligned.filter("extra is not null").select("station", d(), r("obs"), r("extra"))


# --- sources and sinks


def roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'tables')}/obs.parquet"
    write_table(observations(spark, sf_dir), path, parquet_compression="zstd")
    out = read_observations(spark, path, covariates=["prectotcorr"])
    return out.select("station", d(), r("latitude"), r("longitude"), r("altitude", 4), r("prec"), r("prectotcorr"))


def roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'tables')}/obs.csv"
    write_table(observations(spark, sf_dir), path)
    out = read_observations(spark, path, covariates=["prectotcorr"])
    return out.select("station", d(), r("latitude"), r("longitude"), r("altitude", 4), r("prec"), r("prectotcorr"))


def roundtrip_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'metrics')}/scores"
    scores = score_grains(_pairs(spark, sf_dir))
    write_json(scores, path)
    return _scores(spark.read.schema(scores.schema).json(path), "station", "grain")


def roundtrip_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on which a forest and its saved copy differ: none."""
    rows = observations(spark, sf_dir)
    path = new_folder(spark, "forest")
    fitted, meta, _ = train_global_rf_target(
        rows, model_path=f"{path}/model", meta_path=f"{path}/meta", rf_params=SMALL_FOREST, **_TRAIN
    )
    grid = add_time_features(stations(spark, sf_dir).withColumn("date", F.to_date(F.lit("1999-07-01"))), "date", True)
    both = predict(fitted, grid, "before", ["station"]).join(
        predict(load_model(f"{path}/model"), grid, "after", ["station"]), "station"
    )
    return both.select("station", (F.col("before") == F.col("after")).alias("same"))


# --- trees that use their features


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations whose target is a step function of place and calendar."""
    steps = (
        F.when(F.col("latitude") >= 23.5, 200).otherwise(0)
        + F.when(F.col("longitude") >= -99, 0).otherwise(60)
        + F.when(F.col("altitude") >= 1200, 0).otherwise(25)
        + F.when(F.year("date") >= 1999, 9).otherwise(0)
        + F.when(F.month("date") >= 7, 4).otherwise(0)
    )
    return observations(spark, sf_dir).withColumn("prec", F.when(F.col("prec").isNotNull(), steps.cast("double")))


def loso_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _, _ = loso_train_predict_station(_planted(spark, sf_dir), TARGET, rf_params=TREE, add_cyclic=True)
    return out.select(d(), "station", r("y_true"), r("y_pred"))


def loso_fast_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _, _ = loso_predict_full_series_fast(
        _planted(spark, sf_dir),
        TARGET,
        rf_params=TREE,
        k_neighbors=90,
        include_target_pct=10.0,
        train_start=WINDOW["start"],
        train_end=WINDOW["end"],
        **HORIZON,
    )
    return out.select(d(), "station", r("y_pred_full"), r("y_true"))


def loso_model_and_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another regressor, on the month alone."""
    rows = observations(spark, sf_dir).withColumn("prec", F.when(F.col("prec").isNotNull(), F.month("date").cast("double")))
    out, _, _, features = loso_train_predict_station(
        rows, TARGET, model=DecisionTreeRegressor(maxDepth=6), feature_cols=["month"], **WINDOW
    )
    return out.select(d(), r("y_pred"), F.lit(",".join(features)).alias("features"))


def evaluate_var_col_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that follows a covariate: no error is left where the covariate is known."""
    rows = observations(spark, sf_dir)
    value = F.when(F.col("prectotcorr") >= 15, 8.0).otherwise(1.0)
    rows = rows.withColumn("prec", F.when(F.col("prec").isNotNull(), value))
    rows = rows.withColumn("prectotcorr", F.when(F.dayofmonth("date") > 3, F.col("prectotcorr")))
    out = evaluate_all_stations_fast(
        rows, var_col="PRECTOTCORR", station_ids=[2, 3, 5], rf_params=TREE, add_cyclic=True, include_target_pct=20.0, **WINDOW
    )
    return out.select("station", "n_rows", r("MAE_d"), r("RMSE_m"), r("R2_d"))


def evaluate_order_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoreboard's order, as a rank."""
    out = evaluate_all_stations(
        observations(spark, sf_dir), rf_params=MEAN_MODEL, parallelism=FITS, order_by=("MAE_d", False), **WINDOW
    )
    place = F.row_number().over(Window.orderBy("_at")).alias("place")
    return out.withColumn("_at", F.monotonically_increasing_id()).select("station", r("MAE_d"), place)


def evaluate_map_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every station is trained on itself, which is left out, and on the two that follow by number; the last has none."""
    rows = observations(spark, sf_dir)
    following = F.explode(F.array(*[F.col("station") + n for n in range(3)])).alias("neighbor")
    out = evaluate_all_stations_fast(
        rows,
        rf_params=MEAN_MODEL,
        k_neighbors=2,
        neighbor_map=rows.select("station").distinct().select("station", following),
        grow_together=True,
        **WINDOW,
    )
    return out.select("station", "n_rows", *[r(c) for c in SCORE_COLUMNS])


def evaluate_log_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that was broken off after the stations of even numbers goes on from its log to all; the log's rows at the
    end. A station without rows is tried, and logged, again."""
    rows, path = observations(spark, sf_dir), f"{new_folder(spark, 'log')}/log.csv"
    options = dict(rf_params=MEAN_MODEL, k_neighbors=2, log_csv=path, flush_every=400, grow_together=True, **WINDOW)
    evaluate_all_stations_fast(rows, regex="[02468]$", **options)
    board = evaluate_all_stations_fast(rows, **options)
    stored = spark.read.schema(board.schema).csv(path, header=True).dropDuplicates(["station"])
    return stored.select("station", "n_rows", *[r(c) for c in SCORE_COLUMNS])


def full_series_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A covariate table with holes: a row for every day, without a prediction where the table has none."""
    rows = observations(spark, sf_dir)
    whole = rows.groupBy("date").agg(F.max("prectotcorr").alias("prectotcorr")).filter(F.dayofmonth("date") % 3 != 0)
    out, _, _, _ = loso_predict_full_series_fast(
        rows, TARGET, rf_params=MEAN_MODEL, var_cols=["prectotcorr"], covariates=whole, **HORIZON
    )
    return out.select(d(), "station", r("y_pred_full"), r("y_true"))


def _tree_paths(spark: SparkSession, sf_dir: str, **params) -> dict[str, str]:
    paths = _paths(new_folder(spark, "tree"))
    train_global_rf_target(_planted(spark, sf_dir), rf_params=TREE | params, start="1995-01-01", end="2001-12-31", min_rows_per_station=1, **paths)
    return paths


def grid_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _tree_paths(spark, sf_dir)
    return predict_grid_daily_with_global_model(stations(spark, sf_dir), **paths, **HORIZON)


def grid_tree_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_columns(grid_tree(spark, sf_dir))


def grid_renamed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under other column names: a swapped coordinate would give other steps."""
    grid = stations(spark, sf_dir).toDF("cell", "y", "x", "z")
    names = Columns(id="cell", lat="y", lon="x", alt="z")
    out = predict_grid_daily_with_global_model(grid, columns=names, **_tree_paths(spark, sf_dir), **MONTH)
    return out.select("cell", d(), r("y"), r("x"), r("z", 4), r("y_pred_full", 3))


def grid_forest_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three equal trees, each in tasks of its own."""
    paths = _tree_paths(spark, sf_dir, n_estimators=3)
    out = predict_grid_daily_with_global_model(stations(spark, sf_dir), nodes_per_task=1, **paths, **MONTH)
    return _grid_columns(out)


def points_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at the stations' places, under ids of their own."""
    points = stations(spark, sf_dir).select(
        (F.col("station") + 500).alias("station"), *[F.col(c).cast("string").alias(c) for c in COLUMNS.coords]
    )
    return _grid_columns(predict_points_daily_with_global_model(spark, points, **_tree_paths(spark, sf_dir), **MONTH))


QUERIES: dict[str, Query] = {
    "dirty_dates": dirty_dates,
    "time_features": time_features,
    "narrow_time_features": narrow_time_features,
    "clip_counts": clip_counts,
    "valid_counts": valid_counts,
    "select_prefix_regex": select_prefix_regex,
    "select_custom": select_custom,
    "station_centroids": station_centroids,
    "station_medians_ranged": station_medians_ranged,
    "knn_neighbors": knn_neighbors,
    "knn_quadtree": knn_quadtree,
    "neighbor_corr": neighbor_corr,
    "neighbor_corr_one": neighbor_corr_one,
    "leave_one_out_counts": leave_one_out_counts,
    "slice_station": slice_station,
    "leak_sample": leak_sample,
    "score_daily": score_daily,
    "score_weekly_sum": _score("W", "sum"),
    "score_monthly_sum": _score("M", "sum"),
    "score_quarterly_mean": _score("Q", "mean"),
    "score_annual_mean": _score("Y", "mean"),
    "score_monthly_median": _score("M", "median"),
    "resampled_months": resampled_months,
    "resampled_quarters": resampled_quarters,
    "scoreboard_sum": _scoreboard("sum"),
    "scoreboard_mean": _scoreboard("mean"),
    "scoreboard_median": _scoreboard("median"),
    "loso_observed_d0": loso_observed_d0,
    "loso_full_series_d0": loso_full_series_d0,
    "loso_fast_knn_d0": loso_fast_knn_d0,
    "loso_full_scores_d0": loso_full_scores_d0,
    "evaluate_all_d0": evaluate_all_d0,
    "evaluate_fast_knn_d0": evaluate_fast_knn_d0,
    "evaluate_together_d0": evaluate_together_d0,
    "export_filled_d0": export_filled_d0,
    "export_series_d0": export_series_d0,
    "export_knn_d0": export_knn_d0,
    "export_covariates_d0": export_covariates_d0,
    "manifest_d0": manifest_d0,
    "export_compact_one_d0": export_compact_one_d0,
    "train_summary": train_summary,
    "train_metadata": train_metadata,
    "grid_predict_d0": grid_predict_d0,
    "grid_written_d0": grid_written_d0,
    "points_predict_d0": points_predict_d0,
    "point_predict_d0": point_predict_d0,
    "points_grid": points_grid,
    "grid_null_report": grid_null_report,
    "grid_dedupe": grid_dedupe,
    "compare_scores": compare_scores,
    "compare_monthly_sum": compare_monthly_sum,
    "compare_smoothed": compare_smoothed,
    "compare_smoothed_rows": compare_smoothed_rows,
    "roundtrip_parquet": roundtrip_parquet,
    "roundtrip_csv": roundtrip_csv,
    "roundtrip_metrics_json": roundtrip_metrics_json,
    "roundtrip_model": roundtrip_model,
    "knn_targets": knn_targets,
    "grid_dedupe_nulls": grid_dedupe_nulls,
    "compare_extra_table": compare_extra_table,
    "compare_extra_vector": compare_extra_vector,
    "loso_tree": loso_tree,
    "loso_fast_tree": loso_fast_tree,
    "loso_model_and_features": loso_model_and_features,
    "evaluate_var_col_tree": evaluate_var_col_tree,
    "evaluate_order_d0": evaluate_order_d0,
    "evaluate_map_d0": evaluate_map_d0,
    "evaluate_log_d0": evaluate_log_d0,
    "full_series_covariates": full_series_covariates,
    "grid_tree": grid_tree_rounded,
    "grid_renamed_tree": grid_renamed_tree,
    "points_tree": points_tree,
    "grid_forest_dealt": grid_forest_dealt,
}
