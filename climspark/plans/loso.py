"""Leave-one-station-out models for one station."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climspark.functions.calendar import (
    DateLike,
    add_time_features,
    clip_dates,
    count_days,
    ensure_datetime,
    explode_days,
    prepare_dates,
)
from climspark.operators.neighbors import build_station_kneighbors, neighbor_frame
from climspark.operators.sampling import sample_target_for_training
from climspark.operators.scoring import score_grains
from climspark.operators.stations import leave_one_out, station_positions, valid_rows
from climspark.plans.forest import fit_pool, forest, predict
from climspark.schema import Columns, base_features, nan_to_null, require_columns, resolve_columns
from climspark.sources.staging import stage
from climspark.sources.tables import write_json, write_table

CALENDAR_PARTS = ("year", "month", "doy", "doy_sin", "doy_cos")


def feature_frame(
    data: DataFrame,
    columns: Columns,
    *,
    add_cyclic: bool = False,
    feature_cols: Sequence[str] | None = None,
    var_cols: str | Iterable[str] | None = None,
    start: DateLike | None = None,
    end: DateLike | None = None,
) -> tuple[DataFrame, list[str]]:
    """Clean, clipped rows with calendar features, pruned to what a model needs; and its inputs."""
    require_columns(data, [columns.id, columns.date, *columns.coords, columns.target])
    covariates = resolve_columns(data, var_cols)
    features = list(feature_cols) if feature_cols is not None else base_features(columns, add_cyclic, covariates)
    own = [c for c in features if c not in CALENDAR_PARTS or c in data.columns]
    require_columns(data, own)
    keep = dict.fromkeys([columns.id, columns.date, *columns.coords, columns.target, *own])
    rows = nan_to_null(prepare_dates(data.select(*keep), columns.date, start, end))
    cyclic = add_cyclic or any(c in features for c in ("doy_sin", "doy_cos"))
    return add_time_features(rows, columns.date, cyclic), features


def horizon(
    positions: DataFrame,
    columns: Columns,
    features: Sequence[str],
    start: DateLike,
    end: DateLike,
    covariates: DataFrame | None = None,
    partitions: int = 0,
) -> DataFrame:
    """Model inputs for every day of ``[start, end]`` at each station's median position; of many stations, unfolded on
    that many ``partitions``.

    Covariates among the features have no value on unobserved days: they must come from a table
    keyed by date (and station, if it has that column).
    """
    days = explode_days(positions, columns.date, start, end, [columns.id], partitions)
    days = add_time_features(days, columns.date, any(c.startswith("doy_") for c in features))
    return join_covariates(days, columns.id, columns.date, features, covariates)


def join_covariates(
    days: DataFrame, id_col: str, date_col: str, features: Sequence[str], covariates: DataFrame | None
) -> DataFrame:
    """Add the features that ``days`` lacks from a covariate table. Days it does not hold keep NULL, and so does their
    prediction: a full series has a row for every day."""
    lacking = [c for c in features if c not in days.columns]
    if not lacking:
        return days
    have = [] if covariates is None else resolve_columns(covariates, lacking)
    if len(have) < len(lacking):
        raise ValueError(
            f"Unobserved days have no {lacking}: pass `covariates`, a table keyed by "
            "date (and station) that holds them."
        )
    keys = [c for c in (id_col, date_col) if c in covariates.columns]
    named = [F.col(h).cast("double").alias(name) for h, name in zip(have, lacking)]
    return days.join(nan_to_null(covariates.select(*keys, *named)), keys, "left")


def require_unique_days(covariates: DataFrame | None, columns: Columns) -> None:
    """Repeated keys among the covariates would give a day several rows. One aggregate, before any fit."""
    if covariates is None:
        return
    keys = [c for c in (columns.id, columns.date) if c in covariates.columns]
    if not covariates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).isEmpty():
        raise ValueError(f"The covariates hold a key {keys} more than once: a day would get several rows.")


def attach_observed(
    predictions: DataFrame,
    observed: DataFrame,
    columns: Columns,
    start: DateLike | None = None,
    end: DateLike | None = None,
) -> DataFrame:
    """``(date, station, y_pred_full, y_true)``: left join, so duplicate days multiply.

    Observations outside the predicted span are left out first, on the bare date column.
    """
    truth = clip_dates(observed, columns.date, start, end).select(
        F.col(columns.id).alias("station"),
        F.col(columns.date).cast("timestamp_ntz").alias("_at"),
        F.col(columns.target).cast("double").alias("y_true"),
    )
    left = predictions.withColumn("_at", F.col(columns.date).cast("timestamp_ntz"))
    return left.join(truth, ["station", "_at"], "left").select(columns.date, "station", "y_pred_full", "y_true")


def observed_rows(
    observed: DataFrame, columns: Columns, start: DateLike | None = None, end: DateLike | None = None
) -> DataFrame:
    """``(station, _day, y_true)`` of the observations that lie on a day of the span: those off midnight match none."""
    rows = clip_dates(observed, columns.date, start, end)
    day = F.to_date(F.col(columns.date))
    return rows.filter(F.col(columns.date).cast("timestamp_ntz") == day.cast("timestamp_ntz")).select(
        F.col(columns.id).cast("long").alias("station"), day.alias("_day"), F.col(columns.target).cast("double").alias("y_true")
    )


def day_spans(stations: DataFrame, rows: DataFrame, start: DateLike, end: DateLike, tasks: int) -> DataFrame:
    """``(station, _first, _last, y_true)`` and the other columns of ``stations`` (a row a station): spans that hold every
    day of ``[start, end]``, the first day with a row of ``rows`` if the span begins with one.

    The rows of a station are put in order, and each reaches to the day before its successor; a mark before ``start``
    reaches to the first of them. So observations are shuffled once, days are not, and duplicate days multiply. Stations
    that ``stations`` lacks fall out. All rows of a station meet in one of the ``tasks``.
    """
    lo, hi = (F.lit(str(d)).cast("date") for d in (start, end))
    given = F.struct(*[c for c in stations.columns if c != "station"])
    marks = stations.select("station", F.date_sub(lo, 1).alias("_day"), F.lit(None).cast("double").alias("y_true"), given.alias("_given"))
    marks = marks.unionByName(rows, allowMissingColumns=True).repartition(tasks, "station")
    ordered = Window.partitionBy("station").orderBy("_day")
    before = F.date_sub(F.lead("_day", 1).over(ordered), 1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = marks.withColumns({"_last": F.coalesce(before, hi), "_given": F.first("_given").over(so_far)})
    spans = spans.filter(F.col("_given").isNotNull()).select(
        "station", F.greatest("_day", lo).alias("_first"), F.greatest("_day", "_last").alias("_last"), "y_true", "_given.*"
    )
    return spans.filter(F.col("_last") >= F.col("_first"))


def unfold_spans(spans: DataFrame, date_col: str) -> DataFrame:
    """A row for every day of the spans of ``day_spans``; the value is that of the first."""
    days = spans.withColumn(date_col, F.explode(F.sequence("_first", "_last")))
    return days.withColumn("y_true", F.when(F.col(date_col) == F.col("_first"), F.col("y_true"))).drop("_first", "_last")


def warn_unused_map(k_neighbors: int | None, neighbor_map) -> None:
    if neighbor_map is not None and k_neighbors is None:
        warnings.warn("neighbor_map is ignored because k_neighbors is not set.", stacklevel=3)


def _neighbors_of(
    data: DataFrame, station_id: int, columns: Columns, k_neighbors: int, neighbor_map
) -> list[int]:
    """The station's k neighbours, as literals: so the filter on them reaches the scan."""
    table = (
        build_station_kneighbors(data, columns=columns, k=k_neighbors, targets=[station_id])
        if neighbor_map is None
        else neighbor_frame(data, neighbor_map)
    )
    return [r[0] for r in table.filter(F.col("station") == int(station_id)).select("neighbor").distinct().collect()]


def _training_pool(
    features_of: DataFrame,
    station_id: int,
    columns: Columns,
    features: Sequence[str],
    pct: float,
    seed: int,
    neighbors: Sequence[int] | None = None,
) -> DataFrame:
    """Valid rows of the other stations (or just the neighbours) plus the leaked sample."""
    rest, _ = leave_one_out(features_of, station_id, columns.id)
    if neighbors is not None:
        rest = rest.filter(F.col(columns.id).isin(list(neighbors)))
    pool = valid_rows(rest, features, columns.target)
    if pct <= 0:
        return pool
    leak = sample_target_for_training(
        features_of,
        columns=columns,
        feature_cols=features,
        station_id=station_id,
        include_target_pct=pct,
        random_state=seed,
    )
    return pool.unionByName(leak)


def loso_train_predict_station(
    data: DataFrame,
    station_id: int,
    *,
    columns: Columns = Columns(),
    feature_cols: Sequence[str] | None = None,
    add_cyclic: bool = False,
    model: Estimator | None = None,
    rf_params: Mapping[str, object] | None = None,
    agg_for_metrics: str = "sum",
    start: DateLike | None = None,
    end: DateLike | None = None,
    include_target_pct: float = 0.0,
    include_target_seed: int = 42,
    save_predictions_path: str | None = None,
    save_metrics_path: str | None = None,
    parquet_compression: str = "snappy",
) -> tuple[DataFrame, DataFrame, PipelineModel, list[str]]:
    """Train on the other stations, predict the station's observed days.

    Returns ``(date, station, y_true, y_pred)``, long scores, the model and its inputs. Only the
    predicted days are clipped to ``[start, end]``; the training pool keeps all dates.
    """
    frame, features = feature_frame(data, columns, add_cyclic=add_cyclic, feature_cols=feature_cols)
    _, own = leave_one_out(frame, station_id, columns.id)
    own = clip_dates(own, columns.date, start, end)
    if own.isEmpty():
        raise ValueError("The station was not observed in this window.")
    pool = _training_pool(frame, station_id, columns, features, include_target_pct, include_target_seed)
    fitted = fit_pool(pool, features, columns.target, model or forest(rf_params), columns=columns)
    test = valid_rows(own, features, columns.target)
    out = predict(fitted, test, "y_pred", [columns.date, columns.id, columns.target]).select(
        columns.date,
        F.col(columns.id).alias("station"),
        F.col(columns.target).cast("double").alias("y_true"),
        "y_pred",
    )
    out = stage(out, "predictions")
    scores = score_grains(out, date_col=columns.date, agg=agg_for_metrics)
    write_table(out.orderBy(columns.date), save_predictions_path, parquet_compression=parquet_compression)
    write_json(scores, save_metrics_path)
    return out, scores, fitted, features


def loso_predict_full_series_fast(
    data: DataFrame,
    station_id: int,
    *,
    columns: Columns = Columns(),
    start: DateLike = "1961-01-01",
    end: DateLike = "2023-12-31",
    train_start: DateLike | None = None,
    train_end: DateLike | None = None,
    model: Estimator | None = None,
    rf_params: Mapping[str, object] | None = None,
    add_cyclic: bool = False,
    feature_cols: Sequence[str] | None = None,
    var_cols: str | Iterable[str] | None = None,
    covariates: DataFrame | None = None,
    k_neighbors: int | None = None,
    neighbor_map: DataFrame | Mapping[int, Iterable[int]] | None = None,
    include_target_pct: float = 0.0,
    include_target_seed: int = 42,
    agg_for_metrics: str = "sum",
    save_series_path: str | None = None,
    save_metrics_path: str | None = None,
    parquet_compression: str = "snappy",
) -> tuple[DataFrame, DataFrame, PipelineModel, list[str]]:
    """Train on the other stations (or the k nearest), predict every day of ``[start, end]``.

    The pool and the leaked sample respect the training window; ``y_true`` does not. Returns
    ``(date, station, y_pred_full, y_true)``, scores on the overlap, the model and its inputs.
    A ``neighbor_map`` counts only together with ``k_neighbors``.
    """
    count_days(start, end)
    require_columns(data, [columns.id, columns.date, *columns.coords, columns.target])
    require_unique_days(covariates, columns)
    _, raw = leave_one_out(data, station_id, columns.id)
    own = nan_to_null(ensure_datetime(raw, columns.date))
    positions = station_positions(own, columns)
    if positions.isEmpty():
        raise ValueError(f"Station {station_id} does not occur in the data.")
    frame, features = feature_frame(
        data,
        columns,
        add_cyclic=add_cyclic,
        feature_cols=feature_cols,
        var_cols=var_cols,
        start=train_start,
        end=train_end,
    )
    days = horizon(positions, columns, features, start, end, covariates)
    neighbors = None
    warn_unused_map(k_neighbors, neighbor_map)
    if k_neighbors is not None:
        neighbors = _neighbors_of(frame, station_id, columns, k_neighbors, neighbor_map)
    pool = _training_pool(frame, station_id, columns, features, include_target_pct, include_target_seed, neighbors)
    fitted = fit_pool(pool, features, columns.target, model or forest(rf_params), columns=columns)
    predicted = predict(fitted, days, "y_pred_full", [columns.date, F.col(columns.id).alias("station")])
    series = stage(attach_observed(predicted, own, columns, start, end), "series")
    scores = score_grains(series, date_col=columns.date, yhat_col="y_pred_full", agg=agg_for_metrics)
    write_table(series.orderBy(columns.date), save_series_path, parquet_compression=parquet_compression)
    write_json(scores, save_metrics_path)
    return series, scores, fitted, features


def loso_predict_full_series(
    data: DataFrame, station_id: int, **options
) -> tuple[DataFrame, DataFrame, PipelineModel, list[str]]:
    """The full series without training window or neighbour restriction."""
    refused = {"train_start", "train_end", "k_neighbors", "neighbor_map", "var_cols"} & set(options)
    if refused:
        raise TypeError(f"Use loso_predict_full_series_fast for {sorted(refused)}")
    return loso_predict_full_series_fast(data, station_id, **options)
