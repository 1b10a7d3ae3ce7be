"""Leave-one-station-out over many stations: evaluation and export.

Every target needs a model of its own, and each model is a distributed Spark ML fit, unless one pass makes
the models of all. A bounded pool of driver threads keeps several fits in flight. Their predictions go to the shared folder;
joins, scores and outputs are then made for all stations in one job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cache

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climspark.functions.calendar import DateLike, clip_dates, count_days, ensure_datetime, explode_days
from climspark.operators.neighbors import build_station_kneighbors, neighbor_frame
from climspark.operators.sampling import draw_sample
from climspark.operators.scoring import SCORE_COLUMNS, score_grains, widen_scores
from climspark.operators.stations import select_stations, station_positions, valid_rows
from climspark.plans.forest import fit_pool, forest, predict
from climspark.plans.growth import Growth, edges_of, grown_together, pool_means, root_means
from climspark.plans.loso import (
    CALENDAR_PARTS,
    attach_observed,
    day_spans,
    feature_frame,
    horizon,
    join_covariates,
    loso_predict_full_series_fast,
    observed_rows,
    require_unique_days,
    unfold_spans,
    warn_unused_map,
)
from climspark.schema import Columns, all_present, nan_to_null, require_columns, resolve_columns
from climspark.sources.staging import MIN_TASKS, ROWS_PER_TASK, StagedFeatures, new_folder, stage, stage_features
from climspark.sources.tables import check_format, write_json, write_table

# Most fits in flight, and rows up to which several whole-table pools may be held at once.
MAX_FITS = 64
SMALL_POOL_ROWS = 100_000_000
# Targets up to which each gets a fit of its own, where one pass over all of them makes the same forests.
FEW_FITS = 16
# Rows of covariates by date alone up to which every task gets them all: more than 2,000 years of days.
FEW_DAYS = 1_000_000
# A logged pass that ends within so many seconds is followed by one of twice as many stations.
QUICK_PASS = 60.0
OUTCOME_SCHEMA = "station long, seconds double, error string"
COMBINED_SCHEMAS = ("input_like", "compact")


@dataclass(frozen=True)
class Outcome:
    station: int
    seconds: float
    problem: Exception | None = None

    @property
    def error(self) -> str | None:
        if self.problem is None:
            return None
        return str(self.problem).splitlines()[0] if str(self.problem) else repr(self.problem)


class NotFitted(ValueError):
    """A station for which there is nothing to fit or to predict."""


def run_targets(
    spark: SparkSession, targets: Sequence[int], work: Callable[[int], None], parallelism: int
) -> list[Outcome]:
    """Run ``work`` per target from a bounded thread pool; a failure becomes part of the outcome.

    If every target fails, and not for want of rows, the first cause is raised: then it is no station's fault.
    """

    def guarded(station: int) -> Outcome:
        began = time.monotonic()
        try:
            work(station)
        except Exception as problem:  # noqa: BLE001 - one station must not stop the others
            return Outcome(station, time.monotonic() - began, problem)
        return Outcome(station, time.monotonic() - began)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        outcomes = list(pool.map(inheritable_thread_target(spark)(guarded), targets))
    causes = [o.problem for o in outcomes if o.problem is not None and not isinstance(o.problem, ValueError)]
    if causes and len(causes) == len(outcomes):
        raise causes[0]
    return outcomes


def _fits_in_flight(staged: StagedFeatures, by_neighbors: bool, requested: int | None) -> int:
    """How many fits to run at once, unless the caller says.

    A fit keeps its pool in executor storage. Pools of a few neighbours are small and use few
    tasks, so many of them are needed to fill a cluster; pools of the whole table run one by one
    once they are large.
    """
    if requested is not None:
        return requested
    cores = staged.frame.sparkSession.sparkContext.defaultParallelism
    if by_neighbors:
        return max(4, min(MAX_FITS, cores // MIN_TASKS))
    return 4 if staged.rows <= SMALL_POOL_ROWS else 1


def _one_pass(targets: Sequence[int], model, rf_params) -> Growth | None:
    """How all targets' forests are made in one pass, if they are many and the forests are those of a fit each."""
    return Growth.same_by_spark(rf_params) if model is None and len(targets) > FEW_FITS else None


def _outcomes(spark: SparkSession, outcomes: Sequence[Outcome]) -> DataFrame:
    return spark.createDataFrame([(o.station, o.seconds, o.error) for o in outcomes], OUTCOME_SCHEMA)


def _target_ids(selected: DataFrame, id_col: str) -> list[int]:
    """The ids to fit. The driver submits a fit for each, so the list is as long as its work."""
    return [r[0] for r in selected.select(F.col(id_col).cast("long")).orderBy(id_col).collect()]


def _id_table(spark: SparkSession, targets: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in targets], "station long")


def _present(df: DataFrame, id_col: str, targets: Sequence[int]) -> set[int]:
    """Those of the targets that have rows in ``df``."""
    wanted = _id_table(df.sparkSession, targets)
    rows = df.join(wanted, F.col(id_col).cast("long") == F.col("station"), "left_semi") if id_col != "station" else df.join(
        wanted, "station", "left_semi"
    )
    return {r[0] for r in rows.select(F.col(id_col).cast("long")).distinct().collect()}


def _neighbor_table(data, targets: Sequence[int], columns: Columns, k: int | None, neighbor_map) -> DataFrame | None:
    """(station, neighbor) of the targets, staged; or None without a neighbour restriction."""
    warn_unused_map(k, neighbor_map)
    if k is None:
        return None
    wanted = _id_table(data.sparkSession, targets)
    if neighbor_map is None:
        table = build_station_kneighbors(data, columns=columns, k=k, targets=wanted)
    else:
        table = neighbor_frame(data, neighbor_map).join(wanted, "station", "left_semi")
    pairs = table.select(F.col("station").cast("long"), F.col("neighbor").cast("long")).distinct()
    return stage(pairs.repartition("station").sortWithinPartitions("station"), "neighbors")


def _rows_needed(frame: DataFrame, targets: Sequence[int], columns: Columns, neighbors: DataFrame | None) -> DataFrame:
    """All rows, or with a neighbour restriction those of the targets and of their neighbours."""
    if neighbors is None:
        return frame
    wanted = neighbors.select(F.col("neighbor").alias("_wanted"))
    wanted = wanted.unionByName(_id_table(frame.sparkSession, targets).select(F.col("station").alias("_wanted"))).distinct()
    return frame.join(wanted, F.col(columns.id).cast("long") == F.col("_wanted"), "left_semi")


def _leaked(
    staged: DataFrame, targets: Sequence[int], columns: Columns, pct: float, seed: int
) -> DataFrame | None:
    """The leaked samples of the targets, drawn once from the staged rows."""
    if pct <= 0:
        return None
    wanted = _id_table(staged.sparkSession, targets).select(F.col("station").alias("_wanted"))
    own = staged.join(wanted, F.col(columns.id).cast("long") == F.col("_wanted"), "left_semi")
    sample = draw_sample(own, columns, pct=pct, seed=seed)
    return stage(sample.repartition(columns.id).sortWithinPartitions(columns.id, columns.date), "leak")


def _pool_of(
    staged: StagedFeatures,
    leaked: DataFrame | None,
    columns: Columns,
    station: int,
    neighbors: DataFrame | None,
) -> DataFrame:
    """Rows that train the station's model: the others (or its neighbours) and its leaked sample.

    Each fit looks up its own k neighbours in the staged table."""
    if neighbors is None:
        rows = staged.frame
    else:
        rows = staged.rows_of([r[0] for r in neighbors.filter(F.col("station") == station).select("neighbor").collect()])
    pool = rows.filter(F.col(columns.id) != station)
    return pool if leaked is None else pool.unionByName(leaked.filter(F.col(columns.id) == station))


def _read_parts(spark: SparkSession, root: str, outcomes: Sequence[Outcome], schema: T.StructType) -> DataFrame:
    """Predictions below one root, a folder for each station whose fit succeeded."""
    if not _succeeded(outcomes):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root).select(*schema.names)


def _succeeded(outcomes: Sequence[Outcome]) -> list[int]:
    return [o.station for o in outcomes if o.error is None]


def _evaluate(
    staged: StagedFeatures,
    leaked: DataFrame | None,
    targets: Sequence[int],
    columns: Columns,
    features: Sequence[str],
    *,
    rf_params,
    model,
    agg: str,
    test_window: tuple[DateLike | None, DateLike | None],
    neighbors: DataFrame | None,
    parallelism: int | None,
    log_path: str | None,
    flush_every: int,
    finish: Callable[[DataFrame], DataFrame],
    growth: Growth | None = None,
    run_options: str = "",
) -> DataFrame:
    """Fit, predict and score every target; ``finish`` shapes a scoreboard chunk for output.

    Stations that a log at ``log_path`` lists without an error are done: their rows are taken from there, if the run that
    wrote them had the same ``run_options``.
    """
    spark = staged.frame.sparkSession
    root = new_folder(spark, "predictions")
    date_type = staged.frame.schema[columns.date].dataType
    schema = T.StructType(
        [
            T.StructField("station", T.LongType()),
            T.StructField("date", date_type),
            T.StructField("y_true", T.DoubleType()),
            T.StructField("y_pred", T.DoubleType()),
        ]
    )

    parallelism = _fits_in_flight(staged, neighbors is not None, parallelism)
    whole = test_window == (None, None)
    tested = staged.counts if whole else clip_dates(staged.frame, columns.date, *test_window)
    testable = _present(tested, columns.id, targets)

    def work(station: int) -> None:
        if station not in testable:
            raise NotFitted("The station was not observed in this window.")
        test = clip_dates(staged.rows_of([station]), columns.date, *test_window)
        pool = _pool_of(staged, leaked, columns, station, neighbors)
        fitted = fit_pool(pool, features, columns.target, model or forest(rf_params), columns=columns)
        keep = [
            F.col(columns.date).alias("date"),
            F.col(columns.target).cast("double").alias("y_true"),
        ]
        predict(fitted, test, "y_pred", keep).write.parquet(f"{root}/{chunk_of[station]}/station={station}")

    @cache
    def means() -> tuple[DataFrame, set[int]]:
        """Once for all groups: the means of all targets' pools, and the targets that have one."""
        found = root_means(staged, leaked, neighbors, targets, columns)
        return found, {r[0] for r in found.select("target").collect()}

    @cache
    def edges() -> list:
        return edges_of(staged, features, growth)

    def together(group: Sequence[int]) -> tuple[list[Outcome], DataFrame]:
        """All targets of the group in one pass; the time is theirs in equal parts."""
        began = time.monotonic()
        able = [t for t in group if t in testable]
        wanted = F.broadcast(_id_table(spark, able).select(F.col("station").alias("_target")))
        own = clip_dates(staged.frame, columns.date, *test_window)
        tests = own.join(wanted, F.col(columns.id).cast("long") == F.col("_target")).select(
            F.col("_target").alias("target"),
            F.col(columns.date).alias("date"),
            F.col(columns.target).cast("double").alias("y_true"),
            *features,
        )
        if growth.uncut:
            found, with_pool = means()
            predicted = tests.join(found, "target").select("target", "date", "y_true", F.col("mean").alias("y_pred"))
        else:
            predicted, with_pool = grown_together(staged, leaked, neighbors, able, tests, columns, features, growth, edges())
        seconds = (time.monotonic() - began) / max(1, len(group))

        def problem(station: int) -> Exception | None:
            if station not in testable:
                return NotFitted("The station was not observed in this window.")
            return None if station in with_pool else ValueError("No row is left to train on.")

        outcomes = [Outcome(t, seconds, problem(t)) for t in group]
        return outcomes, predicted.withColumnRenamed("target", "station")

    def run(group: Sequence[int], chunk: int) -> DataFrame:
        if growth is None:
            outcomes = run_targets(spark, group, work, parallelism)
            return scoreboard(outcomes, _read_parts(spark, f"{root}/{chunk}", outcomes, schema))
        return scoreboard(*together(group))

    def scoreboard(outcomes: Sequence[Outcome], predictions: DataFrame) -> DataFrame:
        scores = widen_scores(score_grains(predictions, ["station"], agg=agg))
        rows = _outcomes(spark, outcomes).join(scores, "station", "left")
        return stage(finish(rows.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))), "scoreboard")

    if log_path is None:
        chunk_of = dict.fromkeys(targets, 0)
        return run(targets, 0)
    _claim_log(spark, log_path, run_options)
    logged = _read_log(spark, log_path)
    if logged is not None:
        logged = stage(logged.filter(F.col("error").isNull()), "logged")
        done = _present(logged, "station", targets)
        targets = [t for t in targets if t not in done]
        boards = [logged.join(_id_table(spark, sorted(done)), "station", "left_semi")]
    else:
        boards = []
    chunk_of = {t: i // flush_every for i, t in enumerate(targets)}
    at, size = 0, flush_every
    while at < len(targets):
        began = time.monotonic()
        boards.append(run(targets[at : at + size], at // flush_every))
        write_table(boards[-1], log_path, mode="append")
        at += size
        # A pass reads the staged rows whatever its stations: where it is quick, its jobs are what it costs.
        if growth is not None and time.monotonic() - began < QUICK_PASS:
            size *= 2
    if not boards:
        return scoreboard([], spark.createDataFrame([], schema))
    table = boards[0]
    for more in boards[1:]:
        table = table.unionByName(more)
    return table


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _described(model) -> list:
    """An estimator's kind and parameters."""
    params = model.extractParamMap() if hasattr(model, "extractParamMap") else {}
    return [type(model).__name__, {p.name: str(v) for p, v in params.items()}]


def _claim_log(spark: SparkSession, path: str, options: str) -> None:
    """Keep the options of a run beside its log. A log of a run with other options must not be gone on from: its scores
    are of other models."""
    beside = f"{path}.options"
    if not _exists(spark, beside):
        spark.createDataFrame([(options,)], "options string").coalesce(1).write.text(beside)
        return
    held = [r[0] for r in spark.read.text(beside).collect()]
    if held != [options]:
        raise ValueError(f"The log at {path} is of a run with other options: {held} instead of {[options]}.")


def _read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The scoreboard rows that an earlier run appended to ``path``; None if there is no such log."""
    if not _exists(spark, path):
        return None
    return spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)


def evaluate_all_stations(
    data: DataFrame,
    *,
    columns: Columns = Columns(),
    model=None,
    rf_params: Mapping[str, object] | None = None,
    agg_for_metrics: str = "sum",
    start: DateLike = "1961-01-01",
    end: DateLike = "2023-12-31",
    add_cyclic: bool = False,
    feature_cols: Sequence[str] | None = None,
    order_by: tuple[str, bool] | None = ("RMSE_d", True),
    include_target_pct: float = 0.0,
    include_target_seed: int = 42,
    parallelism: int | None = None,
    save_table_path: str | None = None,
    parquet_compression: str = "snappy",
) -> DataFrame:
    """Scoreboard of every station, trained on all dates of the others and tested in the window.

    ``order_by`` names a column and whether it ascends; undefined scores come last.
    """
    frame, features = feature_frame(data, columns, add_cyclic=add_cyclic, feature_cols=feature_cols)
    valid = valid_rows(frame.filter(F.col(columns.id).isNotNull()), features, columns.target)
    staged = stage_features(valid, columns, features)
    targets = _target_ids(select_stations(data, id_col=columns.id), columns.id)
    leaked = _leaked(staged.frame, targets, columns, include_target_pct, include_target_seed)
    table = _evaluate(
        staged,
        leaked,
        targets,
        columns,
        features,
        rf_params=rf_params,
        model=model,
        agg=agg_for_metrics,
        test_window=(start, end),
        neighbors=None,
        parallelism=parallelism,
        log_path=None,
        flush_every=0,
        finish=lambda rows: rows.select("station", "n_rows", *SCORE_COLUMNS, "error"),
        growth=_one_pass(targets, model, rf_params),
    )
    if order_by and order_by[0] in table.columns:
        name, ascending = order_by
        table = table.orderBy(F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last(), "station")
    write_table(table, save_table_path, parquet_compression=parquet_compression)
    return table


def evaluate_all_stations_fast(
    data: DataFrame,
    *,
    columns: Columns = Columns(),
    var_col: str | None = None,
    var_cols: Iterable[str] | None = None,
    prefix: str | Iterable[str] | None = None,
    station_ids: Iterable[int] | None = None,
    regex: str | None = None,
    custom_filter: Callable[[int], bool] | None = None,
    start: DateLike = "1961-01-01",
    end: DateLike = "2023-12-31",
    model=None,
    rf_params: Mapping[str, object] | None = None,
    agg_for_metrics: str = "sum",
    add_cyclic: bool = False,
    feature_cols: Sequence[str] | None = None,
    k_neighbors: int | None = None,
    neighbor_map: DataFrame | Mapping[int, Iterable[int]] | None = None,
    include_target_pct: float = 0.0,
    include_target_seed: int = 42,
    min_station_rows: int | None = None,
    parallelism: int | None = None,
    grow_together: bool = False,
    log_csv: str | None = None,
    flush_every: int = 20,
    save_table_path: str | None = None,
    parquet_compression: str = "snappy",
) -> DataFrame:
    """Scoreboard of the selected stations; training and test rows are both clipped to the window.

    With ``grow_together``, the forests of all stations are grown in one pass, level by level, instead of one Spark ML
    fit a station; it needs ``k_neighbors``. The trees are of the same kind, but bootstraps and bins differ, so a forest
    is not the one that Spark ML grows from the same seed.

    Forests that are the same either way (of depth 0, every row counted once) are made in one pass for more than
    ``FEW_FITS`` stations, with or without neighbours.

    A station that cannot be fitted keeps a row with ``n_rows`` 0 and the reason in ``error``.
    ``log_csv`` grows by one part for every ``flush_every`` stations; where many are done in one pass, passes that end
    within ``QUICK_PASS`` seconds are followed by ones of twice as many. Stations that it lists without an error are not
    fitted again, so a run that was broken off goes on from there. The options of the run lie beside the log; with
    others, going on is refused.
    """
    growth = Growth.of(rf_params) if grow_together and model is None else None
    if grow_together and (growth is None or k_neighbors is None):
        raise ValueError("grow_together needs k_neighbors, no model, and forest parameters of whole feature sets.")
    frame, features = feature_frame(
        data,
        columns,
        add_cyclic=add_cyclic,
        feature_cols=feature_cols,
        var_cols=var_cols if var_cols is not None else var_col,
        start=start,
        end=end,
    )
    frame = frame.filter(F.col(columns.id).isNotNull())
    valid = valid_rows(frame, features, columns.target)
    # One row per station: it answers which stations exist and which are near.
    spots = stage(station_positions(frame, columns), "positions")
    selected = select_stations(
        spots, id_col=columns.id, prefix=prefix, station_ids=station_ids, regex=regex, custom_filter=custom_filter
    )
    if min_station_rows is not None:
        counts = valid.groupBy(columns.id).agg(F.count(F.lit(1)).alias("valid_rows"))
        selected = selected.join(counts.filter(F.col("valid_rows") >= int(min_station_rows)), columns.id, "left_semi")
    # The targets come first: with neighbours, only their rows and their neighbours' are staged.
    targets = _target_ids(selected, columns.id)
    neighbors = _neighbor_table(spots, targets, columns, k_neighbors, neighbor_map)
    staged = stage_features(_rows_needed(valid, targets, columns, neighbors), columns, features)
    leaked = _leaked(staged.frame, targets, columns, include_target_pct, include_target_seed)
    positions = spots.select(F.col(columns.id).cast("long").alias("station"), *columns.coords)

    def finish(rows: DataFrame) -> DataFrame:
        return (
            rows.join(positions, "station", "left")
            .withColumn("include_target_pct", F.lit(float(include_target_pct)))
            .select("station", "n_rows", "seconds", *SCORE_COLUMNS, "include_target_pct", *columns.coords, "error")
        )

    table = _evaluate(
        staged,
        leaked,
        targets,
        columns,
        features,
        rf_params=rf_params,
        model=model,
        agg=agg_for_metrics,
        test_window=(None, None),
        neighbors=neighbors,
        parallelism=parallelism,
        log_path=log_csv,
        flush_every=flush_every,
        finish=finish,
        growth=growth or _one_pass(targets, model, rf_params),
        run_options=json.dumps(
            {
                "model": _described(model) if model is not None else rf_params,
                "features": features,
                "window": [str(start), str(end)],
                "k_neighbors": k_neighbors,
                "neighbor_map": neighbor_map is not None,
                "include_target": [include_target_pct, include_target_seed],
                "agg_for_metrics": agg_for_metrics,
                "grow_together": grow_together,
                "target": columns.target,
            },
            sort_keys=True,
            default=str,
        ),
    ).orderBy("station")
    # What is returned has been staged, so writing it fits nothing anew.
    write_table(table, save_table_path, parquet_compression=parquet_compression)
    return table


def _compact(date: DateLike) -> str:
    return str(date).replace("-", "")


def export_full_series_station(
    data: DataFrame,
    station_id: int,
    *,
    out_dir: str,
    columns: Columns = Columns(),
    start: DateLike = "1961-01-01",
    end: DateLike = "2023-12-31",
    k_neighbors: int | None = None,
    neighbor_map: DataFrame | Mapping[int, Iterable[int]] | None = None,
    file_format: str = "parquet",
    parquet_compression: str = "snappy",
    save_metrics_path: str | None = None,
    **options,
) -> tuple[DataFrame, DataFrame, str]:
    """Write the full series of one station; ``(series as written, scores, path)``."""
    file_format = check_format(file_format)
    if k_neighbors is not None and neighbor_map is None:
        dated = nan_to_null(ensure_datetime(data, columns.date))
        neighbor_map = build_station_kneighbors(dated, columns=columns, k=k_neighbors, targets=[station_id])
    series, _, _, _ = loso_predict_full_series_fast(
        data,
        station_id,
        columns=columns,
        start=start,
        end=end,
        k_neighbors=k_neighbors,
        neighbor_map=neighbor_map,
        **options,
    )
    path = f"{out_dir}/loso_fullseries_{station_id}_{_compact(start)}_{_compact(end)}.{file_format}"
    write_table(series, path, file_format=file_format, parquet_compression=parquet_compression)
    written = _read_series(series.sparkSession, path, file_format, series.schema)
    scores = score_grains(
        written, date_col=columns.date, yhat_col="y_pred_full", agg=options.get("agg_for_metrics", "sum")
    )
    write_json(scores, save_metrics_path)
    return written, scores, path


def _read_series(spark: SparkSession, path: str, file_format: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if file_format == "csv" else reader.parquet(path)


def fill_gaps(series: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """The observed value where there is one, else the prediction, under the target's name."""
    return series.withColumn(columns.target, F.coalesce("y_true", "y_pred_full"))


def _check_combined(schema: str) -> None:
    if schema not in COMBINED_SCHEMAS:
        raise ValueError(f"Unknown combine_schema {schema!r}: choose from {COMBINED_SCHEMAS}")


def combined_series(
    series: DataFrame, positions: DataFrame | None, columns: Columns = Columns(), schema: str = "input_like"
) -> DataFrame:
    """One table of filled series: shaped like the input, or ``compact`` with both sources kept. Without ``positions`` the
    series has the coordinates itself."""
    _check_combined(schema)
    filled = fill_gaps(series, columns)
    if schema == "compact":
        return filled.select("station", "y_pred_full", "y_true", columns.date, columns.target)
    if positions is None:
        return filled.select(F.col("station").alias(columns.id), *columns.coords, columns.date, columns.target)
    at = positions.select(F.col(columns.id).cast("long").alias("_id"), *columns.coords)
    return filled.join(at, F.col("station") == F.col("_id"), "left").select(
        F.col("station").alias(columns.id), *columns.coords, columns.date, columns.target
    )


def export_full_series_batch(
    data: DataFrame,
    *,
    out_dir: str,
    columns: Columns = Columns(),
    station_ids: Iterable[int] | None = None,
    prefix: str | Iterable[str] | None = None,
    regex: str | None = None,
    custom_filter: Callable[[int], bool] | None = None,
    start: DateLike = "1961-01-01",
    end: DateLike = "2023-12-31",
    train_start: DateLike | None = None,
    train_end: DateLike | None = None,
    model=None,
    rf_params: Mapping[str, object] | None = None,
    add_cyclic: bool = False,
    feature_cols: Sequence[str] | None = None,
    covariates: DataFrame | None = None,
    k_neighbors: int | None = None,
    neighbor_map: DataFrame | Mapping[int, Iterable[int]] | None = None,
    file_format: str = "parquet",
    parquet_compression: str = "snappy",
    manifest_path: str | None = None,
    combine_output_path: str | None = None,
    combine_format: str = "csv",
    combine_schema: str = "input_like",
    include_target_pct: float = 0.0,
    include_target_seed: int = 42,
    agg_for_metrics: str = "sum",
    parallelism: int | None = None,
) -> DataFrame:
    """Full series of the selected stations, written under one folder per station; the manifest.

    The manifest has a row per station: path, seconds, share of observed days, scores, error. Forests of depth 0 that count
    every row once are made in one pass for more than ``FEW_FITS`` stations. ``read_folders`` reads what is written.
    """
    file_format, combine_format = check_format(file_format), check_format(combine_format)
    _check_combined(combine_schema)
    count_days(start, end)
    require_columns(data, [columns.id, columns.date, *columns.coords, columns.target])
    spark = data.sparkSession
    _, features = feature_frame(data, columns, add_cyclic=add_cyclic, feature_cols=feature_cols)
    in_one = model is None and Growth.same_by_spark(rf_params) is not None
    if in_one and covariates is not None:
        covariates = _covariates_needed(covariates, columns, features)
    require_unique_days(covariates, columns)
    if in_one:
        # The rows are looked at several times: they are made once, and lie by station.
        needed = dict.fromkeys([columns.id, columns.date, *columns.coords, columns.target, *features])
        rows = data.filter(F.col(columns.id).isNotNull()).select(*[c for c in needed if c in data.columns])
        data = stage(rows.hint("rebalance", columns.id), "observations")
    observed = nan_to_null(ensure_datetime(data, columns.date)).filter(F.col(columns.id).isNotNull())
    positions = stage(station_positions(observed, columns), "positions")
    selected = select_stations(
        positions, id_col=columns.id, prefix=prefix, station_ids=station_ids, regex=regex, custom_filter=custom_filter
    )
    targets = _target_ids(selected, columns.id)
    neighbors = _neighbor_table(positions, targets, columns, k_neighbors, neighbor_map)
    frame, features = feature_frame(
        data, columns, add_cyclic=add_cyclic, feature_cols=feature_cols, start=train_start, end=train_end
    )
    valid = valid_rows(frame.filter(F.col(columns.id).isNotNull()), features, columns.target)
    known = _present(positions, columns.id, targets)
    growth = _one_pass(targets, model, rf_params)
    path = f"{out_dir}/loso_fullseries_{_compact(start)}_{_compact(end)}.{file_format}"
    wanted = _id_table(spark, targets).select(F.col("station").alias("_wanted"))

    def own_rows() -> DataFrame:
        return observed.join(wanted, F.col(columns.id).cast("long") == F.col("_wanted"), "left_semi")

    def one_by_one() -> tuple[list[Outcome], DataFrame]:
        """A fit a station; the series as written."""
        staged = stage_features(_rows_needed(valid, targets, columns, neighbors), columns, features)
        leaked = _leaked(staged.frame, targets, columns, include_target_pct, include_target_seed)
        root = new_folder(spark, "predictions")

        def work(station: int) -> None:
            if station not in known:
                raise NotFitted(f"Station {station} does not occur in the data.")
            at = positions.filter(F.col(columns.id) == station)
            pool = _pool_of(staged, leaked, columns, station, neighbors)
            fitted = fit_pool(pool, features, columns.target, model or forest(rf_params), columns=columns)
            days = horizon(at, columns, features, start, end, covariates)
            predict(fitted, days, "y_pred_full", [columns.date]).write.parquet(f"{root}/station={station}")

        parts = T.StructType(
            [
                T.StructField("station", T.LongType()),
                T.StructField(columns.date, T.DateType()),
                T.StructField("y_pred_full", T.DoubleType()),
            ]
        )
        outcomes = run_targets(spark, targets, work, _fits_in_flight(staged, neighbors is not None, parallelism))
        predicted = _read_parts(spark, root, outcomes, parts)
        series = attach_observed(predicted, own_rows(), columns, start, end)
        write(series.hint("rebalance", "station"))
        return outcomes, _read_series(spark, path, file_format, series.schema) if _succeeded(outcomes) else series

    def together() -> tuple[list[Outcome], DataFrame]:
        """All stations in one pass; the time is theirs in equal parts. The series, with coordinates.

        What the days are unfolded from is staged, so what is written need not be read again from a folder a station."""
        began = time.monotonic()
        leaked = _leaked(valid, targets, columns, include_target_pct, include_target_seed)
        means = pool_means(valid, leaked, neighbors, targets, columns)
        with_pool = {r[0] for r in means.select("target").collect()}
        tasks = max(MIN_TASKS, -(-len(with_pool) * count_days(start, end) // ROWS_PER_TASK))
        # Days have their calendar, and a station its place or none; only covariates may lack on some days.
        placed = [c for c in features if c in columns.coords]
        at = positions.join(means, F.col(columns.id).cast("long") == F.col("target")).select(
            F.col("target").alias("station"),
            *columns.coords,
            F.when(all_present(placed), F.col("mean")).alias("y_pred_full"),
        )
        seen = observed_rows(observed if len(known) == positions.count() else own_rows(), columns, start, end)
        counted = seen.groupBy("station").agg(F.count(F.lit(1)).alias("n"))
        crowded = [r[0] for r in counted.filter(F.col("n") > ROWS_PER_TASK).select("station").collect()]
        is_crowded = F.col("station").isin(crowded) if crowded else F.lit(False)
        spans = stage(day_spans(at.filter(~is_crowded), seen.filter(~is_crowded), start, end, tasks), "spans")
        lacking = _covariates_lacking(columns, features)
        by_date = covariates is None or columns.id not in covariates.columns
        small = covariates is not None and by_date and covariates.count() <= FEW_DAYS

        def finished(days: DataFrame) -> DataFrame:
            if lacking:
                days = days if columns.id == "station" else days.withColumn(columns.id, F.col("station"))
                given = F.broadcast(covariates) if small else covariates
                days = join_covariates(days, columns.id, columns.date, lacking, given)
                days = days.withColumn("y_pred_full", F.when(all_present(lacking), F.col("y_pred_full")))
            return days.select(columns.date, "station", "y_pred_full", "y_true", *columns.coords)

        series = finished(unfold_spans(spans, columns.date))
        laid_out = finished(unfold_spans(spans.repartition(tasks, "station"), columns.date))
        laid_out = laid_out.hint("rebalance", "station") if lacking and not small else laid_out
        if crowded:
            # Rows of a few stations with very many: no task holds all of one.
            days = explode_days(at.filter(is_crowded), columns.date, start, end, ["station"], tasks)
            mine = seen.filter(is_crowded).withColumnRenamed("_day", columns.date)
            more = stage(finished(days.join(mine, ["station", columns.date], "left")), "crowded")
            series, laid_out = series.unionByName(more), laid_out.unionByName(more.hint("rebalance", "station"))
        write(laid_out.drop(*columns.coords))
        seconds = (time.monotonic() - began) / max(1, len(targets))

        def problem(station: int) -> Exception | None:
            if station not in known:
                return NotFitted(f"Station {station} does not occur in the data.")
            return None if station in with_pool else ValueError("No row is left to train on.")

        return [Outcome(t, seconds, problem(t)) for t in targets], series

    def write(series: DataFrame) -> None:
        """A folder a station."""
        writer = series.write.mode("overwrite").partitionBy("station")
        if file_format == "csv":
            writer.csv(path, header=True)
        else:
            writer.option("compression", parquet_compression).parquet(path)

    outcomes, series = one_by_one() if growth is None else together()
    coverage = series.groupBy("station").agg(
        (F.avg(F.col("y_true").isNotNull().cast("int")) * 100).alias("coverage_pct")
    )
    scores = widen_scores(score_grains(series, date_col=columns.date, yhat_col="y_pred_full", agg=agg_for_metrics))
    manifest = (
        _outcomes(spark, outcomes)
        .join(coverage, "station", "left")
        .join(scores, "station", "left")
        .withColumn("path", F.when(F.col("error").isNull(), F.concat(F.lit(f"{path}/station="), "station")))
        .select("station", "path", "seconds", "coverage_pct", *SCORE_COLUMNS, "error")
    )
    manifest = stage(manifest, "manifest").orderBy("station")
    if combine_output_path is not None:
        combined = combined_series(series, positions if growth is None else None, columns, combine_schema)
        write_table(
            combined, combine_output_path, file_format=combine_format, parquet_compression=parquet_compression
        )
    write_table(manifest, manifest_path)
    return manifest


def _covariates_lacking(columns: Columns, features: Sequence[str]) -> list[str]:
    """The features that a day at a station has not of itself."""
    return [c for c in features if c not in (columns.id, columns.date, *columns.coords, *CALENDAR_PARTS)]


def _covariates_needed(covariates: DataFrame, columns: Columns, features: Sequence[str]) -> DataFrame:
    """Keys of the covariates, and those of their columns that are features, staged."""
    keys = [c for c in (columns.id, columns.date) if c in covariates.columns]
    named = resolve_columns(covariates, _covariates_lacking(columns, features))
    return stage(covariates.select(*dict.fromkeys([*keys, *named])), "covariates") if keys else covariates
