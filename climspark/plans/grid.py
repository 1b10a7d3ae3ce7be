"""One global model, and its daily predictions for grids and points."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climspark.functions.calendar import DateLike, add_time_features, count_days, explode_days, prepare_dates
from climspark.operators.stations import count_valid_rows, valid_rows
from climspark.plans.forest import fit_pool, forest, load_model, predict, save_model
from climspark.plans.loso import join_covariates
from climspark.plans.shards import NODES_PER_TASK, deal_trees, predict_by_trees, saved_nodes
from climspark.schema import Columns, all_present, base_features, is_fractional, nan_to_null, require_columns
from climspark.sources.staging import ROWS_PER_TASK, stage

DEFAULT_RF_PARAMS = {"n_estimators": 500, "max_depth": None, "random_state": 42}

META_SCHEMA = (
    "columns struct<id:string,date:string,lat:string,lon:string,alt:string,target:string>, "
    "window struct<first:string,last:string>, least_rows long, cyclic boolean, forest string, inputs array<string>, "
    "rows long, stations long"
)


@dataclass(frozen=True)
class GlobalModelMeta:
    """What a saved global model was trained on. The stations used lie beside it as a table."""

    columns: Columns
    window: tuple[str, str]
    min_rows_per_station: int
    add_cyclic: bool
    rf_params: dict
    features: list[str]
    n_train_rows: int
    n_stations_used: int

    def save(self, spark: SparkSession, path: str, stations_used: DataFrame | None = None) -> str:
        names = tuple(asdict(self.columns).values())
        row = (names, self.window, self.min_rows_per_station, self.add_cyclic, json.dumps(self.rf_params))
        row += (self.features, self.n_train_rows, self.n_stations_used)
        meta = spark.createDataFrame([row], META_SCHEMA)
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
        if stations_used is not None:
            stations_used.write.mode("overwrite").parquet(f"{path}/stations")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> GlobalModelMeta:
        names, window, least, cyclic, params, inputs, rows, stations = spark.read.schema(META_SCHEMA).json(f"{path}/meta").first()
        return GlobalModelMeta(
            Columns(**names.asDict()), tuple(window), least, cyclic, json.loads(params), inputs, rows, stations
        )

    def stations_used_sorted(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(f"{path}/stations").select(self.columns.id).orderBy(self.columns.id)


def training_frame(
    data: DataFrame,
    columns: Columns,
    *,
    start: DateLike,
    end: DateLike,
    min_rows_per_station: int,
    add_cyclic: bool,
    extra_feature_cols: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """``(valid rows, (id, valid_rows) of the stations to keep, features)``; absent extras are skipped."""
    extras = [c for c in extra_feature_cols or [] if c in data.columns]
    features = base_features(columns, add_cyclic, extras)
    own = [c for c in features if c in data.columns]
    keep = dict.fromkeys([columns.id, columns.date, *own, columns.target])
    rows = nan_to_null(prepare_dates(data.select(*keep), columns.date, start, end))
    rows = add_time_features(rows, columns.date, add_cyclic, narrow=True)
    counts = count_valid_rows(rows, features, columns)
    kept = counts.filter(F.col("valid_rows") >= int(min_rows_per_station))
    valid = valid_rows(rows, features, columns.target)
    return valid, stage(kept.filter(F.col(columns.id).isNotNull()), "stations_used"), features


def train_global_rf_target(
    data: DataFrame,
    *,
    model_path: str,
    meta_path: str,
    columns: Columns = Columns(),
    start: DateLike = "1991-01-01",
    end: DateLike = "2020-12-31",
    min_rows_per_station: int = 1825,
    add_cyclic: bool = True,
    extra_feature_cols: Sequence[str] | None = None,
    model=None,
    rf_params: Mapping[str, object] | None = None,
) -> tuple[PipelineModel, GlobalModelMeta, DataFrame]:
    """Fit one forest on every station with enough valid rows and save it with its metadata.

    Returns ``(model, metadata, (id, valid_rows) of the stations used, most rows first)``.
    """
    params = dict(DEFAULT_RF_PARAMS if rf_params is None else rf_params)
    valid, kept, features = training_frame(
        data,
        columns,
        start=start,
        end=end,
        min_rows_per_station=min_rows_per_station,
        add_cyclic=add_cyclic,
        extra_feature_cols=extra_feature_cols,
    )
    totals = kept.agg(F.sum("valid_rows"), F.count(F.lit(1))).first()
    if not totals[1]:
        _raise_no_station(data, columns, start, end, features, add_cyclic, min_rows_per_station)
    train = valid.join(kept, columns.id, "left_semi")
    # The stations' counts add up to the pool, so it is computed once, for the fit.
    fitted = fit_pool(train, features, columns.target, model or forest(params), columns=columns, count=int(totals[0]))
    save_model(fitted, model_path)
    meta = GlobalModelMeta(
        columns=columns,
        window=(str(start), str(end)),
        min_rows_per_station=int(min_rows_per_station),
        add_cyclic=bool(add_cyclic),
        rf_params=params,
        features=features,
        n_train_rows=int(totals[0]),
        n_stations_used=int(totals[1]),
    )
    meta.save(data.sparkSession, meta_path, kept)
    return fitted, meta, kept.orderBy(F.desc("valid_rows"), columns.id)


def _raise_no_station(data, columns, start, end, features, add_cyclic, min_rows) -> None:
    rows = nan_to_null(prepare_dates(data, columns.date, start, end))
    counts = count_valid_rows(add_time_features(rows, columns.date, add_cyclic), features, columns)
    best = counts.agg(F.max("valid_rows")).first()[0]
    if best is None:
        raise ValueError("No row has every feature and the target.")
    raise ValueError(f"Every station has too few valid rows: at most {best}, wanted {min_rows}.")


def grid_nan_report(grid: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """One row: missing values per required column, NULL for a column that is absent."""
    counts = []
    for name in [columns.id, *columns.coords]:
        if name not in grid.columns:
            counts.append(F.lit(None).cast("long").alias(name))
            continue
        missing = F.col(name).isNull()
        if is_fractional(grid.schema[name].dataType):
            missing = missing | F.isnan(name)
        counts.append(F.count_if(missing).alias(name))
    return grid.agg(*counts)


def dedupe_grid(grid: DataFrame, columns: Columns = Columns(), extra: Sequence[str] = ()) -> DataFrame:
    """One row per id: the least by (lat, lon, alt), since a Spark table has no first row. Copies that lack a value
    come last, so a complete one wins.

    A partial ``min`` per id, so copies of one id are reduced before they are shuffled.
    """
    names = [*columns.coords, *extra]
    cell = F.struct((~all_present(names)).alias("_lacks"), *names)
    least = grid.groupBy(columns.id).agg(F.min(cell).alias("_cell"))
    return least.select(columns.id, *[F.col(f"_cell.{c}").alias(c) for c in names])


def predict_grid_daily_with_global_model(
    grid: DataFrame,
    *,
    model_path: str,
    meta_path: str,
    columns: Columns = Columns(),
    start: DateLike = "1991-01-01",
    end: DateLike = "2020-12-31",
    covariates: DataFrame | None = None,
    on_null: str = "error",
    out_path: str | None = None,
    parquet_compression: str = "snappy",
    nodes_per_task: int = NODES_PER_TASK,
) -> DataFrame | None:
    """``(id, date, lat, lon, alt, y_pred_full)`` for every cell and day; written when a path is given.

    Covariates of the model come from columns of the grid or from ``covariates``, a table keyed by
    date (and id). Cells without coordinates raise, unless ``on_null="drop"``. A forest of more than
    ``nodes_per_task`` nodes is dealt over tasks by groups of trees; predictions are the same.
    """
    spark = grid.sparkSession
    meta = GlobalModelMeta.load(spark, meta_path)
    require_columns(grid, [columns.id, *columns.coords], "Grid")
    days = count_days(start, end)
    calendar = ("year", "month", "doy", "doy_sin", "doy_cos")
    trained = meta.columns.coords
    extra = [c for c in meta.features if c in grid.columns and c not in (*calendar, *trained, *columns.coords)]
    lacking = [c for c in meta.features if c not in (*calendar, *trained, *extra)]
    if lacking and covariates is None:
        raise ValueError(
            f"The grid lacks model inputs {lacking}: add columns or pass `covariates`."
        )
    cells = dedupe_grid(nan_to_null(grid.select(columns.id, *columns.coords, *extra)), columns, extra)
    absent = F.lit(False)
    for name in [*columns.coords, *extra]:
        absent = absent | F.col(name).isNull()
    count, incomplete = cells.agg(F.count(F.lit(1)), F.count_if(absent)).first()
    if count == 0:
        raise ValueError("The grid has no cell.")
    if incomplete and on_null != "drop":
        raise ValueError(f"{incomplete} grid cells lack a coordinate or covariate; see grid_nan_report.")
    tasks = max(spark.sparkContext.defaultParallelism, -(-count * days // ROWS_PER_TASK))
    rows = explode_days(cells.filter(~absent), "date", start, end, [columns.id], tasks)
    rows = add_time_features(rows, "date", meta.add_cyclic, narrow=True)
    public = dict(zip(trained, columns.coords))
    inputs = rows.select(
        columns.id,
        "date",
        *[F.col(c).cast("double").alias(f) for f, c in public.items()],
        *extra,
        *[c for c in calendar if c in rows.columns],
    )
    inputs = join_covariates(inputs, columns.id, "date", meta.features, covariates)
    keep = [columns.id, "date", *[F.col(f).alias(c) for f, c in public.items()]]
    nodes = saved_nodes(spark, model_path)
    sizes = nodes.groupBy("tree").count().collect() if nodes is not None else []  # a row a tree
    if sum(n for _, n in sizes) > nodes_per_task:
        groups = deal_trees([tuple(r) for r in sizes], nodes_per_task)
        out = predict_by_trees(nodes, groups, inputs, count * days, meta.features, "y_pred_full", [columns.id, "date", *trained])
        out = out.withColumnsRenamed(public)
    else:
        out = predict(load_model(model_path), inputs, "y_pred_full", keep)
    out = out.withColumn("y_pred_full", F.col("y_pred_full").cast("float"))
    if out_path is None:
        return out
    out.write.mode("overwrite").option("compression", parquet_compression).parquet(out_path)
    return None


Points = DataFrame | Mapping | Sequence


def normalize_points(spark: SparkSession, points: Points, columns: Columns = Columns()) -> DataFrame:
    """Points in any accepted form as a grid: a table, a dict, a tuple, or a list of dicts or tuples.

    Tuples are (lat, lon, alt), numbered from 1, or (id, lat, lon, alt). Coordinates that are not
    numbers, repeated ids and an empty list raise.
    """
    names = [columns.id, *columns.coords]
    table = points if isinstance(points, DataFrame) else _literal_points(spark, points, columns)
    require_columns(table, names, "Points")
    grid = table.select(columns.id, *[F.col(c).try_cast("double").alias(c) for c in columns.coords])
    bad = F.lit(False)
    for c in columns.coords:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    if not grid.filter(bad).isEmpty():
        raise ValueError("A point has a coordinate that is no number.")
    if not grid.groupBy(columns.id).count().filter("count > 1").isEmpty():
        raise ValueError("Two points share an id.")
    return grid


def _literal_points(spark: SparkSession, points: Mapping | Sequence, columns: Columns) -> DataFrame:
    if isinstance(points, Mapping):
        points = [points]
    elif isinstance(points, tuple) and points and not isinstance(points[0], (Mapping, Sequence)):
        points = [points]
    elif isinstance(points, tuple) and len(points) == 4 and isinstance(points[0], str):
        points = [points]
    if not isinstance(points, (list, tuple)):
        raise TypeError("Points come as a DataFrame, a dict, a tuple, or a list of dicts or tuples.")
    if not points:
        raise ValueError("There are no points.")
    rows = []
    for i, p in enumerate(points, start=1):
        if isinstance(p, Mapping):
            missing = [c for c in (columns.id, *columns.coords) if c not in p]
            if missing:
                raise ValueError(f"A point lacks {missing}")
            rows.append(tuple(p[c] for c in (columns.id, *columns.coords)))
        elif isinstance(p, (list, tuple)) and len(p) in (3, 4):
            rows.append(tuple(p) if len(p) == 4 else (i, *p))
        else:
            raise TypeError("Points come as dicts, (lat, lon, alt) or (id, lat, lon, alt).")
    id_type = "long" if all(isinstance(r[0], int) for r in rows) else "string"
    as_id = int if id_type == "long" else str
    literal = [(as_id(r[0]), *[None if v is None else str(v) for v in r[1:]]) for r in rows]
    return spark.createDataFrame(literal, f"`{columns.id}` {id_type}, " + ", ".join(f"`{c}` string" for c in columns.coords))


def predict_points_daily_with_global_model(
    spark: SparkSession, points: Points, *, columns: Columns = Columns(), **options
) -> DataFrame | None:
    """Daily predictions at arbitrary points; options as for a grid."""
    grid = normalize_points(spark, points, columns)
    return predict_grid_daily_with_global_model(grid, columns=columns, **options)


def predict_at_point_daily_with_global_model(
    spark: SparkSession,
    *,
    latitude: float,
    longitude: float,
    altitude: float,
    station: int | str = 1,
    **options,
) -> DataFrame | None:
    """Daily predictions at one point."""
    point = (station, float(latitude), float(longitude), float(altitude))
    return predict_points_daily_with_global_model(spark, [point], **options)
