"""Daily station-climate reconstruction on Spark."""

import sys

from pyspark import cloudpickle

from climspark.functions.calendar import add_time_features, ensure_datetime
from climspark.operators.neighbors import (
    build_station_kneighbors,
    neighbor_correlation_table,
    neighbor_correlations,
)
from climspark.operators.sampling import sample_target_for_training
from climspark.operators.scoring import aggregate_and_score, metrics_dict, score_grains, widen_scores
from climspark.operators.stations import select_stations, slice_station_series, station_positions
from climspark.plans.compare import compare_sources
from climspark.plans.grid import (
    GlobalModelMeta,
    grid_nan_report,
    predict_at_point_daily_with_global_model,
    predict_grid_daily_with_global_model,
    predict_points_daily_with_global_model,
    train_global_rf_target,
)
from climspark.plans.loso import (
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
from climspark.schema import Columns, resolve_columns
from climspark.sources.tables import read_observations

# Ship the few task-side helpers by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Columns",
    "GlobalModelMeta",
    "add_time_features",
    "aggregate_and_score",
    "build_station_kneighbors",
    "compare_sources",
    "ensure_datetime",
    "evaluate_all_stations",
    "evaluate_all_stations_fast",
    "export_full_series_batch",
    "export_full_series_station",
    "grid_nan_report",
    "loso_predict_full_series",
    "loso_predict_full_series_fast",
    "loso_train_predict_station",
    "metrics_dict",
    "neighbor_correlation_table",
    "neighbor_correlations",
    "predict_at_point_daily_with_global_model",
    "predict_grid_daily_with_global_model",
    "predict_points_daily_with_global_model",
    "read_observations",
    "resolve_columns",
    "sample_target_for_training",
    "score_grains",
    "select_stations",
    "slice_station_series",
    "station_positions",
    "train_global_rf_target",
    "widen_scores",
]
