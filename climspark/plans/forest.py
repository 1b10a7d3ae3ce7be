"""Random forests on Spark ML: parameter names, pipelines, persistence."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climspark.schema import Columns, all_present
from climspark.sources.staging import MIN_TASKS, SMALL_TASK_ROWS

FEATURES_COL = "_features"
PREDICTION_COL = "prediction"

# Spark ML's deepest tree, and bins enough for one per day of the year. A feature with more distinct
# values is cut at quantiles; ``maxBins`` among the forest parameters overrides it.
MAX_DEPTH = 30
MAX_BINS = 400
# Rows of a training pool that one task holds.
POOL_ROWS_PER_TASK = 250_000
DEFAULT_RF_PARAMS = {"n_estimators": 200, "max_depth": None, "random_state": 42}

# Usual forest parameter names -> Spark ML names.
PARAM_NAMES = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "random_state": "seed",
    "max_features": "featureSubsetStrategy",
    "min_samples_leaf": "minInstancesPerNode",
    "min_impurity_decrease": "minInfoGain",
    "bootstrap": "bootstrap",
    "max_samples": "subsamplingRate",
}
IGNORED_PARAMS = ("n_jobs", "verbose", "warm_start")


def forest_params(rf_params: Mapping[str, object] | None = None) -> dict[str, object]:
    """Spark ML parameters for a forest described by the usual names (Spark ML's own pass through)."""
    given = dict(DEFAULT_RF_PARAMS if rf_params is None else rf_params)
    out: dict[str, object] = {"featureSubsetStrategy": "all", "maxBins": MAX_BINS, "maxMemoryInMB": 512}
    known = {p.name for p in RandomForestRegressor().params}
    for name, value in given.items():
        if name in IGNORED_PARAMS:
            continue
        if name == "criterion":
            if value not in (None, "squared_error"):
                raise ValueError(f"criterion={value!r}: Spark ML's trees reduce the squared error.")
            continue
        target = PARAM_NAMES.get(name, name)
        if target == "maxDepth" and (value is None or value > MAX_DEPTH):
            if value is not None:
                warnings.warn(f"max_depth={value} is above Spark ML's limit: {MAX_DEPTH} is used.", stacklevel=3)
            value = MAX_DEPTH
        if target == "featureSubsetStrategy":
            # 1.0 is the share of all features, 1 is one feature.
            value = "all" if value is None or (isinstance(value, float) and value == 1.0) else str(value)
        if value is None:
            continue
        if target not in known:
            raise ValueError(f"Unknown forest parameter {name!r}")
        out[target] = value
    return out


def forest(rf_params: Mapping[str, object] | None = None) -> RandomForestRegressor:
    return RandomForestRegressor(**forest_params(rf_params))


def _laid_out(
    pool: DataFrame, columns: Columns, features: Sequence[str], target: str, count: int | None = None
) -> DataFrame:
    """The pool's rows in an order and on a number of tasks that follow from the rows alone.

    A forest's bootstrap depends on both. So one pool and seed give one forest, whichever plan made the pool and
    whatever the cluster. Hashing on station and date together keeps a huge station spread out.
    """
    keys = [columns.id, columns.date]
    rows = pool.select(*[F.col(columns.id).cast("long"), F.col(columns.date).cast("timestamp_ntz")],
                       *dict.fromkeys(c for c in [*features, target] if c not in keys))
    count = pool.count() if count is None else count
    tasks = max(1, min(MIN_TASKS, count // SMALL_TASK_ROWS), -(-count // POOL_ROWS_PER_TASK))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, target, *features)


def fit_pool(
    pool: DataFrame, features: Sequence[str], target: str, estimator: Estimator, *,
    columns: Columns = Columns(), count: int | None = None,
) -> PipelineModel:
    """Fit ``VectorAssembler + estimator`` on the rows of ``pool`` (all values present).

    A pool whose rows are known to be ``count`` is not computed once more to count them.
    """
    rows = _laid_out(pool, columns, features, target, count).select(*dict.fromkeys([*features, target]))
    regressor = estimator.copy()
    regressor.setParams(featuresCol=FEATURES_COL, labelCol="_label", predictionCol=PREDICTION_COL)
    rows = rows.withColumn("_label", F.col(target).cast("double"))
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES_COL)
    try:
        return Pipeline(stages=[assembler, regressor]).fit(rows)
    except Exception as problem:
        if pool.isEmpty():
            raise ValueError("No row is left to train on.") from problem
        raise


def predict(model: PipelineModel, rows: DataFrame, output: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` plus the prediction under the name ``output``; NULL where a model input is missing."""
    inputs = model.stages[0].getInputCols()
    given = rows.select("*", all_present(inputs).alias("_given"))
    filled = given.withColumns({f"_in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs})
    assembler = model.stages[0].copy().setInputCols([f"_in_{c}" for c in inputs])
    predicted = PipelineModel([assembler, *model.stages[1:]]).transform(filled)
    return predicted.select(*keep, F.when(F.col("_given"), F.col(PREDICTION_COL)).alias(output))


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
