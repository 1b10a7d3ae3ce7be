"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from climspark import (  # noqa: E402
    build_station_kneighbors,
    compare_sources,
    evaluate_all_stations_fast,
    neighbor_correlations,
    predict_grid_daily_with_global_model,
    score_grains,
    train_global_rf_target,
    widen_scores,
)
from climspark.checks.network import observations, stations  # noqa: E402
from climspark.operators.sampling import draw_sample  # noqa: E402
from climspark.operators.stations import valid_rows  # noqa: E402
from climspark.plans.loso import feature_frame  # noqa: E402
from climspark.schema import Columns  # noqa: E402
from climspark.session import get_session  # noqa: E402
from climspark.sources.staging import new_folder, stage  # noqa: E402

FOREST = {"n_estimators": 10, "max_depth": 5, "random_state": 42}
TARGETS = [1, 2, 3, 4, 5]
HORIZON = {"start": "1995-01-02", "end": "2001-11-04"}


def sink(df: DataFrame) -> None:
    """Evaluate every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def workloads(spark: SparkSession, obs: DataFrame, grid: DataFrame) -> dict[str, Callable[[], None]]:
    pairs = obs.select("station", "date", F.col("prec").alias("y_true"), F.col("prectotcorr").alias("y_pred"))
    model = {}

    def features() -> None:
        frame, names = feature_frame(obs, Columns(), add_cyclic=True)
        sink(draw_sample(valid_rows(frame, names, "prec"), pct=10))

    def train() -> None:
        path = new_folder(spark, "bench")
        model.update(model_path=f"{path}/model", meta_path=f"{path}/meta")
        train_global_rf_target(obs, rf_params=FOREST, min_rows_per_station=100, **HORIZON, **model)

    def predict() -> None:
        predict_grid_daily_with_global_model(grid, out_path=new_folder(spark, "grid"), **HORIZON, **model)

    def loso(k: int | None) -> Callable[[], None]:
        return lambda: sink(
            evaluate_all_stations_fast(
                obs, station_ids=TARGETS, rf_params=FOREST, k_neighbors=k, parallelism=4, **HORIZON
            )
        )

    return {
        "features_leak_sample": features,
        "scoreboard": lambda: sink(widen_scores(score_grains(pairs))),
        "knn": lambda: sink(build_station_kneighbors(obs, k=10)),
        "knn_correlation": lambda: sink(neighbor_correlations(obs, build_station_kneighbors(obs, k=10))),
        "compare_daily": lambda: sink(compare_sources(obs, product_col="prectotcorr", smooth=7)[1]),
        "global_fit": train,
        "grid_predict": predict,
        "loso_5": loso(None),
        "loso_5_knn20": loso(20),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The observation table is made from the driver tables once, as a user's input would lie on disk.
    began = time.monotonic()
    obs = stage(observations(spark, sf_dir), "observations")
    seconds = {"load_observations": time.monotonic() - began}
    for name, run in workloads(spark, obs, stations(spark, sf_dir)).items():
        began = time.monotonic()
        run()
        seconds[name] = time.monotonic() - began
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "rows": obs.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
