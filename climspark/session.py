"""A Spark session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Zone-free dates need one zone; adaptive execution splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.scheduler.mode": "FAIR",
}


def get_session(app_name: str = "climspark", master: str | None = None, **extra: str) -> SparkSession:
    """``extra`` settings override the defaults; keys use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
