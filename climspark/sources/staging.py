"""Intermediate tables in the shared folder, which outlive the executors that wrote them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from climspark.schema import Columns

# Rows one task should hold at most; a small table is cut no finer than the second figure, and
# into no more than MIN_TASKS tasks on its account.
ROWS_PER_TASK = 2_000_000
SMALL_TASK_ROWS = 25_000
MIN_TASKS = 8
# Tasks' worth of rows per station bucket (a directory), and the most directories.
TASKS_PER_BUCKET = 64
MAX_BUCKETS = 4096

BUCKET = "_bucket"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    folder = tempfile.mkdtemp(prefix="climspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Where this application puts its intermediate tables."""
    return f"{shared_folder(spark).rstrip('/')}/climspark-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{uuid.uuid4().hex}/{name}"


def drop_run_folder(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application; frames that still read them become invalid."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, nothing is recomputed."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class StagedFeatures:
    """A staged feature table, its rows in all and per station, and its number of buckets."""

    frame: DataFrame
    rows: int
    counts: DataFrame
    id_col: str
    buckets: int

    def rows_of(self, ids: Sequence[int]) -> DataFrame:
        """Rows of some stations. The bucket numbers fold to literals, so directories are pruned."""
        wanted = sorted({int(i) for i in ids})
        rows = self.frame.filter(F.col(self.id_col).isin(wanted))
        if self.buckets > 1:
            rows = rows.filter(F.col(BUCKET).isin([station_bucket(F.lit(i), self.buckets) for i in wanted]))
        return rows


def station_bucket(station: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(station.cast("long")), F.lit(buckets)).cast("int")


def stage_features(
    df: DataFrame, columns: Columns, features: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> StagedFeatures:
    """Stage model rows so that each fit reads just its pool, in an order set by the data alone.

    Rows lie clustered by station, sorted, and (for large tables) under one directory per bucket of
    stations, so a fit on k neighbours prunes directories and row groups. A station above
    ``rows_per_task`` is split over as many tasks as it needs; there are at most
    ``total / rows_per_task`` such stations, which bounds the broadcast list of them.
    """
    counts = df.groupBy(columns.id).agg(F.count(F.lit(1)).alias("valid_rows"))
    counts = stage(counts, "valid_rows")
    total = counts.agg(F.sum("valid_rows")).first()[0] or 0
    tasks = max(1, min(MIN_TASKS, total // SMALL_TASK_ROWS), -(-total // rows_per_task))
    buckets = max(1, min(MAX_BUCKETS, tasks // TASKS_PER_BUCKET))
    hot = counts.filter(F.col("valid_rows") > rows_per_task).select(
        columns.id, F.ceil(F.col("valid_rows") / rows_per_task).alias("_splits")
    )
    content = [columns.date, columns.target, *features]
    part = F.pmod(F.xxhash64(*content), F.coalesce("_splits", F.lit(1)))
    laid_out = (
        df.join(F.broadcast(hot), columns.id, "left")
        .withColumn("_part", part)
        .withColumn(BUCKET, station_bucket(F.col(columns.id), buckets))
        .repartition(tasks, columns.id, "_part")
        .sortWithinPartitions(BUCKET, columns.id, *content)
        .drop("_splits", "_part")
    )
    path = new_folder(df.sparkSession, "features")
    writer = laid_out.write
    (writer.partitionBy(BUCKET) if buckets > 1 else writer).parquet(path)
    frame = df.sparkSession.read.schema(laid_out.schema).parquet(path)
    return StagedFeatures(frame, total, counts, columns.id, buckets)
