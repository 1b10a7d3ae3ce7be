"""Reading observation tables and writing results."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from climspark.schema import Columns, nan_to_null

FORMATS = ("parquet", "csv")
# Bytes of small files that one task reads, and tasks a core that remain however few bytes there are.
BYTES_PER_TASK = 64 << 20
TASKS_PER_CORE = 4


def observation_schema(columns: Columns = Columns(), covariates: Iterable[str] = ()) -> T.StructType:
    fields = [T.StructField(columns.id, T.LongType()), T.StructField(columns.date, T.DateType())]
    numbers = dict.fromkeys([*columns.coords, columns.target, *covariates])
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in numbers])


def read_observations(
    spark: SparkSession,
    path: str,
    *,
    columns: Columns = Columns(),
    covariates: Iterable[str] = (),
    file_format: str | None = None,
) -> DataFrame:
    """A long daily table from Parquet or CSV (header expected, columns found by name); NaN as NULL."""
    schema = observation_schema(columns, covariates)
    if (file_format or _format_of(path)) == "csv":
        # The schema of a CSV read is positional: read the header's columns as text, then pick and cast.
        raw = spark.read.csv(path, header=True)
        text = raw.select(*[raw[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields])
        return nan_to_null(text)
    table = spark.read.parquet(path)
    return nan_to_null(table.select(*schema.fieldNames()))


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet dataset of very many small files, such as an export of a folder a station.

    Spark counts a file as 4 MB at least when it deals files over tasks, so it would make a task of a few of them; here the
    number of tasks follows from the bytes.
    """
    table = spark.read.parquet(path)
    held = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.coalesce(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-held // BYTES_PER_TASK)))


def _format_of(path: str) -> str:
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in (".csv", ".parquet"):
        raise ValueError(f"No writer for extension {extension!r}")
    return extension[1:]


def check_format(file_format: str) -> str:
    if file_format.lower() not in FORMATS:
        raise ValueError("Unknown file_format: choose parquet or csv.")
    return file_format.lower()


def write_table(
    df: DataFrame,
    path: str | None,
    *,
    file_format: str | None = None,
    parquet_compression: str = "snappy",
    mode: str = "overwrite",
) -> str | None:
    """Write a dataset in the format named by the path's extension; nothing without a path."""
    if path is None:
        return None
    writer = df.write.mode(mode)
    if (file_format or _format_of(path)) == "csv":
        writer.csv(path, header=True)
    else:
        writer.option("compression", parquet_compression).parquet(path)
    return path


def write_json(df: DataFrame, path: str | None) -> str | None:
    """Score rows as JSON lines; an undefined score is null."""
    if path is None:
        return None
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path
