"""Seeded samples of exact size, taken per station without sorting a whole station in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climspark.operators.stations import valid_rows
from climspark.schema import Columns

# Leading hex digits of the hash that cut a station into slices of like size.
SLICE_DIGITS = 3


def _draw_order(columns: Columns, seed: int) -> Column:
    date = F.to_date(F.col(columns.date)).cast("string")
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(columns.id).cast("string"), date))


def draw_sample(valid: DataFrame, columns: Columns = Columns(), *, pct: float, seed: int = 42) -> DataFrame:
    """Of every station, the ``ceil(n * pct / 100)`` rows that come first in hash order.

    Rows are ordered by ``md5(seed|station|date)``. The hash space is cut into slices: their counts
    tell which slices the sample reaches, so the other rows drop out before anything is ranked,
    and rows are ranked just inside a slice, never across a whole station.
    """
    pct = max(0.0, min(float(pct), 100.0))
    if pct == 0.0:
        return valid.limit(0)
    hashed = valid.withColumn("_draw", _draw_order(columns, seed)).withColumn(
        "_slice", F.substring("_draw", 1, SLICE_DIGITS)
    )
    station = Window.partitionBy(columns.id)
    # At most 16 ** SLICE_DIGITS rows per station.
    slices = (
        hashed.groupBy(columns.id, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(station.orderBy("_slice")) - F.col("_rows"))
        .withColumn("_take", F.ceil(F.sum("_rows").over(station) * F.lit(pct / 100.0)))
        .filter(F.col("_before") < F.col("_take"))
        .select(columns.id, "_slice", "_before", "_take")
    )
    ties = [F.col(c) for c in valid.columns if c not in (columns.id, columns.date)]
    inside = Window.partitionBy(columns.id, "_slice").orderBy("_draw", columns.date, *ties)
    ranked = hashed.join(slices, [columns.id, "_slice"]).withColumn("_rank", F.row_number().over(inside))
    return ranked.filter(F.col("_before") + F.col("_rank") <= F.col("_take")).select(*valid.columns)


def sample_target_for_training(
    df: DataFrame,
    *,
    columns: Columns = Columns(),
    feature_cols: Sequence[str],
    station_id: int,
    include_target_pct: float,
    random_state: int = 42,
) -> DataFrame:
    """Exactly ``ceil(n * pct / 100)`` of the station's valid rows, without replacement."""
    eligible = valid_rows(df.filter(F.col(columns.id) == station_id), feature_cols, columns.target)
    return draw_sample(eligible, columns, pct=include_target_pct, seed=random_state)
