"""Error metrics as plain aggregate expressions (partial aggregation, one shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Absolute and relative tolerance of "equal" predictions on a constant series.
ABS_TOL = 1e-8
REL_TOL = 1e-5

METRICS = ["n", "mae", "rmse", "r2"]


def is_number(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col)


def close_to(truth: Column, pred: Column) -> Column:
    return F.abs(truth - pred) <= F.lit(ABS_TOL) + F.lit(REL_TOL) * F.abs(pred)


def r_squared(sse: Column, sst: Column, low: Column, high: Column, close: Column) -> Column:
    """1 - SSE/SST. A constant truth gives 1 if every prediction is close to it, else NULL."""
    return F.when(low == high, F.when(close, F.lit(1.0))).otherwise(1.0 - F.try_divide(sse, sst))


def score_pairs(df: DataFrame, keys: Sequence[str], y_col: str = "y_true", yhat_col: str = "y_pred") -> DataFrame:
    """``keys + n, mae, rmse, r2`` over rows where both values are present.

    Without keys the result is one row; undefined metrics are NULL.
    """
    y, p = F.col(y_col).cast("double"), F.col(yhat_col).cast("double")
    d = y - p
    sums = (
        df.filter(is_number(y) & is_number(p))
        .groupBy(*keys)
        .agg(
            F.count(y).alias("n"),
            F.avg(F.abs(d)).alias("mae"),
            F.sqrt(F.avg(d * d)).alias("rmse"),
            F.sum(d * d).alias("_sse"),
            (F.var_pop(y) * F.count(y)).alias("_sst"),
            F.min(y).alias("_low"),
            F.max(y).alias("_high"),
            F.bool_and(close_to(y, p)).alias("_close"),
        )
    )
    r2 = r_squared(*[F.col(c) for c in ("_sse", "_sst", "_low", "_high", "_close")])
    return sums.select(*keys, "n", "mae", "rmse", r2.alias("r2"))
