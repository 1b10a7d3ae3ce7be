"""Dates: cleaning, clipping, calendar features and resampling periods."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DateLike = str | dt.date | dt.datetime

# Accepted period codes -> (unit for trunc(), step in months, step in days).
PERIODS = {
    "D": (None, 0, 1),
    "W": ("week", 0, 7),
    "M": ("month", 1, 0),
    "Q": ("quarter", 3, 0),
    "Y": ("year", 12, 0),
}
PERIOD_ALIASES = {"ME": "M", "QE": "Q", "YE": "Y", "A": "Y"}


def period_code(freq: str) -> str:
    code = PERIOD_ALIASES.get(freq.upper(), freq.upper())
    if code not in PERIODS:
        raise ValueError(f"freq must be one of {sorted([*PERIODS, *PERIOD_ALIASES])}, got {freq!r}")
    return code


def period_start(date: Column, freq: str) -> Column:
    """First day of the period holding ``date``."""
    unit = PERIODS[period_code(freq)][0]
    return F.to_date(date) if unit is None else F.trunc(date, unit)


def period_shift(start: Column, freq: str, steps: int) -> Column:
    _, months, days = PERIODS[period_code(freq)]
    return F.add_months(start, months * steps) if months else F.date_add(start, days * steps)


def period_end(start: Column, freq: str) -> Column:
    """Last day of a period: the label of a resampled row (week ends on Sunday)."""
    return F.date_sub(period_shift(start, freq, 1), 1)


def periods_between(first: Column, last: Column, freq: str) -> Column:
    """Array of period starts from ``first`` to ``last``, both included."""
    _, months, days = PERIODS[period_code(freq)]
    step = F.make_ym_interval(F.lit(0), F.lit(months)) if months else F.make_dt_interval(F.lit(days))
    return F.sequence(first, last, step)


def _bound(data_type: T.DataType, value: DateLike) -> Column:
    return F.lit(value if isinstance(value, str) else value.isoformat()).cast(data_type)


def clip_dates(df: DataFrame, date_col: str, start: DateLike | None = None, end: DateLike | None = None) -> DataFrame:
    """Keep ``start <= date <= end``; an open end needs no bound (and no min/max job).

    The bounds are cast to the column's own type, so the column stays bare and the predicate can
    reach a Parquet scan. A bare end date means midnight: later times on that day fall out.
    """
    data_type = df.schema[date_col].dataType
    if start is not None:
        df = df.filter(F.col(date_col) >= _bound(data_type, start))
    if end is not None:
        df = df.filter(F.col(date_col) <= _bound(data_type, end))
    return df


def ensure_datetime(
    df: DataFrame, date_col: str = "date", formats: Sequence[str] = (), drop_invalid: bool = True
) -> DataFrame:
    """Give ``date_col`` a zone-free type and drop rows whose date cannot be read.

    Text is read as ISO 8601 (an offset is dropped, the wall clock kept), then by each of
    ``formats`` in turn. Zoned timestamps become the wall clock of the session time zone.
    """
    data_type = df.schema[date_col].dataType
    if isinstance(data_type, T.StringType):
        raw = F.trim(F.col(date_col))
        tries = [raw.try_cast("timestamp_ntz")]
        tries += [F.try_to_timestamp(raw, F.lit(f)).cast("timestamp_ntz") for f in formats]
        df = df.withColumn(date_col, F.coalesce(*tries))
    elif isinstance(data_type, T.TimestampType):
        df = df.withColumn(date_col, F.col(date_col).cast("timestamp_ntz"))
    elif not isinstance(data_type, (T.DateType, T.TimestampNTZType)):
        raise ValueError(f"Column {date_col!r} of type {data_type.simpleString()} holds no dates")
    return df.filter(F.col(date_col).isNotNull()) if drop_invalid else df


def prepare_dates(
    df: DataFrame,
    date_col: str,
    start: DateLike | None = None,
    end: DateLike | None = None,
    formats: Sequence[str] = (),
) -> DataFrame:
    """Clean and clip. A typed date column is clipped first, so the scan can skip row groups."""
    if isinstance(df.schema[date_col].dataType, T.StringType):
        return clip_dates(ensure_datetime(df, date_col, formats), date_col, start, end)
    return ensure_datetime(clip_dates(df, date_col, start, end), date_col, formats)


def add_time_features(df: DataFrame, date_col: str = "date", add_cyclic: bool = False, narrow: bool = False) -> DataFrame:
    """Add ``year, month, doy`` and, on request, the sine and cosine of the day of year.

    ``narrow`` stores the parts as small integers and 32-bit floats, as the global model does.
    """
    date = F.col(date_col)
    types = ("short", "byte", "short", "float") if narrow else ("int", "int", "int", "double")
    angle = F.dayofyear(date) * F.lit(2.0) * F.pi() / F.lit(365.25)
    parts = {
        "year": F.year(date).cast(types[0]),
        "month": F.month(date).cast(types[1]),
        "doy": F.dayofyear(date).cast(types[2]),
    }
    if add_cyclic:
        parts["doy_sin"] = F.sin(angle).cast(types[3])
        parts["doy_cos"] = F.cos(angle).cast(types[3])
    return df.withColumns(parts)


def explode_days(
    df: DataFrame, date_col: str, start: DateLike, end: DateLike, keys: Sequence[str] = (), partitions: int = 0
) -> DataFrame:
    """One row per input row and calendar day of ``[start, end]``.

    A generator rather than a join. With ``partitions``, rows fan out to years first, those are
    spread over that many tasks, and each task unfolds its own days.
    """
    lo, hi = _bound(T.DateType(), start), _bound(T.DateType(), end)
    if not partitions:
        return df.withColumn(date_col, F.explode(F.sequence(lo, hi)))
    years = df.withColumn("_year", F.explode(F.sequence(F.year(lo), F.year(hi))))
    spread = years.repartition(partitions, *keys, "_year")
    first = F.greatest(lo, F.make_date(F.col("_year"), F.lit(1), F.lit(1)))
    last = F.least(hi, F.make_date(F.col("_year"), F.lit(12), F.lit(31)))
    return spread.withColumn(date_col, F.explode(F.sequence(first, last))).drop("_year")


def _as_date(value: DateLike) -> dt.date:
    return dt.datetime.fromisoformat(str(value)).date()


def count_days(start: DateLike, end: DateLike) -> int:
    """Number of days in ``[start, end]``; raises when there are none."""
    days = (_as_date(end) - _as_date(start)).days + 1
    if days < 1:
        raise ValueError("The span holds no day.")
    return days
