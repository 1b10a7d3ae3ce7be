"""Station-level operators: selection, valid-row counts, positions, slices."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climspark.functions.calendar import ensure_datetime
from climspark.operators.medians import grouped_median
from climspark.schema import Columns, all_present
from climspark.sources.staging import stage


def select_stations(
    data: DataFrame,
    *,
    id_col: str = "station",
    prefix: str | Iterable[str] | None = None,
    station_ids: Iterable[int] | None = None,
    regex: str | None = None,
    custom_filter: Callable[[int], bool] | None = None,
    where: Callable[[Column], Column] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Ids (one LONG column) matching any of the filters, OR-ed.

    No filter selects every station, and so does a set of filters without a match, unless
    ``strict``. ``station_ids`` are kept even when absent from the data. ``where`` takes a column
    predicate; a Python ``custom_filter`` runs on the distinct ids only.
    """
    ids = data.select(F.col(id_col).cast("long").alias(id_col)).dropna().distinct()
    text = F.col(id_col).cast("string")
    tests: list[Column] = []
    for p in [prefix] if isinstance(prefix, str) else prefix or []:
        tests.append(text.startswith(str(p)))
    if regex is not None:
        tests.append(text.rlike(f"^(?:{regex})"))
    if where is not None:
        tests.append(where(F.col(id_col)))
    if custom_filter is not None:
        keep = F.pandas_udf(_id_test(custom_filter), "boolean")
        tests.append(keep(F.col(id_col)))
    listed = sorted({int(i) for i in station_ids}) if station_ids is not None else []
    if not tests and not listed:
        return ids
    chosen = ids.filter(_any(tests)) if tests else ids.limit(0)
    if listed:
        named = data.sparkSession.createDataFrame([(i,) for i in listed], f"`{id_col}` long")
        return chosen.unionByName(named).distinct()
    ids = stage(ids, "ids")  # looked at twice: is there a match, and which
    chosen = ids.filter(_any(tests))
    if chosen.isEmpty():
        if strict:
            raise ValueError("No station matches the selection.")
        warnings.warn("No station matches the selection: every station is used.", stacklevel=2)
        return ids
    return chosen


def _id_test(accepts: Callable[[int], bool]) -> Callable[[pd.Series], pd.Series]:
    def test(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: bool(accepts(int(i)))).astype(bool)

    return test


def _any(tests: list[Column]) -> Column:
    condition = tests[0]
    for t in tests[1:]:
        condition = condition | t
    return condition


def valid_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows where every feature and the target are present."""
    return df.filter(all_present([*features, target]))


def count_valid_rows(df: DataFrame, features: Sequence[str], columns: Columns = Columns()) -> DataFrame:
    """``(id, valid_rows)`` per station with at least one valid row."""
    counted = valid_rows(df, features, columns.target).groupBy(columns.id)
    return counted.agg(F.count(F.lit(1)).alias("valid_rows"))


def stations_with_min_rows(
    df: DataFrame, features: Sequence[str], min_rows: int, columns: Columns = Columns()
) -> DataFrame:
    return count_valid_rows(df, features, columns).filter(F.col("valid_rows") >= int(min_rows))


def station_positions(df: DataFrame, columns: Columns = Columns(), with_altitude: bool = True) -> DataFrame:
    """Median coordinates per station.

    One pass collapses the rows to distinct places per station, usually a small table.
    """
    coords = columns.coords if with_altitude else columns.coords[:2]
    places = df.filter(F.col(columns.id).isNotNull()).groupBy(columns.id, *coords)
    return grouped_median(places.agg(F.count(F.lit(1)).alias("_copies")), [columns.id], coords, weight_col="_copies")


def slice_station_series(
    preds: DataFrame, station_id: int, *, id_col: str = "station", date_col: str = "date"
) -> DataFrame:
    """Rows of one station in date order."""
    rows = preds.filter(F.col(id_col).try_cast("long") == int(station_id))
    return ensure_datetime(rows, date_col, drop_invalid=False).orderBy(date_col)


def leave_one_out(df: DataFrame, station_id: int, id_col: str = "station") -> tuple[DataFrame, DataFrame]:
    """``(rows of the other stations, rows of the station)``."""
    return df.filter(F.col(id_col) != station_id), df.filter(F.col(id_col) == station_id)
