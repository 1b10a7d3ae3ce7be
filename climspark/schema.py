"""Column naming and input checks shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Alternative spellings accepted for a covariate name.
COVARIATE_ALIASES = {"pretotcorr": "prectotcorr"}


@dataclass(frozen=True)
class Columns:
    """Names of the six columns of a long daily observation table."""

    id: str = "station"
    date: str = "date"
    lat: str = "latitude"
    lon: str = "longitude"
    alt: str = "altitude"
    target: str = "prec"

    @property
    def coords(self) -> list[str]:
        return [self.lat, self.lon, self.alt]


def require_columns(df: DataFrame, names: Iterable[str], what: str = "Input") -> None:
    """Raise from the schema alone (no job) when a column is absent."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")


def resolve_columns(df: DataFrame, names: str | Iterable[str] | None) -> list[str]:
    """Map names onto ``df.columns`` ignoring case and known aliases; unknown names are skipped."""
    if names is None:
        return []
    wanted = [names] if isinstance(names, str) else list(names)
    by_lower = {c.lower(): c for c in df.columns}
    keys = (str(n).lower() for n in wanted if n is not None)
    return [by_lower[k] for k in (COVARIATE_ALIASES.get(k, k) for k in keys) if k in by_lower]


def base_features(columns: Columns, add_cyclic: bool, extra: Iterable[str] = ()) -> list[str]:
    """Default model inputs: coordinates, calendar parts, optional cyclic terms, covariates."""
    names = [*columns.coords, "year", "month", "doy"]
    if add_cyclic:
        names += ["doy_sin", "doy_cos"]
    return names + [c for c in extra if c not in names]


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """A Parquet double can hold NaN, which is a value to Spark: turn it into NULL once, at ingest."""
    wanted = set(df.columns if names is None else names)
    fractional = {f.name for f in df.schema.fields if is_fractional(f.dataType)} & wanted
    if not fractional:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in df.columns if c in fractional})


def all_present(names: Iterable[str]) -> Column:
    """True where none of the columns is NULL."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).isNotNull()
    return condition
