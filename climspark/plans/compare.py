"""Observed values against predictions and external products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climspark.functions.calendar import DateLike, period_code, period_end, period_start, prepare_dates
from climspark.functions.metrics import METRICS, is_number, score_pairs
from climspark.operators.medians import grouped_median
from climspark.operators.scoring import PERIOD, check_aggregate, fill_between
from climspark.schema import Columns, require_columns

OBSERVED = "obs"


# Rows of a series that one task smooths.
SMOOTH_ROWS = 1_000_000


def _centred(partition, order_col: str, width: int):
    return partition.orderBy(order_col).rowsBetween(-(width // 2), (width - 1) // 2)


def smooth_rows(
    series: DataFrame,
    keys: Sequence[str],
    value_cols: str | Sequence[str],
    width: int,
    date_col: str = "date",
    rows_per_task: int = SMOOTH_ROWS,
) -> DataFrame:
    """Centred rolling mean over ``width`` rows in date order, of raw rows, of which a key may hold any number (dates unique
    per key). Of several columns each is a series of its own, whose rows are those where it is not NULL; a row holds one at least.

    A key of up to ``rows_per_task`` rows is one window: one shuffle of its rows. Larger keys, of which there are at most
    ``rows / rows_per_task``, are counted out before. Their rows are numbered through per-day counts, cut into stretches,
    and each stretch borrows ``width`` rows from its neighbours.
    """
    keys, value_cols = list(keys), [value_cols] if isinstance(value_cols, str) else list(value_cols)
    counts = series.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)), *[F.count(c) for c in value_cols]).alias("_held"))
    large = counts.filter(F.col("_held") > rows_per_task).select(*[F.col(k).alias(f"_large_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys]
    small = series.join(F.broadcast(large), on, "left_anti")
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
    numbered = small.withColumns({f"_at_{c}": F.count(c).over(upto) for c in value_cols})
    smoothed = _smoothed(numbered, whole, value_cols, width).select(*series.columns)
    return smoothed.unionByName(
        _smooth_stretches(series.join(F.broadcast(large), on, "left_semi"), keys, value_cols, width, date_col, rows_per_task)
    )


def _smoothed(numbered: DataFrame, partition, value_cols: Sequence[str], width: int) -> DataFrame:
    """Each column's mean over the rows whose numbers among its own (``_at_<column>``) lie around a row's."""
    lower, upper = -(width // 2), (width - 1) // 2
    means = {c: F.avg(c).over(partition.orderBy(f"_at_{c}").rangeBetween(lower, upper)) for c in value_cols}
    return numbered.withColumns({c: F.when(F.col(c).isNotNull(), m) for c, m in means.items()})


def _smooth_stretches(
    series: DataFrame, keys: list[str], value_cols: Sequence[str], width: int, date_col: str, rows_per_task: int
) -> DataFrame:
    """The same for keys of very many rows. A stretch is of rows whatever they hold; numbers are a column's own."""
    dated = series.withColumn("_day", F.to_date(date_col)).withColumn("_key", F.to_json(F.struct(*keys)))
    numbers = {c: F.count(c) for c in value_cols}
    offsets = dated.groupBy("_key", "_day").agg(*[n.alias(f"_rows_{c}") for c, n in numbers.items()])
    days = Window.partitionBy("_key").orderBy("_day")
    before = [(F.sum(f"_rows_{c}").over(days) - F.col(f"_rows_{c}")).alias(f"_offset_{c}") for c in value_cols]
    offsets = offsets.select("_key", "_day", *before)
    within = Window.partitionBy("_key", "_day").orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
    at = {f"_at_{c}": F.col(f"_offset_{c}") + F.count(c).over(within) for c in value_cols}
    numbered = dated.join(offsets, ["_key", "_day"]).withColumns(at)
    parts = []
    for c in value_cols:
        # A column at a time: its rows alone, cut by its own numbers.
        rows = numbered.filter(F.col(c).isNotNull()).select(*keys, "_key", date_col, c, f"_at_{c}")

        def stretch(position):
            return F.floor(position / rows_per_task)

        place = F.col(f"_at_{c}")
        lent = rows.withColumn("_stretch", F.explode(F.sequence(stretch(place - width), stretch(place + width))))
        smoothed = _smoothed(lent, Window.partitionBy("_key", "_stretch"), [c], width)
        smoothed = smoothed.filter(F.col("_stretch") == stretch(place))
        others = [F.lit(None).cast("double").alias(o) for o in value_cols if o != c]
        parts.append(smoothed.select("_key", *keys, date_col, F.col(c).cast("double").alias(c), *others))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    if len(value_cols) > 1:
        whole = whole.groupBy("_key", *keys, date_col).agg(*[F.max(c).alias(c) for c in value_cols])
    return whole.select(*series.columns)


def compare_sources(
    data: DataFrame,
    *,
    columns: Columns = Columns(),
    station_id: int | None = None,
    obs_col: str | None = None,
    product_col: str | None = None,
    predicted: DataFrame | None = None,
    predicted_value_col: str = "y_pred_full",
    extra: DataFrame | Sequence[float] | None = None,
    extra_date_col: str = "date",
    extra_value_col: str | None = None,
    start: DateLike | None = None,
    end: DateLike | None = None,
    resample_to: str | None = "D",
    agg: str = "mean",
    smooth: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Align up to four sources and score them against the observed one.

    Returns ``(station, date, <sources>)`` and ``(station, source, n, mae, rmse, r2)``. The sources
    are ``obs`` and ``nasa`` (columns of ``data``), ``rf`` and ``extra`` (tables with a date; one
    without a station column belongs to ``station_id``). Without ``station_id`` all stations are
    compared in the same job. Scores use the periods that both sides have. ``extra`` may be a plain
    list of numbers, one per period of the station's observed series.
    """
    if station_id is not None:
        data = data.filter(F.col(columns.id) == station_id)
        if data.isEmpty():
            raise ValueError(f"Station {station_id} does not occur in the data.")
    own = {OBSERVED: obs_col or columns.target}
    if product_col is not None:
        own["nasa"] = product_col
    parts = [_sources(data, own, columns, columns.date, station_id, start, end)]
    sources = list(own)
    if predicted is not None:
        date_col = columns.date if columns.date in predicted.columns else "date"
        parts.append(_sources(predicted, {"rf": predicted_value_col}, columns, date_col, station_id, start, end))
        sources.append("rf")
    vector = extra if isinstance(extra, (list, tuple)) else None
    if isinstance(extra, DataFrame):
        if extra_value_col is None:
            raise ValueError("An `extra` table needs extra_value_col.")
        parts.append(_sources(extra, {"extra": extra_value_col}, columns, extra_date_col, station_id, start, end))
    elif extra is not None and vector is None:
        raise TypeError("`extra` is neither a DataFrame nor a list of numbers.")
    if extra is not None:
        sources.append("extra")
    series = parts[0]
    for rows in parts[1:]:
        series = series.unionByName(rows, allowMissingColumns=True)
    keys, held = ["station", "source"], [s for s in sources if vector is None or s != "extra"]
    smooth = smooth if smooth is not None and smooth > 1 else None
    if resample_to is None:
        # Dates are unique per source here, as positions in a series; copies are averaged.
        aligned = series.groupBy("station", "date").agg(*[F.avg(s).alias(s) for s in held])
        aligned = aligned if smooth is None else smooth_rows(aligned, ["station"], held, smooth)
        marks = {s: F.col(s).isNotNull() for s in held}
    else:
        aligned, marks = _resampled(series, held, resample_to, agg, smooth), {s: F.col(f"_in_{s}") for s in held}
    if vector is not None:
        given = _align_vector(aligned.filter(marks[OBSERVED]), vector, station_id)
        aligned = aligned.join(given, ["station", "date"], "left")
    aligned = aligned.select("station", "date", *sources)
    rivals = [s for s in sources if s != OBSERVED]
    scores = None
    if rivals:
        pairs = aligned.select(
            "station",
            F.col(OBSERVED).alias("y_true"),
            F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("value")) for s in rivals])).alias("r"),
        ).select("station", "r.source", "y_true", F.col("r.value").alias("y_pred"))
        scores = score_pairs(pairs, keys)
    else:
        scores = data.sparkSession.createDataFrame([], "station long, source string, n long, mae double, rmse double, r2 double")
    return aligned, scores.select(*keys, *METRICS)


def _resampled(series: DataFrame, sources: Sequence[str], freq: str, agg: str, smooth: int | None) -> DataFrame:
    """(station, date, sources, marks): a row per period, sources side by side, each filled, and smoothed, between its own
    first and last period, where its mark ``_in_<source>`` is true.

    The windows hold one row per period. Beyond its ends a source has no value, which a mean skips.
    """
    freq = period_code(freq)
    check_aggregate(agg)
    dated = series.select("station", period_start(F.col("date"), freq).alias(PERIOD), *sources)
    if agg == "median":
        bins = grouped_median(dated, ["station", PERIOD], sources)
    else:
        bins = dated.groupBy("station", PERIOD).agg(*[(F.sum(s) if agg == "sum" else F.avg(s)).alias(s) for s in sources])
    fill = F.lit(0.0) if agg == "sum" else F.lit(None).cast("double")
    filled = fill_between(bins, ["station"], freq, sources, fill)
    if smooth is not None:
        frame = _centred(Window.partitionBy("station"), PERIOD, smooth)
        filled = filled.withColumns({s: F.when(F.col(f"_in_{s}"), F.avg(s).over(frame)) for s in sources})
    return filled.withColumn("date", period_end(F.col(PERIOD), freq)).drop(PERIOD)


def _sources(
    table: DataFrame,
    value_cols: dict[str, str],
    columns: Columns,
    date_col: str,
    station_id: int | None,
    start: DateLike | None,
    end: DateLike | None,
) -> DataFrame:
    """``(station, date, <sources>)`` rows of some columns of one table that hold any value; NaN is none."""
    require_columns(table, [date_col, *value_cols.values()], f"Source of {list(value_cols)}")
    id_col = next((c for c in (columns.id, "station") if c in table.columns), None)
    if id_col is None and station_id is None:
        raise ValueError(f"Source of {list(value_cols)} has no station column: pass station_id.")
    if id_col is not None and station_id is not None:
        table = table.filter(F.col(id_col) == station_id)
    station = F.lit(station_id) if id_col is None else F.col(id_col)
    values = {s: F.col(c).cast("double") for s, c in value_cols.items()}
    return (
        prepare_dates(table, date_col, start, end)
        .select(
            station.cast("long").alias("station"),
            F.col(date_col).cast("timestamp_ntz").alias("date"),
            *[F.when(is_number(v), v).alias(s) for s, v in values.items()],
        )
        .filter(F.coalesce(*values).isNotNull())
    )


def _align_vector(observed: DataFrame, values: Sequence[float], station_id: int | None) -> DataFrame:
    """A bare vector takes the dates of the observed series, in order; the lengths must agree."""
    if station_id is None:
        raise ValueError("A vector `extra` needs station_id.")
    count = observed.count()
    if count != len(values):
        raise ValueError(f"`extra` holds {len(values)} values for {count} observed periods.")
    numbered = observed.select(
        "station", "date", F.row_number().over(Window.partitionBy("station").orderBy("date")).alias("_at")
    )
    given = observed.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values, 1)], "_at int, value double")
    return numbered.join(given, "_at").select("station", "date", F.col("value").alias("extra"))
