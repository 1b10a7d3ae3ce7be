"""Resampling to calendar periods and scoring at daily, monthly and annual grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climspark.functions.calendar import period_code, period_end, period_shift, period_start, periods_between
from climspark.functions.metrics import METRICS, close_to, is_number, r_squared, score_pairs
from climspark.operators.medians import grouped_median

# Accepted bin aggregates, and (grain, period code, column suffix) of the scoreboard.
AGGREGATES = ("sum", "mean", "median")
GRAINS = (("daily", "D", "d"), ("monthly", "M", "m"), ("annual", "Y", "y"))
SCORE_COLUMNS = [f"{m.upper()}_{s}" for _, _, s in GRAINS for m in METRICS if m != "n"]

PERIOD = "_period"


def check_aggregate(agg: str) -> str:
    if agg not in AGGREGATES:
        raise ValueError(f"Unknown agg {agg!r}: choose from {AGGREGATES}")
    return agg


def _fill_gaps(bins: DataFrame, keys: Sequence[str], freq: str, value_cols: Sequence[str], fill: Column) -> DataFrame:
    """Add the empty periods between the first and last bin of each key, valued ``fill``.

    Each bin unfolds up to the one before its successor, so no second table is joined. The window
    holds one row per period, never raw rows.
    """
    ordered = Window.partitionBy(*keys).orderBy(PERIOD) if keys else Window.partitionBy(F.lit(0)).orderBy(PERIOD)
    last_empty = F.coalesce(period_shift(F.lead(PERIOD).over(ordered), freq, -1), F.col(PERIOD))
    unfolded = bins.withColumn("_until", last_empty).withColumn(
        "_slot", F.explode(periods_between(F.col(PERIOD), F.col("_until"), freq))
    )
    filled = [F.when(F.col("_slot") == F.col(PERIOD), F.col(c)).otherwise(fill).alias(c) for c in value_cols]
    return unfolded.select(*keys, F.col("_slot").alias(PERIOD), *filled)


def fill_between(bins: DataFrame, keys: Sequence[str], freq: str, value_cols: Sequence[str], fill: Column) -> DataFrame:
    """Add to bins (dated by their start, NULL where a column has no row) the empty periods between the first and last bin
    of each column, valued ``fill`` there; and ``_in_<column>``, whether a period lies between the column's ends.

    The same window as in ``_fill_gaps``; periods between the ends of no column are left out.
    """
    whole = Window.partitionBy(*keys)
    held = {c: F.when(F.col(c).isNotNull(), F.col(PERIOD)) for c in value_cols}
    ends = {c: (F.min(h).over(whole), F.max(h).over(whole)) for c, h in held.items()}
    last_empty = F.coalesce(period_shift(F.lead(PERIOD).over(whole.orderBy(PERIOD)), freq, -1), F.col(PERIOD))
    spans = {f"_{side}_{c}": e for c, both in ends.items() for side, e in zip(("first", "last"), both)}
    unfolded = bins.withColumns({"_until": last_empty, **spans}).withColumn(
        "_slot", F.explode(periods_between(F.col(PERIOD), F.col("_until"), freq))
    )
    inside = {c: F.coalesce(F.col("_slot").between(F.col(f"_first_{c}"), F.col(f"_last_{c}")), F.lit(False)) for c in value_cols}
    own = {c: F.when(F.col("_slot") == F.col(PERIOD), F.col(c)) for c in value_cols}
    filled = [F.when(inside[c], F.coalesce(own[c], fill)).alias(c) for c in value_cols]
    marks = [inside[c].alias(f"_in_{c}") for c in value_cols]
    rows = unfolded.select(*keys, F.col("_slot").alias(PERIOD), *filled, *marks)
    return rows.filter(F.greatest(*[F.col(f"_in_{c}") for c in value_cols], F.lit(False)))


def resample(
    df: DataFrame,
    keys: Sequence[str],
    value_cols: Sequence[str],
    *,
    date_col: str = "date",
    freq: str = "M",
    agg: str = "sum",
    empty_bins: bool = True,
) -> DataFrame:
    """``keys + date_col + value_cols`` per calendar period, labelled with the period's last day.

    With ``empty_bins`` every period between a key's first and last one is present: 0 for ``sum``,
    NULL for ``mean`` and ``median``. A ``sum`` over NULLs only is 0.
    """
    keys, freq = list(keys), period_code(freq)
    check_aggregate(agg)
    dated = df.filter(F.col(date_col).isNotNull()).select(
        *keys, period_start(F.col(date_col), freq).alias(PERIOD), *value_cols
    )
    if agg == "median":
        bins = grouped_median(dated, [*keys, PERIOD], value_cols)
    else:
        numbers = {c: F.when(is_number(F.col(c).cast("double")), F.col(c).cast("double")) for c in value_cols}
        aggs = [
            (F.coalesce(F.sum(v), F.lit(0.0)) if agg == "sum" else F.avg(v)).alias(c) for c, v in numbers.items()
        ]
        bins = dated.groupBy(*keys, PERIOD).agg(*aggs)
    if empty_bins:
        bins = _fill_gaps(bins, keys, freq, value_cols, F.lit(0.0) if agg == "sum" else F.lit(None).cast("double"))
    return bins.select(*keys, period_end(F.col(PERIOD), freq).alias(date_col), *value_cols)


def aggregate_and_score(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    date_col: str = "date",
    y_col: str = "y_true",
    yhat_col: str = "y_pred",
    freq: str = "M",
    agg: str = "sum",
    empty_bins: str = "zero",
) -> tuple[DataFrame, DataFrame]:
    """Resample truth and prediction, then score them: ``(metrics, resampled)``.

    For ``sum`` an empty period between the first and the last one counts as a (0, 0) pair, unless
    ``empty_bins="drop"``; for ``mean`` and ``median`` it is left out. ``keys`` scores many series
    in one job.
    """
    zero_fill = agg == "sum" and empty_bins == "zero"
    bins = resample(
        df, keys, [y_col, yhat_col], date_col=date_col, freq=freq, agg=agg, empty_bins=zero_fill
    ).dropna(subset=[y_col, yhat_col])
    return score_pairs(bins, keys, y_col, yhat_col), bins


def score_grains(
    df: DataFrame,
    keys: Sequence[str] = ("station",),
    *,
    date_col: str = "date",
    y_col: str = "y_true",
    yhat_col: str = "y_pred",
    agg: str = "sum",
) -> DataFrame:
    """Long scores ``keys + grain, n, mae, rmse, r2`` at daily, monthly and annual grain.

    For ``sum`` and ``mean`` every task first reduces its rows to one partial per key and month;
    daily and annual figures are folded from those partials. A key without pairs has no rows.
    """
    keys = list(keys)
    check_aggregate(agg)
    pairs = df.select(*keys, date_col, F.col(y_col).cast("double").alias("_y"), F.col(yhat_col).cast("double").alias("_p"))
    pairs = pairs.filter(is_number(F.col("_y")) & is_number(F.col("_p")) & F.col(date_col).isNotNull())
    if agg != "median":
        return _score_partials(_month_partials(pairs, keys, date_col), keys, agg)
    parts = [score_pairs(pairs, keys, "_y", "_p").withColumn("grain", F.lit("daily"))]
    for grain, freq, _ in GRAINS[1:]:
        scores, _ = aggregate_and_score(
            pairs, keys=keys, date_col=date_col, y_col="_y", yhat_col="_p", freq=freq, agg=agg
        )
        parts.append(scores.withColumn("grain", F.lit(grain)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*keys, "grain", *METRICS)


def _month_partials(pairs: DataFrame, keys: list[str], date_col: str) -> DataFrame:
    y, p = F.col("_y"), F.col("_p")
    d = y - p
    return pairs.groupBy(*keys, period_start(F.col(date_col), "M").alias(PERIOD)).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(y).alias("_sum_y"),
        F.sum(p).alias("_sum_p"),
        F.sum(F.abs(d)).alias("_abs"),
        F.sum(d * d).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_spread"),
        F.min(y).alias("_low"),
        F.max(y).alias("_high"),
        F.bool_and(close_to(y, p)).alias("_close"),
    )


def _score_partials(months: DataFrame, keys: list[str], agg: str) -> DataFrame:
    """All three grains from month partials, in one lineage: the rows are read and shuffled once.

    After the second shuffle, by key, nothing moves any more: the bins, the gaps between them and
    the scores all stay within a key. A key brings one row per month, never raw rows.
    """
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    centre = F.sum("_sum_y").over(whole) / F.sum("_n").over(whole)
    shift = F.col("_sum_y") / F.col("_n") - F.col("_centre")
    daily, annual = F.col("grain") == "daily", F.col("grain") == "annual"
    # Total spread of the days = spread within months + spread between them.
    bins = (
        months.withColumn("_centre", centre)
        .withColumn("_spread", F.col("_spread") + F.col("_n") * shift * shift)
        .withColumn("grain", F.explode(F.array(*[F.lit(g) for g, _, _ in GRAINS])))
        .withColumn(PERIOD, F.when(annual, period_start(F.col(PERIOD), "Y")).otherwise(F.col(PERIOD)))
        .groupBy(*keys, "grain", PERIOD)
        .agg(
            *[F.sum(c).alias(c) for c in ("_n", "_sum_y", "_sum_p", "_abs", "_sse", "_spread")],
            F.min("_low").alias("_low"),
            F.max("_high").alias("_high"),
            F.bool_and("_close").alias("_close"),
        )
    )
    y, p = F.col("_sum_y"), F.col("_sum_p")
    if agg == "mean":
        bins = bins.withColumns({c: F.when(daily, F.col(c)).otherwise(F.col(c) / F.col("_n")) for c in ("_sum_y", "_sum_p")})
    else:
        months_apart = F.when(annual, 12).otherwise(1)
        ordered = Window.partitionBy(*keys, "grain").orderBy(PERIOD)
        last_empty = F.add_months(F.lead(PERIOD).over(ordered), -months_apart)
        until = F.when(daily, F.col(PERIOD)).otherwise(F.coalesce(last_empty, F.col(PERIOD)))
        step = F.make_ym_interval(F.lit(0), months_apart)
        bins = bins.withColumn("_until", until).withColumn("_slot", F.explode(F.sequence(PERIOD, "_until", step)))
        held = F.col("_slot") == F.col(PERIOD)
        bins = bins.withColumns({c: F.when(held, F.col(c)).otherwise(0.0) for c in ("_sum_y", "_sum_p")})
    n = F.sum(F.when(daily, F.col("_n")).otherwise(1))
    scored = bins.groupBy(*keys, "grain").agg(
        n.alias("n"),
        F.sum(F.when(daily, F.col("_abs")).otherwise(F.abs(y - p))).alias("_abs"),
        F.sum(F.when(daily, F.col("_sse")).otherwise((y - p) * (y - p))).alias("_sse"),
        F.sum(F.when(daily, F.col("_spread"))).alias("_day_spread"),
        (F.var_pop(y) * F.count(y)).alias("_bin_spread"),
        F.min(F.when(daily, F.col("_low")).otherwise(y)).alias("_low"),
        F.max(F.when(daily, F.col("_high")).otherwise(y)).alias("_high"),
        F.bool_and(F.when(daily, F.col("_close")).otherwise(close_to(y, p))).alias("_close"),
    )
    sst = F.when(daily, F.col("_day_spread")).otherwise(F.col("_bin_spread"))
    r2 = r_squared(F.col("_sse"), sst, F.col("_low"), F.col("_high"), F.col("_close"))
    return scored.select(
        *keys,
        "grain",
        "n",
        (F.col("_abs") / F.col("n")).alias("mae"),
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        r2.alias("r2"),
    )


def widen_scores(scores: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """One row per key: ``n_rows`` and ``MAE_d ... R2_y`` from the long scores."""
    wide = [F.max(F.when(F.col("grain") == "daily", F.col("n"))).alias("n_rows")]
    for grain, _, suffix in GRAINS:
        for metric in METRICS[1:]:
            value = F.max(F.when(F.col("grain") == grain, F.col(metric)))
            wide.append(value.alias(f"{metric.upper()}_{suffix}"))
    return scores.groupBy(*keys).agg(*wide)


def metrics_dict(scores: DataFrame) -> dict[str, dict[str, float | None]]:
    """The three score rows of one series as ``{grain: {MAE, RMSE, R2}}``; scores of several series raise."""
    empty = {g: {"MAE": None, "RMSE": None, "R2": None} for g, _, _ in GRAINS}
    rows = scores.filter(F.col("grain").isin(list(empty))).take(len(GRAINS) + 1)
    if len({r["grain"] for r in rows}) < len(rows):
        raise ValueError("These are scores of several series: filter one of them.")
    return empty | {r["grain"]: {"MAE": r["mae"], "RMSE": r["rmse"], "R2": r["r2"]} for r in rows}
