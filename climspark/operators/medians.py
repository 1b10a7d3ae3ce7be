"""Exact medians per group that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of one first key that a single task may hold, and distinct values of one group whose median it may take.
GROUP_LIMIT = 500_000
# Value ranges a larger group is cut into, and copies of its cuts, so that its rows meet them in many tasks.
RANGES = 256
SALTS = 32


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    value_cols: Sequence[str],
    *,
    weight_col: str | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """``keys + value_cols`` with the exact median of each column, NULL and NaN left out.

    Rows are dealt by the first key, and each group's medians are taken where its rows lie: one shuffle of the rows. First
    keys with more than ``group_limit`` rows are counted out before, and their rows take a path on which no task holds a
    whole group (``_spread_median``). There are at most ``rows / group_limit`` of them, which bounds the broadcast list.
    One lazy plan: nothing runs before an action. ``weight_col`` counts copies of a row.
    """
    keys = list(keys)
    numbers = {c: F.col(c).cast("double") for c in value_cols}
    values = {c: F.when(~F.isnan(v), v) for c, v in numbers.items()}
    copies = F.lit(1) if weight_col is None else F.col(weight_col)
    rows = df.select(*keys, copies.alias("_copies"), *[v.alias(c) for c, v in values.items()])
    if not keys:
        return _spread_median(rows, keys, value_cols, group_limit)
    # Counted with the values, so that both sides need the same columns and share the shuffle that made ``df``.
    held = F.greatest(F.count(F.lit(1)), *[F.count(c) for c in value_cols])
    hot = rows.groupBy(keys[0]).agg(held.alias("_held")).filter(F.col("_held") > group_limit)
    hot = F.broadcast(hot.select(F.col(keys[0]).alias("_hot")))
    on = F.col(keys[0]).eqNullSafe(F.col("_hot"))
    small = rows.join(hot, on, "left_anti").repartition(keys[0])
    weight = () if weight_col is None else (F.col("_copies"),)
    medians = small.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5), *weight).alias(c) for c in value_cols])
    return medians.unionByName(_spread_median(rows.join(hot, on, "left_semi"), keys, value_cols, group_limit))


def _spread_median(rows: DataFrame, keys: list[str], value_cols: Sequence[str], group_limit: int) -> DataFrame:
    """The same, whatever a group holds.

    Rows are collapsed to (group, column, value, count), which tasks reduce before they shuffle and which spreads a
    large group over all tasks. Groups that still have too many distinct values are cut into value ranges, and only
    the ranges that hold the middle ranks are sorted. The parts share the collapsed rows' shuffle.
    """
    # Group keys may be NULL, and a join on the bare keys would lose those groups.
    unit = ["_group", "_name"]
    named = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in value_cols]
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    counted = (
        rows.select(*keys, "_copies", F.explode(F.array(*named)).alias("_nv"))
        .select(*keys, "_copies", F.col("_nv.name").alias("_name"), F.col("_nv.value").alias("_value"))
        .groupBy(*keys, "_name", "_value")
        .agg(F.when(F.col("_value").isNotNull(), F.sum("_copies")).otherwise(0).alias("_rows"))
        .withColumn("_group", group)
    )
    widths = counted.groupBy(*unit).agg(F.count("_value").alias("_distinct"), F.sum("_rows").alias("_total"))
    wide = widths.filter(F.col("_distinct") > group_limit).select(*unit, "_total")
    few = (
        counted.join(wide, unit, "left_anti")
        .groupBy(*keys, "_name")
        .agg(F.percentile("_value", F.lit(0.5), F.col("_rows")).alias("_median"))
    )
    medians = few.unionByName(_ranged_median(counted, wide, unit, keys))
    picked = [F.max(F.when(F.col("_name") == c, F.col("_median"))).alias(c) for c in value_cols]
    return medians.groupBy(*keys).agg(*picked)


def _ranged_median(counted: DataFrame, wide: DataFrame, unit: list[str], keys: list[str]) -> DataFrame:
    """Median of groups with very many distinct values, by rank selection inside value ranges."""
    salted = counted.withColumn("_salt", F.pmod(F.hash("_value"), F.lit(SALTS)))
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    on = [*unit, "_salt"]
    probs = [i / RANGES for i in range(1, RANGES)]
    cuts = (
        salted.join(wide.select("*", copies), on)
        .groupBy(*unit, "_total")
        .agg(F.percentile_approx("_value", probs, 100 * RANGES).alias("_cuts"))
    )
    ranged = salted.join(cuts.select("*", copies), on).select(
        *keys,
        *unit,
        "_salt",
        "_total",
        "_value",
        "_rows",
        F.size(F.filter("_cuts", lambda c: c < F.col("_value"))).alias("_range"),
    )
    # At most RANGES rows per group from here on.
    before = F.sum("_rows").over(Window.partitionBy(*unit).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    low_rank, high_rank = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = (
        ranged.groupBy(*unit, "_total", "_range")
        .agg(F.sum("_rows").alias("_rows"))
        .withColumn("_before", F.coalesce(before, F.lit(0)))
        .filter((F.col("_before") < high_rank) & (F.col("_before") + F.col("_rows") >= low_rank))
        .select(*unit, "_range", "_before")
    )
    upto = F.col("_before") + F.sum("_rows").over(Window.partitionBy(*unit, "_range").orderBy("_value"))
    ranked = ranged.join(middle.select("*", copies), [*on, "_range"]).withColumn("_upto", upto)

    def at(rank):
        return F.min(F.when(F.col("_upto") >= rank, F.col("_value")))

    return ranked.groupBy(*keys, "_name").agg(((at(low_rank) + at(high_rank)) / 2).alias("_median"))
