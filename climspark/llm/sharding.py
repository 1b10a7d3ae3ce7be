"""Sharding by proportional stratified interleaving.

Within each source, rows get a rank in a seeded shuffled order. Rank r of n stands at the fraction (2r - 1) / 2n of its
source, and all rows are sorted by that fraction. So any stretch of the order holds every source in proportion, and
cutting it into equal stretches gives shards that all match the mixture and whose row counts differ by one at most.

Both orders are made by range partitioning, which splits a source (or one repeated key) that holds a third of the rows
over as many tasks as it needs: a row's rank is its place in its task plus the rows of the tasks before. Only keys and
counts are moved, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climspark.llm.common import text_or_empty
from climspark.sources.staging import stage

SHARDS = 16
SEED = 20
ROWS_PER_TASK = 1_000_000
# monotonically_increasing_id: the task stands above these bits, the place in the task below.
_PLACE_BITS = 33


def positions(df: DataFrame, order: list[str], name: str, tasks: int) -> DataFrame:
    """``df`` with ``name``: each row's place, from 0, in the order of the columns ``order``.

    The sorted rows are written once with the number of their task and their place in it, so a task that runs again
    after a loss changes nothing downstream. The offsets are one row a task.
    """
    sorted_ = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    rows = stage(sorted_.withColumn("_id", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_task", F.shiftright("_id", _PLACE_BITS))
    counts = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)
    return rows.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_before") + place).drop(
        "_id", "_task", "_before"
    )


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row.

    Null sources are a source of their own. A null text counts as empty. Rows that share doc_id (repeated ones, or null
    ids) are told apart by their place in the input, so each gets a slot. No rows: no rows. With fewer rows than
    shards, some shards stay empty.
    """
    text = text_or_empty()
    keys = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    keys = stage(keys, "keys")
    total = keys.count()
    tasks = max(1, -(-total // rows_per_task), min(64, total // 2_000))

    ranked = positions(keys, ["source", "_key", "_row"], "_place", tasks)
    starts = ranked.groupBy(F.col("source").alias("_source")).agg(
        F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_n")
    )
    rank = F.col("_place") - F.col("_start") + 1
    fraction = (2 * rank - 1) / (2 * F.col("_n"))
    mixed = ranked.join(starts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_fraction", fraction)
    mixed = mixed.select("doc_id", "source", "size", "text_crc32", "_fraction", "_key", "_row")

    laid = positions(mixed, ["_fraction", "_key", "_row"], "_at", tasks)
    shard = F.floor(F.col("_at") * shards / F.lit(total)) if total else F.lit(0)
    laid = laid.withColumn("shard", shard.cast("int"))
    slot = F.col("_at") - first_of(F.col("shard"), shards, total)
    return laid.select("doc_id", "source", "size", "text_crc32", "shard", slot.alias("slot"))


def first_of(shard: Column, shards: int, total: int) -> Column:
    """The first place of a shard: the smallest p with p * shards / total >= shard."""
    return F.ceil(shard.cast("long") * F.lit(total) / F.lit(shards)).cast("long")


def op4_sharding(docs: DataFrame) -> DataFrame:
    """The contract's columns; row counts differ by one at most (law ``rows``), so there is no grown_shard."""
    return interleave(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
