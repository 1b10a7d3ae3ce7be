"""Prediction with forests too large for one task.

Spark ML sends the whole model to every task. Five hundred deep trees can outgrow an executor, so above a bound on
nodes the trees are dealt into groups instead. A saved model is a table of nodes; each task takes some rows and the nodes
of one group of trees, sums what these trees say, and the sums of a row are added up. Neither the driver nor any task
holds the whole model. A tree is not cut: the largest one sets what a task needs at least.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from climspark.schema import all_present

# Nodes that a task holds at most (the largest tree at least), and rows that it takes: 80 and 50 MB or so.
NODES_PER_TASK = 2_000_000
ROWS_PER_PART = 500_000

_FOREST = "org.apache.spark.ml.regression.RandomForestRegressionModel"


def saved_nodes(spark: SparkSession, model_path: str) -> DataFrame | None:
    """Nodes of the forest in a saved pipeline: tree, node, feature, cut (values up to it go left), left, right (-1 in
    leaves) and mean. None if its last stage is no forest, or a cut is one of categories."""
    stage = f"{model_path}/stages/1_*"
    if json.loads(spark.read.text(f"{stage}/metadata").first()[0])["class"] != _FOREST:
        return None
    data = spark.read.parquet(f"{stage}/data")
    node = F.col("nodeData")
    if not data.filter(node["split"]["numCategories"] >= 0).isEmpty():
        return None
    return data.select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        node["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)), F.lit(0.0)).alias("cut"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["prediction"].alias("mean"),
    )


def deal_trees(sizes: Sequence[tuple[int, int]], nodes_per_task: int) -> dict[int, int]:
    """Group of each tree: ``sizes`` are (tree, nodes), and a group is closed before it would pass the bound."""
    groups, group, held = {}, 0, 0
    for tree, nodes in sorted(sizes):
        if held and held + nodes > nodes_per_task:
            group, held = group + 1, 0
        groups[tree] = group
        held += nodes
    return groups


def sums_of_trees(table: pa.Table, values: np.ndarray) -> np.ndarray:
    """What the trees of ``table`` say of each row of ``values`` (a column a feature), added up in order of trees."""
    column = {c: table[c].to_numpy() for c in ("tree", "node", "feature", "cut", "left", "right", "mean")}
    order = np.lexsort((column["node"], column["tree"]))
    column = {c: v[order] for c, v in column.items()}
    # Nodes of a tree are numbered without gaps, so a child's row is its tree's first row and its number.
    starts = np.flatnonzero(np.diff(column["tree"], prepend=-1))
    total = np.zeros(len(values))
    for start, end in zip(starts, [*starts[1:], len(order)]):
        feature, cut, left, right, mean = (column[c][start:end] for c in ("feature", "cut", "left", "right", "mean"))
        at = np.zeros(len(values), np.int64)
        moving = np.flatnonzero(left[at] >= 0)
        while len(moving):
            here = at[moving]
            down = np.where(values[moving, feature[here]] <= cut[here], left[here], right[here])
            at[moving] = down
            moving = moving[left[down] >= 0]
        total += mean[at]
    return total


def predict_by_trees(
    nodes: DataFrame, groups: dict[int, int], rows: DataFrame, n_rows: int, inputs: Sequence[str], output: str,
    keep: Sequence[str], rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Columns ``keep`` (which tell rows apart) and the forest's mean as ``output``; NULL where an input is missing.

    ``groups`` deals the trees. ``n_rows`` sets the number of parts; parts are drawn by a hash of ``keep``, so a cell of
    very many days is spread. Rows go through the shuffle once a group, nodes once a part.
    """
    count, parts = max(groups.values()) + 1, max(1, -(-n_rows // rows_per_part))
    names = [f"_in{i}" for i in range(len(inputs))]
    given = all_present(inputs)
    sent = rows.select(
        *keep,
        *[F.when(given, F.col(c).cast("double")).alias(n) for c, n in zip(inputs, names)],
        F.pmod(F.xxhash64(*keep), F.lit(parts)).cast("int").alias("_part"),
        F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_group"),
    )
    dealt = rows.sparkSession.createDataFrame(list(groups.items()), "tree int, _group int")
    placed = nodes.join(F.broadcast(dealt), "tree").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    kept = StructType([sent.schema[c] for c in keep])
    out = StructType([*kept.fields, StructField("_sum", DoubleType())])

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        values = np.column_stack([left[n].to_numpy() for n in names]).astype(float) if left.num_rows else np.zeros((0, len(names)))
        whole = ~np.isnan(values).any(axis=1)
        sums = np.zeros(len(values))
        sums[whole] = sums_of_trees(right, values[whole])
        return left.select(list(keep)).append_column("_sum", pa.array(sums, pa.float64(), mask=~whole))

    keys = ["_group", "_part"]
    sums = sent.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(partial, out)
    total = sums.groupBy(*keep).agg(F.sum("_sum").alias("_sum"))
    return total.select(*keep, (F.col("_sum") / F.lit(float(len(groups)))).alias(output))
