"""Many forests in one pass: the trees of many targets grown level by level.

Every target (a station left out) has a pool of rows: those of its neighbours and its leaked sample. Pools overlap, so
rows are stored once, and a table of (target, station) pairs tells which rows train what. Feature values become bin
numbers, cut at distinct values, or at quantiles where there are very many.

A level of all trees of all targets is one job. Rows meet the targets they train; a task walks each row to the node that
it is in and sums weight, target, squared target and value for each (target, tree, node, feature, bin) with numpy before
anything is shuffled; sums of one node meet, and its best cut is chosen. So the number of jobs follows the depth, not the
number of targets, and rows are shuffled once only, when they are laid out by station.

What grows is the regression tree of Spark ML's forests: the cut of greatest variance reduction that leaves both sides
enough weight, and Poisson weights as bootstrap, drawn from row, tree and seed alone. One pool and seed make one forest,
however many targets are grown beside it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climspark.plans.forest import MAX_BINS, POOL_ROWS_PER_TASK, forest_params
from climspark.schema import Columns
from climspark.sources.staging import StagedFeatures, stage

# Rows that a task walks at once, and cells of sums that it holds before it sends them.
ROWS_AT_ONCE = 20_000
CELLS_HELD = 2_000_000
# Values of the Poisson distribution below this are told apart: weights above are rarer than 1e-14.
MOST_WEIGHT = 16
# Blocks of stations whose sums are added up in one task.
BLOCKS = 1024
# Nodes of trees that the driver holds; beyond, targets are grown in groups.
NODES_HELD = 2_000_000


@dataclass(frozen=True)
class Growth:
    """The parameters of a forest, by Spark ML's names, that are grown here."""

    trees: int
    depth: int
    seed: int
    bins: int
    least_rows: float
    least_gain: float
    bootstrap: bool
    rate: float

    @property
    def uncut(self) -> bool:
        """A tree is its root alone, and every row counts once: the forest is the mean of its pool."""
        return self.depth == 0 and not self.bootstrap

    @classmethod
    def same_by_spark(cls, rf_params: Mapping[str, object] | None) -> Growth | None:
        """The growth, if Spark ML grows that very forest: no cut and no draw by chance. Else None."""
        growth, given = cls.of(rf_params), forest_params(rf_params)
        drawn = given.get("bootstrap", True) or given.get("subsamplingRate", 1.0) != 1.0
        return growth if growth is not None and growth.uncut and not drawn else None

    @classmethod
    def of(cls, rf_params: Mapping[str, object] | None) -> Growth | None:
        """None if a parameter asks for what only Spark ML's own grower does."""
        given = forest_params(rf_params)
        known = {"numTrees", "maxDepth", "seed", "maxBins", "minInstancesPerNode", "minInfoGain", "bootstrap"}
        known |= {"subsamplingRate", "featureSubsetStrategy", "maxMemoryInMB"}
        if set(given) - known or given["featureSubsetStrategy"] != "all":
            return None
        value = lambda name, default: given.get(name, default)
        return cls(
            int(value("numTrees", 20)),
            int(value("maxDepth", 5)),
            int(value("seed", 42)),
            int(value("maxBins", MAX_BINS)),
            float(value("minInstancesPerNode", 1)),
            float(value("minInfoGain", 0.0)),
            bool(value("bootstrap", True)) and int(value("numTrees", 20)) > 1,
            float(value("subsamplingRate", 1.0)),
        )


@dataclass
class Trees:
    """All trees of some targets. A node is a row: its feature and cut (rows up to it go left), its left
    child (the right one follows; -1: a leaf), and its mean. Tree t of target i begins at row ``roots[i * trees + t]``."""

    targets: np.ndarray  # ascending
    trees: int
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    mean: np.ndarray

    @classmethod
    def begun(cls, targets: Sequence[int], trees: int) -> Trees:
        n = len(targets) * trees
        return cls(
            np.array(sorted(targets), np.int64), trees, np.arange(n), np.zeros(n, np.int32), np.zeros(n),
            np.full(n, -1, np.int64), np.full(n, np.nan),
        )

    def walk(self, target: np.ndarray, tree: int, values: np.ndarray) -> np.ndarray:
        """The node that each row (of ``values``, a column a feature) is in, in that tree of its target."""
        node = self.roots[np.searchsorted(self.targets, target) * self.trees + tree]
        while True:
            inner = np.flatnonzero(self.left[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = self.left[at] + (values[inner, self.feature[at]] > self.cut[at])

    def split(self, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, means: np.ndarray) -> np.ndarray:
        """Cut the nodes; returns the new ones. ``means`` has a row for each: of the left and of the right side."""
        new = len(self.left) + np.arange(2 * len(node))
        self.feature[node], self.cut[node], self.left[node] = feature, cut, new[::2]
        grow = lambda a, more: np.concatenate([a, np.asarray(more, a.dtype)])
        self.feature, self.cut = grow(self.feature, np.zeros(len(new))), grow(self.cut, np.zeros(len(new)))
        self.left, self.mean = grow(self.left, np.full(len(new), -1)), grow(self.mean, means.reshape(-1))
        return new


def poisson_weights(keys: np.ndarray, tree: int, seed: int, rate: float) -> np.ndarray:
    """How often each row is drawn for a tree: the Poisson quantile of a hash of row, tree and seed."""
    salt = np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    mixed = (keys.astype(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    uniform = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(11)).astype(float) / (1 << 53)
    steps = np.cumsum([np.exp(-rate)] + [0.0] * MOST_WEIGHT)
    term, total = np.exp(-rate), 0.0
    for k in range(MOST_WEIGHT + 1):
        total += term
        steps[k] = total
        term *= rate / (k + 1)
    return np.searchsorted(steps, uniform, side="right").astype(float)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """For each feature the values between its bins: midpoints of its distinct values if they are few, else quantiles.
    A bounded number of values of a feature reaches the driver."""
    distinct = rows.agg(*[F.approx_count_distinct(f, 0.02).alias(f) for f in features]).first()
    edges = []
    for f in features:
        values = None
        if (distinct[f] or 0) <= 2 * bins:
            found = rows.select(F.col(f).cast("double").alias("v")).distinct().orderBy("v").limit(bins + 1).collect()
            values = np.array([r.v for r in found], float)
        if values is None or len(values) > bins:
            shares = [(k + 1) / bins for k in range(bins - 1)]
            values = np.unique(rows.agg(F.percentile_approx(F.col(f).cast("double"), shares, 100_000)).first()[0])
            edges.append(values)
        else:
            edges.append((values[1:] + values[:-1]) / 2)
    return edges


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers of the rows' values: how many edges lie below."""
    return np.column_stack([np.searchsorted(e, v, side="left") for v, e in zip(values.T, edges)]).astype(np.int32)


# --- a level


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names])


def level_sums(
    trees: Trees, open_: np.ndarray, growth: Growth, edges: Sequence[np.ndarray],
    target: np.ndarray, keys: np.ndarray, values: np.ndarray, y: np.ndarray,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, sums) of rows: for the open nodes (a mark a node) the sums of weight, y, y² and the feature's value in each
    cell. A cell is node * width + the feature's first column + bin."""
    bins = binned(values, edges)
    first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    for tree in range(trees.trees):
        weight = poisson_weights(keys, tree, growth.seed, growth.rate) if growth.bootstrap else np.ones(len(y))
        node = trees.walk(target, tree, values)
        drawn = np.flatnonzero((weight > 0) & open_[node])
        if not len(drawn):
            continue
        w, v = weight[drawn], y[drawn]
        cells = (node[drawn, None] * first[-1] + first[:-1] + bins[drawn]).ravel()
        found, place = np.unique(cells, return_inverse=True)
        times = bins.shape[1]
        repeated = [np.repeat(x, times) for x in (w, w * v, w * v * v)]
        sums = [np.bincount(place, weights=x) for x in (*repeated, repeated[0] * values[drawn].ravel())]
        yield found, np.column_stack(sums)


def best_cuts(
    cells: np.ndarray, sums: np.ndarray, edges: Sequence[np.ndarray], growth: Growth
) -> list[tuple[int, int, float, float, float, float, bool]]:
    """(node, feature, cut, mean, left mean, right mean, cut or leaf) of each node whose cells (ascending) these are.

    The gain is the weighted variance's fall; ties go to the first feature and the lowest cut. Sums are taken around the
    node's mean, so that large values lose no digits.
    """
    first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    width, out = int(first[-1]), []
    node_of = cells // width
    nodes, begins = np.unique(node_of, return_index=True)
    for node, begin, end in zip(nodes.tolist(), begins.tolist(), [*begins[1:].tolist(), len(cells)]):
        column, part = cells[begin:end] % width, sums[begin:end]
        feature_of = np.searchsorted(first, column, side="right") - 1
        whole = part[feature_of == feature_of[0]].sum(axis=0)
        weight, mean = whole[0], whole[1] / whole[0]
        spread = max(0.0, whole[2] / weight - mean**2)
        best = (0.0, -1, 0.0, mean, mean)
        for f in range(len(edges)):
            mine = feature_of == f
            w, y = np.cumsum(part[mine, 0])[:-1], np.cumsum(part[mine, 1] - mean * part[mine, 0])[:-1]
            if not len(w):
                continue
            right = weight - w
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(
                    (w >= growth.least_rows) & (right >= growth.least_rows), (y**2 / w + y**2 / right) / weight, -1.0
                )
            k = int(np.argmax(gain))
            if gain[k] > best[0] * (1 + 1e-12):
                # The middle between the values beside the cut, within the edges that part their bins.
                below, above = (part[mine, 3] / part[mine, 0])[k : k + 2]
                lowest, highest = edges[f][column[mine][k] - first[f]], edges[f][column[mine][k + 1] - first[f] - 1]
                cut = float(min(max((below + above) / 2, lowest), highest))
                best = (float(gain[k]), f, cut, mean + y[k] / w[k], mean - y[k] / right[k])
        split = best[1] >= 0 and best[0] > max(growth.least_gain, 1e-12 * (spread + mean**2))
        out.append((node, best[1], best[2], float(mean), best[3], best[4], split))
    return out


def grow(
    rows: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray], targets: Sequence[int], growth: Growth
) -> Trees:
    """The forests of the targets. ``rows`` has target, key (a number of the row's own), y and the features: the rows of
    each target's pool."""
    trees = Trees.begun(targets, growth.trees)
    open_ = np.ones(len(trees.left), bool)
    context = rows.sparkSession.sparkContext
    for depth in range(growth.depth + 1):
        shipped = context.broadcast((trees, open_, list(edges)))

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, open_nodes, cuts = shipped.value

            def send(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
                cells, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                stacked = np.concatenate([s for _, s in parts])
                total = np.column_stack([np.bincount(place, weights=stacked[:, k]) for k in range(4)])
                width = sum(len(e) + 1 for e in cuts)
                node = cells // width
                nodes, begins = np.unique(node, return_index=True)
                ends = [*begins[1:].tolist(), len(cells)]
                packed = [(cells[b:e].tobytes(), total[b:e].tobytes()) for b, e in zip(begins.tolist(), ends)]
                return pa.RecordBatch.from_pydict(
                    {"node": nodes, "cells": [p[0] for p in packed], "sums": [p[1] for p in packed]}
                )

            parts, size = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    some = batch.slice(at, ROWS_AT_ONCE)
                    values = _columns(some, features).astype(float)
                    target, key, y = (some.column(some.schema.get_field_index(c)).to_numpy() for c in ("target", "key", "y"))
                    for part in level_sums(held, open_nodes, growth, cuts, target, key, values, y):
                        parts.append(part)
                        size += len(part[0])
                    if size >= CELLS_HELD:
                        yield send(parts)
                        parts, size = [], 0
            if parts:
                yield send(parts)

        def cut(table: pa.Table) -> pa.Table:
            cells = np.concatenate([np.frombuffer(c, np.int64) for c in table.column("cells").to_pylist()])
            parts = np.concatenate([np.frombuffer(s, float).reshape(-1, 4) for s in table.column("sums").to_pylist()])
            found, place = np.unique(cells, return_inverse=True)
            total = np.column_stack([np.bincount(place, weights=parts[:, k]) for k in range(4)])
            rows_ = best_cuts(found, total, shipped.value[2], growth)
            names = ["node", "feature", "cut", "mean", "lower", "upper", "split"]
            return pa.table({n: list(c) for n, c in zip(names, zip(*rows_))})

        ddl = "node long, feature long, cut double, mean double, lower double, upper double, split boolean"
        sent = rows.mapInArrow(sums, "node long, cells binary, sums binary")
        made = sent.groupBy("node").applyInArrow(cut, ddl).toPandas()  # a row an open node
        made = made.sort_values("node")
        node = made["node"].to_numpy()
        trees.mean[node] = made["mean"].to_numpy()
        open_ = np.zeros(len(trees.left), bool)
        cutting = made[made["split"]]
        if depth == growth.depth or cutting.empty:
            break
        new = trees.split(
            cutting["node"].to_numpy(), cutting["feature"].to_numpy(), cutting["cut"].to_numpy(),
            cutting[["lower", "upper"]].to_numpy(),
        )
        open_ = np.concatenate([open_, np.ones(len(new), bool)])
    return trees


def predictions(trees: Trees, rows: DataFrame, features: Sequence[str], output: str) -> DataFrame:
    """``rows`` (with a column target) and ``output``: the mean of the target's trees; NULL where a tree has no rows or a
    feature is missing."""
    shipped = rows.sparkSession.sparkContext.broadcast(trees)
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in batches:
            values = _columns(batch, features).astype(float)
            missing = np.isnan(values).any(axis=1)
            values = np.nan_to_num(values)
            target = batch.column(names.index("target")).to_numpy()
            total = sum(held.mean[held.walk(target, t, values)] for t in range(held.trees)) / held.trees
            missing |= np.isnan(total)
            made = pa.array(total, pa.float64(), mask=missing)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, output])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{output}` double")


# --- pools


SHIPPED_PAIRS = 1_000_000


def pools_of(
    staged: StagedFeatures, leaked: DataFrame | None, neighbors: DataFrame, targets: Sequence[int], columns: Columns,
    features: Sequence[str],
) -> tuple[DataFrame, set[int]]:
    """The staged rows of all targets' pools, with target, key and y; and the targets that have any.

    Rows lie by target and a hash, so that a task holds few targets, and a large pool is split.
    """
    spark = staged.frame.sparkSession
    wanted = spark.createDataFrame([(int(t),) for t in targets], "target long")
    pairs = neighbors.select(F.col("station").alias("target"), F.col("neighbor").alias("source")).join(wanted, "target", "left_semi")
    pairs = pairs.filter(F.col("target") != F.col("source")).distinct()
    rows_of = staged.counts.select(F.col(columns.id).cast("long").alias("source"), "valid_rows")
    sizes = {r.target: r.n for r in pairs.join(rows_of, "source").groupBy("target").agg(F.sum("valid_rows").alias("n")).collect()}

    def shaped(rows: DataFrame, target) -> DataFrame:
        return rows.select(
            target.alias("target"),
            F.xxhash64(F.col(columns.id).cast("long"), columns.date, F.col(columns.target).cast("double"), *features).alias("key"),
            F.col(columns.target).cast("double").alias("y"),
            *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)],
        )

    few = len(targets) * 1000 <= SHIPPED_PAIRS and pairs.count() <= SHIPPED_PAIRS
    pairs = pairs.select(F.col("target").alias("_target"), F.col("source").alias("_source"))
    source = F.col(columns.id).cast("long") == F.col("_source")
    pool = shaped(staged.frame.join(F.broadcast(pairs) if few else pairs, source), F.col("_target"))
    if leaked is not None:
        wanted = wanted.withColumnRenamed("target", "_target")
        own = leaked.join(wanted, F.col(columns.id).cast("long") == F.col("_target"), "left_semi")
        pool = pool.unionByName(shaped(own, F.col(columns.id).cast("long")))
        sizes |= dict.fromkeys((r[0] for r in own.select(F.col(columns.id).cast("long")).distinct().collect()), 0) | sizes
    tasks = max(1, min(spark.sparkContext.defaultParallelism, sum(sizes.values()) // 20_000), -(-sum(sizes.values()) // POOL_ROWS_PER_TASK))
    part = F.pmod("key", F.greatest(F.lit(1), F.lit(tasks // max(1, len(sizes)))))
    return stage(pool.repartition(tasks, "target", part), "pools"), set(sizes)


def edges_of(staged: StagedFeatures, features: Sequence[str], growth: Growth) -> list[np.ndarray]:
    """The bin edges of all staged rows: those of every group of targets."""
    names = [f"f{i}" for i in range(len(features))]
    return bin_edges(staged.frame.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names)]), names, growth.bins)


def nodes_of(growth: Growth, rows: int) -> int:
    """The most nodes of a target's trees, whose pool has so many rows."""
    return growth.trees * min(2 ** (growth.depth + 1), 2 * max(1, rows))


# --- roots


def _around(rows: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """``rows`` with each of ``sums`` replaced by the sum over the other rows of the key: those before and those after are
    added up, so that no digits are lost by taking a large row off again."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sides = [part.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col(order).asc(), F.col(order).desc())]
    others = [sum((F.coalesce(F.sum(c).over(w), F.lit(0)) for w in sides), F.lit(0)).alias(f"{c}_others") for c in sums]
    return rows.select("*", *others)


def _sums_of_others(sums: DataFrame) -> DataFrame:
    """(target, n, total): the sums over all sources but one. Sources are dealt over blocks, and blocks are added up."""
    names = ["n", "total"]
    dealt = sums.withColumn("_block", F.pmod(F.xxhash64("source"), F.lit(BLOCKS)))
    blocks = _around(dealt.groupBy("_block").agg(*[F.sum(c).alias(c) for c in names]), [], "_block", names)
    blocks = blocks.select("_block", *[F.col(f"{c}_others").alias(f"_{c}") for c in names])
    within = _around(dealt, ["_block"], "source", names).join(F.broadcast(blocks), "_block")
    return within.select(F.col("source").alias("target"), *[(F.col(f"{c}_others") + F.col(f"_{c}")).alias(c) for c in names])


def root_means(
    staged: StagedFeatures, leaked: DataFrame | None, neighbors: DataFrame | None, targets: Sequence[int], columns: Columns
) -> DataFrame:
    """``pool_means`` of staged rows."""
    return pool_means(staged.frame, leaked, neighbors, targets, columns)


def pool_means(
    rows: DataFrame, leaked: DataFrame | None, neighbors: DataFrame | None, targets: Sequence[int], columns: Columns
) -> DataFrame:
    """(target, mean), staged: the root of each target's trees, if every row counts once. Targets without a pool are left out.

    Pools overlap, so each station is summed once, and the sums of a pool's stations are added up. Without ``neighbors``
    a pool is all stations but the target. ``rows`` are read once, without their features.
    """
    wanted = rows.sparkSession.createDataFrame([(int(t),) for t in targets], "target long")

    def summed(rows: DataFrame, key: str) -> DataFrame:
        y = F.col(columns.target).cast("double")
        found = rows.groupBy(F.col(columns.id).cast("long").alias(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("total"))
        return found.filter(F.col(key).isNotNull())

    sums = summed(rows, "source")
    if neighbors is None:
        # A target without valid rows has a pool, too: all rows.
        every = sums.unionByName(wanted.select(F.col("target").alias("source"), F.lit(0).alias("n"), F.lit(0.0).alias("total")))
        every = every.groupBy("source").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        pools = _sums_of_others(stage(every, "sums")).join(wanted, "target", "left_semi")
    else:
        pairs = neighbors.select(F.col("station").alias("target"), F.col("neighbor").alias("source"))
        pairs = pairs.filter(F.col("target") != F.col("source")).distinct().join(wanted, "target", "left_semi")
        pools = pairs.join(sums, "source").select("target", "n", "total")
    if leaked is not None:
        pools = pools.unionByName(summed(leaked, "target").join(wanted, "target", "left_semi"))
    pools = pools.groupBy("target").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter(F.col("n") > 0)
    return stage(pools.select("target", (F.col("total") / F.col("n")).alias("mean")), "means")


def grown_together(
    staged: StagedFeatures, leaked: DataFrame | None, neighbors: DataFrame, targets: Sequence[int], tests: DataFrame,
    columns: Columns, features: Sequence[str], growth: Growth, edges: Sequence[np.ndarray],
) -> tuple[DataFrame, set[int]]:
    """``tests`` (rows of the targets, with the column target) with y_pred, staged; and the targets that have a pool.

    Targets are taken in groups whose trees fit the driver (``NODES_HELD``); a group costs a job a level. ``edges`` are
    those of ``edges_of``.
    """
    names = [f"f{i}" for i in range(len(features))]
    at_once = max(1, NODES_HELD // nodes_of(growth, staged.rows))
    parts, with_pool = [], set()
    for at in range(0, len(targets), at_once):
        group = targets[at : at + at_once]
        pool, able = pools_of(staged, leaked, neighbors, group, columns, features)
        with_pool |= able
        if not able:
            continue
        trees = grow(pool, names, edges, sorted(able), growth)
        mine = tests.join(F.broadcast(tests.sparkSession.createDataFrame([(t,) for t in able], "target long")), "target", "left_semi")
        shaped = mine.select("target", "date", "y_true", *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])
        parts.append(stage(predictions(trees, shaped, names, "y_pred").drop(*names), "predictions"))
    if not parts:
        empty = tests.select("target", "date", "y_true").limit(0)
        return empty.withColumn("y_pred", F.lit(None).cast("double")), with_pool
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole, with_pool
