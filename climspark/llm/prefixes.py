"""The prefix trie of conversations, by van Emde Boas recursion.

A node of the trie is a distinct sequence of first turns. The sequences (rows of conversation, depth, turn) are cut at
half depth, the cut prefixes get names, and the upper trie and the lower forests below the cuts are cut again in the
same way, all at once: a round of the recursion treats every part of one length.

* Upwards, blocks of 1, 2, 4, ... turns get digests, each of its two halves.
* Downwards, the cut at the middle of each part is named by the name of the part's root and the digest of its upper
  half. After the last round every prefix has a name (a SHA-256 digest), and nodes are the groups of equal names.
* Upwards again, totals are grafted: a lower forest's total below a cut goes to the cut and to the nodes above it in
  the upper half, until the two halves are one part.

So depth costs rounds in its logarithm, and rows are only ever grouped by pairs of blocks of one conversation or by
node, with partial sums first. A conversation that holds a third of all turns, and a prefix that a third of all
conversations share, are spread like any others. Each round is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climspark.llm.common import small_side
from climspark.sources.staging import stage

# A conversation begins with the first turns of the first of its family of 20, fewer than 4 of them.
FAMILY = 20
LEADS = 4
WORD = r"[^\x20\x09-\x0D]+"
# Rows of one task of the sort, turns of a conversation that share a join key, children above which a node's id is
# shipped, and conversations whose ids are joined into one text.
ROWS_PER_TASK = 1_000_000
TURNS_PER_KEY = 10_000
MANY_CHILDREN = 10_000
IDS_PER_TEXT = 10_000

_ROOT = b"root"


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


# --- turns


def ordered_turns(conversations: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(conv, pos from 0, t, w) of every turn: its digest and its words.

    Turns of a conversation are ordered by turn, null first; equal turn numbers by a digest of role and text. Rows
    without conv_id belong to no conversation and are left out. The sort is by range, so a long conversation lies in
    several tasks; each task knows how many turns of its first conversation lie before it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        _digest(content.cast("binary")).alias("t"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"),
    )
    rows = stage(rows, "turns")
    n = rows.count()
    tasks = max(1, -(-n // rows_per_task), min(64, n // 10_000))
    order = ["conv", "turn", "t"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            convs = batch.column(0).to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], convs[1:] != convs[:-1]]))
            runs = np.diff(np.append(begins, len(convs)))
            within = np.arange(len(convs)) - np.repeat(begins, runs)
            if convs[0] == conv:
                within[: runs[0]] += held
            conv, held = convs[-1], int(within[-1]) + 1
            made = [batch.column(0), pa.array(within), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*made, pa.array(np.full(len(convs), task, "i4"))], names=["conv", "pos", "t", "w", "task"]
            )

    sorted_ = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = stage(sorted_.mapInArrow(run, "conv long, pos long, t binary, w long, task int"), "ordered")
    ends = placed.groupBy("task").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "pos")).alias("last"))
    carries, held = [], (None, 0)
    for r in ends.orderBy("task").collect():  # one row a task
        carry = held[1] if held[0] == r.first else 0
        carries.append((r.task, r.first, carry))
        held = (r.last.conv, r.last.pos + 1 + (carry if r.last.conv == r.first else 0))
    carried = conversations.sparkSession.createDataFrame(carries, "task int, first long, carry long")
    carry = F.when(F.col("conv") == F.col("first"), F.col("carry")).otherwise(0)
    return placed.join(F.broadcast(carried), "task").select("conv", (F.col("pos") + carry).alias("pos"), "t", "w")


def rebuilt(turns: DataFrame, family: int = FAMILY, leads: int = LEADS) -> tuple[DataFrame, DataFrame]:
    """(conv, d from 1, t, w, last) of the rebuilt conversations, and (conv, length) of every one.

    A conversation takes its first turns, fewer than ``leads``, from the first conversation of its family. ``turns``
    is read several times.
    """
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv").cast("string")) % leads
    convs = convs.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    heads = turns.filter((F.col("pos") < leads - 1) & (F.col("conv") % family == 0))
    heads = stage(heads.select(F.col("conv").alias("base"), "pos", "t", "w"), "heads")
    given = heads.groupBy("base").agg(F.count(F.lit(1)).alias("given"))
    lead = F.least(F.col("h"), F.coalesce("given", F.lit(0)))
    convs = convs.join(given, "base", "left").select(
        "conv", "n", "h", "base", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    convs = stage(convs, "conversations")
    last = (F.col("d") == F.col("length")).alias("last")
    lent = convs.join(heads, "base").filter(F.col("pos") < F.col("h")).withColumn("d", F.col("pos") + 1)
    part = F.floor(F.col("pos") / TURNS_PER_KEY)
    parts = F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / TURNS_PER_KEY)))
    keyed = convs.select("conv", "h", "lead", "length", parts.alias("part"))
    own = turns.withColumn("part", part).join(keyed, ["conv", "part"]).filter(F.col("pos") >= F.col("h"))
    own = own.withColumn("d", F.col("pos") - F.col("h") + F.col("lead") + 1)
    rows = [x.select("conv", "d", "t", "w", last) for x in (lent, own)]
    return stage(rows[0].unionByName(rows[1]), "rebuilt"), convs.select("conv", "length")


# --- names


def named(rows: DataFrame, rounds: int) -> DataFrame:
    """(conv, d, x): the name of every prefix, for sequences of fewer than 2 ** rounds turns."""
    blocks = [rows.select("conv", (F.col("d") - 1).alias("i"), "t")]
    for _ in range(1, rounds):
        halves = [F.max(F.when(F.col("i") % 2 == side, F.col("t"))).alias(name) for side, name in ((0, "upper"), (1, "lower"))]
        whole = blocks[-1].groupBy("conv", F.floor(F.col("i") / 2).alias("i")).agg(*halves)
        whole = whole.filter(F.col("lower").isNotNull()).select("conv", "i", _digest(F.col("upper"), F.col("lower")).alias("t"))
        blocks.append(stage(whole, "blocks"))
    names: list[DataFrame] = []
    for level in range(rounds - 1, -1, -1):
        size = 2**level
        uppers = blocks[level].filter(F.col("i") % 2 == 0)
        cuts = uppers.select("conv", (F.col("i") * size).alias("root"), ((F.col("i") + 1) * size).alias("d"), "t")
        made = cuts.filter(F.col("root") == 0).select("conv", "d", _digest(F.lit(_ROOT), F.col("t")).alias("x"))
        if names:
            roots = reduce(DataFrame.unionByName, names).select("conv", F.col("d").alias("root"), F.col("x").alias("above"))
            below = cuts.join(roots, ["conv", "root"]).select("conv", "d", _digest(F.col("above"), F.col("t")).alias("x"))
            made = made.unionByName(below)
        names.append(stage(made, "names"))
    return reduce(DataFrame.unionByName, names)


# --- totals


def grafted(nodes: DataFrame, paths: DataFrame, rounds: int) -> DataFrame:
    """``nodes`` with ``saved`` and ``leaves`` summed over each one's subtree.

    Before a round the sums are those within parts of 2 ** level depths. A cut's lower forest is summed from its
    children, and the sum goes to the cut and, along a member's path, to the nodes above it in the upper half.
    """
    for level in range(rounds):
        size = 2**level
        below = nodes.filter((F.col("d") - 1) % (2 * size) == size)
        forests = below.groupBy(F.col("px").alias("x")).agg(
            F.min("conv").alias("conv"), F.min("d").alias("d"), F.sum("saved").alias("more"), F.sum("leaves").alias("leafs")
        )
        gains = forests.select("x", "more", "leafs")
        if size > 1:
            forests = stage(forests, "forests")
            above = F.explode(F.sequence(F.col("d") - size, F.col("d") - 2)).alias("d")
            along = forests.select("conv", above, "more", "leafs").join(paths, ["conv", "d"])
            gains = forests.select("x", "more", "leafs").unionByName(along.select("x", "more", "leafs"))
        gains = gains.groupBy("x").agg(F.sum("more").alias("more"), F.sum("leafs").alias("leafs"))
        grown = nodes.join(gains, "x", "left")
        nodes = stage(
            grown.select(
                *[c for c in nodes.columns if c not in ("saved", "leaves")],
                (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("leafs", F.lit(0))).alias("leaves"),
            ),
            "grafted",
        )
    return nodes


def digests_of_ids(ends: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(x, ends_sha256): the SHA-256 of each x's decimal conv ids, ascending, comma-joined.

    The hash of a sequence cannot be split, but its input is: tasks of a range sort join the ids to texts, and one task
    streams a node's texts, a row for many thousand ids, without holding them.
    """

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(x: bytes, ids: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"x": [x], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

        node, ids = None, []
        for batch in batches:
            out = []
            for x, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (x != node or len(ids) >= IDS_PER_TEXT):
                    out.append(row(node, ids))
                    ids = []
                node = x
                ids.append(conv)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield row(node, ids)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for x, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if x == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = x, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict({"x": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"x": [node], "ends_sha256": [state.hexdigest()]})

    ends = stage(ends, "ends")
    n = ends.count()
    tasks = max(1, -(-n // rows_per_task), min(64, n // 10_000))
    sorted_ = ends.repartitionByRange(tasks, "x", "conv").sortWithinPartitions("x", "conv")
    texts = stage(sorted_.mapInArrow(joined, "x binary, first long, ids string"), "ids")
    by_node = texts.repartition(tasks, "x").sortWithinPartitions("x", "first")
    return by_node.mapInArrow(hashed, "x binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, leads: int = LEADS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Null role and text are empty. Repeated rows are turns of their own. Rows without conv_id are left out; other
    columns are ignored. A conversation may be left without turns; then it ends at the root. No conversations: no rows.
    """
    spark = conversations.sparkSession
    turns = ordered_turns(conversations, rows_per_task)
    rows, convs = rebuilt(turns, family, leads)
    smallest, n_convs, longest = convs.agg(F.min("conv"), F.count(F.lit(1)), F.max("length")).first()
    if not n_convs:
        return _columns(spark.createDataFrame([], "conv long, d long, parent long, n long, children long, leaves long, saved long, ends_sha256 string"))
    rounds = max(1, longest.bit_length())

    paths = stage(named(rows, rounds).join(rows.drop("t"), ["conv", "d"]), "paths")
    groups = paths.groupBy("x").agg(
        F.min("conv").alias("conv"), F.min("d").alias("d"), F.count(F.lit(1)).alias("n"), F.max("w").alias("w")
    )
    above = paths.select("conv", (F.col("d") + 1).alias("d"), F.col("x").alias("px"))
    nodes = groups.join(above, ["conv", "d"], "left").select(
        "x", "conv", "d", "n", F.coalesce("px", F.lit(_ROOT)).alias("px"), ((F.col("n") - 1) * F.col("w")).alias("saved")
    )
    nodes = stage(nodes, "nodes")
    children = nodes.groupBy(F.col("px").alias("x")).agg(F.count(F.lit(1)).alias("children"))
    children = stage(children, "children")
    nodes = nodes.join(children, "x", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    nodes = nodes.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(0).cast("long"))
    nodes = grafted(nodes, paths.select("conv", "d", "x"), rounds)

    # A node's id for its children: nodes with many are few, so they are shipped; the others are joined by shuffling.
    ids = nodes.select(F.col("x").alias("px"), F.col("conv").alias("parent"), "children")
    crowded = stage(
        ids.filter(F.col("children") > MANY_CHILDREN)
        .select("px", "parent")
        .unionByName(spark.createDataFrame([(bytearray(_ROOT), smallest)], "px binary, parent long")),
        "crowded",
    )
    shipped = small_side(crowded.withColumnRenamed("parent", "shipped"), crowded.count(), 128)
    few = ids.filter(F.col("children").between(1, MANY_CHILDREN)).select("px", "parent")
    marked = stage(nodes.join(shipped, "px", "left"), "marked")
    linked = marked.filter(F.col("shipped").isNotNull()).withColumn("parent", F.col("shipped"))
    linked = linked.unionByName(marked.filter(F.col("shipped").isNull()).join(few, "px")).drop("shipped", "px")

    root = nodes.filter(F.col("d") == 1).agg(
        F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    root = root.select(
        F.lit(_ROOT).alias("x"),
        F.lit(smallest).cast("long").alias("conv"),
        F.lit(0).cast("long").alias("d"),
        F.lit(n_convs).cast("long").alias("n"),
        "children",
        F.coalesce("saved", F.lit(0)).alias("saved"),
        F.coalesce("leaves", F.lit(1)).alias("leaves"),
        F.lit(None).cast("long").alias("parent"),
    )
    ends = paths.filter("last").select("x", "conv")
    ends = ends.unionByName(convs.filter(F.col("length") == 0).select(F.lit(_ROOT).alias("x"), "conv"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = linked.unionByName(root).join(digests_of_ids(ends, rows_per_task), "x", "left")
    return _columns(out.withColumn("ends_sha256", F.coalesce("ends_sha256", none)))


def _columns(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )


def op13_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The contract's columns of ``prefix_trie``."""
    return prefix_trie(conversations)
