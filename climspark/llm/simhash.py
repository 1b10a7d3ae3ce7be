"""SimHash near copies: fingerprints of word shingles, joined by walking pairs of binary-trie nodes.

Fingerprints of 64 bits that differ in at most 3 bits agree on at least one of four blocks of 16 bits. So the distinct
fingerprints are dealt four times, once by each block (which becomes the top of the word by rotation), and every group
that shares a block is joined with itself in one task: a sorted array is a binary trie whose nodes are ranges; pairs of
nodes are walked down together, the bits in which they part are counted, and a pair is dropped once it parts in more
than 3. A block value shared by very many fingerprints is dealt further by the next bits of the trie, each pair of
sub-tries within the error budget being a task of its own.

A task yields a spanning forest of what it found (at most one link a fingerprint), not the pairs; node pairs that
already lie in one class are pruned. Star contraction in Spark joins the forests. Copies fold into one row
before anything is dealt, and nothing but these keys is moved.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climspark.llm.common import encoded, free_name, map_batches, plain_names, small_side
from climspark.sources.staging import stage

BITS = 64
MAX_DIFF = 3
SHINGLE = 3
SEED = 42
BLOCKS = 4
BLOCK_BITS = BITS // BLOCKS
# Fingerprints that one task joins at most before its group is dealt by further bits of the trie.
GROUP_LIMIT = 100_000
# Bytes of a broadcast row of two numbers, with its share of the hash table.
ROW_BYTES = 72
# Node pairs that are walked at once, and pairs of leaves that are compared at once.
FRONTIER = 1 << 18
LEAF_PAIRS = 16

_HASH = xxhash.xxh64_intdigest


def fingerprint(text: str | None) -> int:
    """64 majority votes over the hashes of all shingles; no words: zero."""
    words = encoded(text).translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return _HASH(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hashes = np.array([_HASH(line[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)  # little-endian
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(8):
        ones[8 * k : 8 * k + 8] = np.bincount(octets[:, k], minlength=256) @ _OCTET_BITS
    set_ = np.flatnonzero(2 * ones > len(hashes))
    return int(np.bitwise_or.reduce(np.uint64(1) << set_.astype(np.uint64))) if len(set_) else 0


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_OCTET_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def with_fingerprint(df: DataFrame, carry: list[str], name: str) -> DataFrame:
    """``carry`` and the fingerprint of ``text`` as a signed long."""

    def rows(batch: pa.RecordBatch):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        return (np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64),)

    source = df.select(*dict.fromkeys([*carry, "text"]))
    return map_batches(source, lambda b: [pa.array(rows(b)[0])], f"`{name}` long", carry)


# --- the trie walk inside a task


class Classes:
    """Classes of array positions under unions; the root is the smallest position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            lo, hi = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where each range [lo, hi), whose keys agree above ``bit``, passes from 0 to 1 at ``bit``."""
    one = np.uint64(1) << np.uint64(bit)
    above = ~((one << np.uint64(1)) - np.uint64(1)) if bit < BITS - 1 else np.uint64(0)
    return np.searchsorted(keys, (keys[lo] & above) | one, side="left").clip(lo, hi)


def _compare(keys, classes, a_lo, a_hi, b_lo, b_hi) -> None:
    """Unites all pairs of two ranges within the budget; the ranges may be the same."""
    na, nb = a_hi - a_lo, b_hi - b_lo
    counts = na * nb
    which = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    i, j = a_lo[which] + at // nb[which], b_lo[which] + at % nb[which]
    close = (np.bitwise_count(keys[i] ^ keys[j]) <= MAX_DIFF) & (i != j)
    classes.union(i[close], j[close])


def join_tries(keys: np.ndarray, cells: list[tuple[int, int, int, int, int, int]]) -> np.ndarray:
    """The root position of every key, after uniting all keys within ``MAX_DIFF`` bits under the given node pairs.

    ``keys`` are sorted and distinct. A cell is (lo, hi, lo, hi, bits parted so far, next bit).
    """
    classes = Classes(len(keys))
    stacks: dict[int, list[np.ndarray]] = {}
    for cell in cells:
        stacks.setdefault(cell[5], []).append(np.array([cell[:5]], dtype=np.int64))
    work = [(bit, np.concatenate(parts)) for bit, parts in stacks.items()]
    while work:
        bit, pairs = work.pop()
        if len(pairs) > FRONTIER:
            work += [(bit, pairs[i : i + FRONTIER]) for i in range(0, len(pairs), FRONTIER)]
            continue
        a_lo, a_hi, b_lo, b_hi, diff = pairs.T
        pairs = pairs[(a_hi > a_lo) & (b_hi > b_lo) & ((a_lo != b_lo) | (a_hi - a_lo > 1))]
        if not len(pairs):
            continue
        a_lo, a_hi, b_lo, b_hi, diff = pairs.T
        # A pair of nodes that already lies in one class has nothing to add.
        change = np.concatenate([[0], np.cumsum(classes.root[1:] != classes.root[:-1])])
        one = (change[a_hi - 1] == change[a_lo]) & (change[b_hi - 1] == change[b_lo])
        pairs = pairs[~(one & (classes.root[a_lo] == classes.root[b_lo]))]
        if not len(pairs):
            continue
        a_lo, a_hi, b_lo, b_hi, diff = pairs.T
        # Few enough leaves, or no bit left: compare them all. A budget that covers the remaining bits unites all.
        small = ((a_hi - a_lo) * (b_hi - b_lo) <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            _compare(keys, classes, a_lo[small], a_hi[small], b_lo[small], b_hi[small])
        all_ = ~small & (diff + bit + 1 <= MAX_DIFF)
        for lo, hi, lo2, hi2, _ in pairs[all_]:
            members = np.r_[lo:hi, lo2:hi2]
            classes.union(members[:-1], members[1:])
        pairs = pairs[~small & ~all_]
        if not len(pairs):
            continue
        a_lo, a_hi, b_lo, b_hi, diff = pairs.T
        a_mid, b_mid = _split(keys, a_lo, a_hi, bit), _split(keys, b_lo, b_hi, bit)
        same = a_lo == b_lo
        zero = np.stack([a_lo, a_mid, b_lo, b_mid, diff], axis=1)
        ones = np.stack([a_mid, a_hi, b_mid, b_hi, diff], axis=1)
        parted = diff < MAX_DIFF
        left = np.stack([a_lo, a_mid, b_mid, b_hi, diff + 1], axis=1)[parted]
        right = np.stack([a_mid, a_hi, b_lo, b_mid, diff + 1], axis=1)[parted & ~same]
        work.append((bit - 1, np.concatenate([zero, ones, left, right])))
    return classes.root


def rotated(keys: np.ndarray, block: int) -> np.ndarray:
    """The block with number ``block`` from the top moved to the top."""
    if block == 0:
        return keys
    by = np.uint64(block * BLOCK_BITS)
    return (keys << by) | (keys >> (np.uint64(BITS) - by))


def _groups(keys: np.ndarray, bit: int) -> list[tuple[int, int]]:
    tops = keys >> np.uint64(bit)
    edges = np.flatnonzero(np.concatenate([[True], tops[1:] != tops[:-1], [True]]))
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1]


def forest_links(fingerprints: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (key, smaller key of its class) among fingerprints that share the given block."""
    keys = np.unique(rotated(fingerprints, block))
    bit = BITS - BLOCK_BITS
    root = join_tries(keys, [(a, b, a, b, 0, bit - 1) for a, b in _groups(keys, bit)])
    return _links(keys, root, block)


def cell_links(
    fingerprints: np.ndarray, block: int, depth: int, mine: int, other: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links across two sub-tries (or, if they are the same, inside one) ``depth`` bits below a shared block."""
    keys = np.unique(rotated(fingerprints, block))
    bit = BITS - BLOCK_BITS - depth
    if mine == other:
        cell = (0, len(keys), 0, len(keys), 0, bit - 1)
    else:
        own = (keys >> np.uint64(bit)) & np.uint64((1 << depth) - 1)
        mid = int(np.searchsorted(own, np.uint64(other)))
        cell = (0, mid, mid, len(keys), (mine ^ other).bit_count(), bit - 1)
    return _links(keys, join_tries(keys, [cell]), block)


def _links(keys, root, block):
    moved = np.flatnonzero(root != np.arange(len(keys)))
    back = (BLOCKS - block) % BLOCKS
    return rotated(keys[moved], back), rotated(keys[root[moved]], back)


# --- the join in Spark


def near_links(distinct: DataFrame, fp: str = "fp", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links ``a``, ``b`` that span the classes of fingerprints within ``MAX_DIFF`` bits of each other.

    ``distinct`` holds each fingerprint once. At most ``BLOCKS`` links a fingerprint come out (more only for those of
    groups above ``group_limit``).
    """
    rows = distinct.count()
    if not rows:
        return distinct.select(F.col(fp).alias("a"), F.col(fp).alias("b"))
    block_of = [
        F.shiftrightunsigned(F.col(fp), BITS - BLOCK_BITS * (k + 1)).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
        for k in range(BLOCKS)
    ]
    dealt = distinct.select(
        F.col(fp).alias("fp"), F.posexplode(F.array(*block_of)).alias("block", "value")
    )
    # A group above the limit holds over group_limit rows, so there are at most BLOCKS * rows / group_limit of them.
    large = []
    if rows > group_limit:
        counts = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
        large = [(r.block, r.value, r.n) for r in counts.filter(F.col("n") > group_limit).collect()]
    tasks = max(12, -(-rows * BLOCKS // group_limit))
    if large:
        heavy = distinct.sparkSession.createDataFrame(large, "block int, value int, n long")
        dealt = dealt.join(F.broadcast(heavy), ["block", "value"], "left")
        usual, hot = dealt.filter("n is null"), dealt.filter("n is not null")
        return _usual_links(usual, tasks).unionByName(_hot_links(hot, group_limit))
    return _usual_links(dealt, tasks)


def _usual_links(dealt: DataFrame, tasks: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        if parts:
            fps, blocks = (np.concatenate(x) for x in zip(*parts))
            for block in range(BLOCKS):
                a, b = forest_links(fps[blocks == block], block)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    return dealt.repartition(tasks, "block", "value").select("fp", "block").mapInArrow(run, "a long, b long")


def _hot_links(hot: DataFrame, group_limit: int) -> DataFrame:
    """Groups above the limit: sub-tries by further bits, and every pair of sub-tries within the budget as a task.

    The number of further bits follows the size of the group, so that an evenly filled sub-trie meets the limit.
    """
    def pairs(fp: int, block: int, depth: int) -> list[tuple[int, int]]:
        """Cells (smaller sub-trie, larger sub-trie) that a fingerprint takes part in."""
        turned = ((fp << (block * BLOCK_BITS)) | (fp >> (BITS - block * BLOCK_BITS))) & ((1 << BITS) - 1)
        own = (turned >> (BITS - BLOCK_BITS - depth)) & ((1 << depth) - 1)
        out = []
        for k in range(min(MAX_DIFF, depth) + 1):
            for flips in itertools.combinations(range(depth), k):
                other = own
                for f in flips:
                    other ^= 1 << f
                out.append((min(own, other), max(own, other)))
        return out

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for fp, block, value, n in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                depth = min(BITS - BLOCK_BITS - 1, max(1, int(np.ceil(np.log2(n / group_limit))) + 2))
                cells += [(fp, block, value, depth, x, y) for x, y in pairs(fp & (2**64 - 1), block, depth)]
            arrays = zip(*cells) if cells else ((),) * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(arrays, types)],
                names=["fp", "block", "value", "depth", "x", "y"],
            )

    def join(key, group):
        block, _, depth, x, y = (k.as_py() for k in key)
        a, b = cell_links(group.column("fp").to_numpy().view(np.uint64), block, depth, x, y)
        return pa.table([pa.array(v.view(np.int64)) for v in (a, b)], names=["a", "b"])

    cells = hot.select("fp", "block", "value", "n").mapInArrow(
        spread, "fp long, block int, value int, depth int, x long, y long"
    )
    return cells.groupBy("block", "value", "depth", "x", "y").applyInArrow(join, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for every node of the links; by alternating star contraction.

    Each round is written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges, before = stage(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = stage(small.filter("u != v").distinct(), "small")


def class_table(prints: DataFrame, fp: str, best: str, group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, int]:
    """``fp`` and ``best``: for each distinct fingerprint, the least ``best`` of its whole class; and its rows."""
    classes = stage(prints.groupBy(fp).agg(F.min(best).alias(best)), "classes")
    links = near_links(classes.select(fp), fp, group_limit)
    found = stage(components(links), "components")
    joined = classes.join(found, classes[fp] == found["node"], "left").select(
        classes[fp], best, F.coalesce("root", classes[fp]).alias("root")
    )
    # Only classes of several fingerprints need a second look.
    several = joined.groupBy("root").agg(F.min(best).alias("_least"))
    out = stage(joined.join(several, "root").select(fp, F.col("_least").alias(best)), "class_of")
    return out, out.count()


def near_duplicates(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id of every row.

    Fingerprints are linked at 3 or fewer differing bits; component_id is the smallest doc_id of the class (null if it
    has none but null ids). Texts without words, null ones included, have fingerprint zero and are linked like any
    other. Repeated rows come out as often as they went in. No rows: no rows.
    """
    prints = stage(with_fingerprint(docs, ["doc_id"], "fp"), "fingerprints")
    table, rows = class_table(prints.select("fp", F.col("doc_id").alias("component_id")), "fp", "component_id", group_limit)
    return prints.join(small_side(table, rows, ROW_BYTES), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (null ids last), of repeated rows the first.

    The rows are written once with their fingerprint and a number, so that one row can be told from its repeats.
    """
    names, docs = docs.columns, plain_names(docs)
    fp, row = free_name(docs, "_fp"), free_name(docs, "_row")
    marked = with_fingerprint(docs, docs.columns, fp).withColumn(row, F.monotonically_increasing_id())
    rows = stage(marked, "marked")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r"))
    prints = rows.select(F.col(fp).alias("fp"), first.alias("best"))
    table, n = class_table(prints, "fp", "best", group_limit)
    kept = table.select(F.col("best.r").alias(row)).distinct()
    return rows.join(small_side(kept, n, ROW_BYTES), row, "left_semi").select(*docs.columns).toDF(*names)


def op6_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``near_duplicates``."""
    out = near_duplicates(docs)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")
