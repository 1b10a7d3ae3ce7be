"""Packing along a space-filling curve.

Each document becomes a hashed vector of its tokens (signed counts in ``BUCKETS`` buckets, damped and of length one),
which fixed random directions project to a few dimensions. The cell of that point has a place on the Hilbert curve, so
documents whose keys are close use similar words. Rows are range-sorted by their key and laid end to end in this order;
neighbours on the curve share a sequence.

Only what the whole blocks of ``capacity`` tokens of a long document leave over is laid on the curve: a whole block is a
sequence already. The stretch is cut every ``capacity`` tokens, and its end into powers of two, which need no padding.
So every sequence is full or a power of two, and a document's remainder is cut only where a sequence ends.

Texts are tokenised once. The sort moves keys and remainders (less than ``capacity`` tokens a document), splits copies
of one text, however many, over tasks, and needs one row a task to place everything.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climspark.llm.common import crc32, sliced
from climspark.llm.packing import tokenizer_of, tokenizer_path
from climspark.sources.staging import stage

CAPACITY = 4096
END = 2
# The hashed vector, the dimensions it is projected to, and the bits of each: a key has 60 bits.
BUCKETS = 1024
DIMENSIONS = 4
BITS = 15
SEED = 12
# Rows and remainders' tokens of one task of the sort.
ROWS_PER_TASK = 1_000_000
TOKENS_PER_TASK = 8_000_000
# A fixed value: an odd multiplier that spreads ids over 64 bits (the golden ratio's fraction).
SPREAD = np.uint64(0x9E3779B97F4A7C15)

_HELD = "row long, key long, doc_tokens long, blocks array<long>, held binary"
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# --- the order


def slots(size: int) -> np.ndarray:
    """The slot of each id of a vocabulary: a bucket, or, for the other sign, a bucket and ``BUCKETS`` more."""
    spread = np.arange(size, dtype=np.uint64) * SPREAD
    bucket = spread >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return (bucket + np.uint64(BUCKETS) * ((spread >> np.uint64(20)) & np.uint64(1))).astype(np.int64)


def hashed_vectors(documents: Sequence[np.ndarray], slot_of: np.ndarray) -> np.ndarray:
    """One row a document: signed counts of its token ids in hashed buckets, square roots taken, of length one. A document
    without ids is the zero vector."""
    counts = np.zeros((len(documents), 2 * BUCKETS))
    for row, ids in zip(counts, documents):
        row[:] = np.bincount(slot_of[ids], minlength=2 * BUCKETS)
    signed = counts[:, :BUCKETS] - counts[:, BUCKETS:]
    damped = np.sign(signed) * np.sqrt(np.abs(signed))
    length = np.sqrt((damped**2).sum(axis=1, keepdims=True))
    return damped / np.where(length == 0, 1, length)


def directions(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, dimensions))


def cells(vectors: np.ndarray, onto: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The grid cell of each projected vector. A projection of a unit vector is a normal variable, and a logistic curve
    maps it to an even spread over the axis."""
    even = 1 / (1 + np.exp(-1.702 * (vectors @ onto)))
    return np.minimum((even * 2**bits).astype(np.int64), 2**bits - 1)


def hilbert_keys(cells_: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of coordinates (``bits`` bits each, 62 in all at most).

    From the coarsest cell down, the sub-cell's turn and mirror are undone on the finer bits; what is left is the Gray
    code of the place, one bit of every axis a level.
    """
    axes = [column.astype(np.int64) for column in cells_.T]
    for level in range(bits - 1, 0, -1):
        finer = (1 << level) - 1
        for k, axis in enumerate(axes):
            mirrored = (axis >> level & 1).astype(bool)
            turned = np.where(mirrored, 0, (axes[0] ^ axis) & finer)
            axes[0] = axes[0] ^ np.where(mirrored, finer, turned)
            if k:
                axes[k] = axis ^ turned
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    flips = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(axes[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | (axis ^ flips) >> level & 1
    return key


def _width(path: str, end: int) -> str:
    """The type that holds the vocabulary's ids while they are moved."""
    return "<u2" if max(end, tokenizer_of(path).size - 1) < 1 << 16 else "<u4"


def _held(docs: DataFrame, path: str, capacity: int, end: int, keep_ids: bool) -> DataFrame:
    """A row a document: its key, the checksums of its whole blocks, and the ids of its remainder (or all)."""
    width = _width(path, end)
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(_HELD).fields])
    step = 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encode, onto, last = tokenizer_of(path).encode, directions(), end.to_bytes(4, "little")
        slot_of = slots(tokenizer_of(path).size)
        for batch in sliced(batches):
            texts = [encode(text) for text in batch.column(2).to_pylist()]
            sizes = np.array([len(t) // 4 for t in texts], np.int64)
            vectors = hashed_vectors([np.frombuffer(t, "<u4") for t in texts], slot_of)
            keys = hilbert_keys(cells(vectors, onto))
            blocks, held = [], []
            for ids in texts:
                ids += last
                whole = len(ids) // step * step
                blocks.append([crc32(ids[at : at + step]) for at in range(0, whole, step)])
                held.append(np.frombuffer(ids if keep_ids else ids[whole:], "<u4").astype(width).tobytes())
            made = [keys, sizes + 1, blocks, held]
            arrays = [batch.column(0), batch.column(1)] + [pa.array(x, f.type) for x, f in zip(made, list(arrow)[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(run, schema)


# --- the cuts


@dataclass(frozen=True)
class Stretch:
    """``total`` tokens end to end, cut every ``capacity`` tokens and at the end into powers of two."""

    total: int
    capacity: int

    def edges(self) -> list[int]:
        """Where sequences begin after the last whole one, and the end of all."""
        at = self.total // self.capacity * self.capacity
        out = [at]
        rest = self.total - at
        while rest:
            power = 1 << rest.bit_length() - 1
            out.append(out[-1] + power)
            rest -= power
        return out

    def sequences(self) -> int:
        return self.total // self.capacity + len(self.edges()) - 1

    def cut(self, begin: int, size: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset in it, tokens) of each part of ``size`` tokens from ``begin`` on."""
        edges, whole, end = self.edges(), self.total // self.capacity, begin + size
        while begin < end:
            if begin < edges[0]:
                sequence = begin // self.capacity
                first, last = sequence * self.capacity, (sequence + 1) * self.capacity
            else:
                k = int(np.searchsorted(edges, begin, side="right")) - 1
                sequence, first, last = whole + k, edges[k], edges[k + 1]
            taken = min(end, last) - begin
            yield sequence, begin - first, taken
            begin += taken


def _laid(rows: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """``rows`` sorted along the curve, with the remainders' tokens and the whole blocks before each (columns before,
    blocks_before). Rows are written with their task and what stands before them in it; the tasks' sums follow."""
    sums = T.StructType.fromDDL("task int, in_task long, blocks_in_task long, tokens long, n_blocks long")
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tokens, blocks = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(names.index("doc_tokens")).to_numpy()
            left, whole = n % capacity, n // capacity
            before, blocks_before = tokens + np.cumsum(left) - left, blocks + np.cumsum(whole) - whole
            tokens, blocks = tokens + int(left.sum()), blocks + int(whole.sum())
            made = [np.full(len(n), task, "i4"), before, blocks_before, left, whole]
            arrays = [batch.column(i) for i in range(len(names))] + [pa.array(x) for x in made]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *sums.names])

    sorted_ = rows.repartitionByRange(tasks, "key", "row").sortWithinPartitions("key", "row")
    laid = stage(sorted_.mapInArrow(run, T.StructType([*rows.schema.fields, *sums.fields])), "curve")
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks_ = laid.groupBy("task").agg(F.sum("tokens").alias("t"), F.sum("n_blocks").alias("b"))
    offsets = tasks_.select(
        "task",
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"),
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b"),
    )
    placed = laid.join(F.broadcast(offsets), "task")  # one row a task
    return placed.select(
        *names, (F.col("t") + F.col("in_task")).alias("before"), (F.col("b") + F.col("blocks_in_task")).alias("blocks_before")
    )


def pack_along_curve(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    keep_ids: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every piece of every row of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset (and,
    if asked for, ids as an array).

    A document is its ids and the ``end`` id. A null or empty text is the end id alone, with the zero vector's key.
    Repeated rows are packed as often as they come, next to each other, null ids too. No rows: no rows. Sequences are
    numbered along the curve; those of the whole blocks of long documents come after, in the same order. A ``capacity``
    need not be a power of two.
    """
    path = path or tokenizer_path()
    width = _width(path, end)
    rows = stage(_held(docs, path, capacity, end, keep_ids), "documents")
    n, tokens = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("doc_tokens") % F.lit(capacity)), F.lit(0))
    ).first()
    tasks = max(1, -(-n // rows_per_task), -(-tokens // TOKENS_PER_TASK), min(64, n // 2_000))
    stretch = Stretch(tokens, capacity)
    ddl = _PIECE + (", ids array<long>" if keep_ids else "")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(ddl).fields])

    def pieces(doc_tokens: int, blocks: list, held: bytes, before: int, blocks_before: int) -> Iterator[tuple]:
        whole = doc_tokens // capacity * capacity
        held = np.frombuffer(held, width).astype("<u4").tobytes()
        held_from = doc_tokens - len(held) // 4  # the first id that is held
        for k, checksum in enumerate(blocks):
            ids = held[4 * k * capacity : 4 * (k + 1) * capacity] if keep_ids else b""
            yield k * capacity, capacity, checksum, doc_tokens, stretch.sequences() + blocks_before + k, 0, ids
        start = whole
        for sequence, offset, length in stretch.cut(before, doc_tokens - whole):
            ids = held[4 * (start - held_from) : 4 * (start + length - held_from)]
            yield start, length, crc32(ids), doc_tokens, sequence, offset, ids
            start += length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in sliced(batches):
            owner, out = [], []
            for i, values in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 6)))):
                for piece in pieces(*values):
                    owner.append(i)
                    out.append(piece)
            columns = list(zip(*out)) if out else [()] * 7
            arrays = [batch.column(0).take(pa.array(owner, pa.int64()))]
            arrays += [pa.array(c, f.type) for c, f in zip(columns[:6], list(arrow)[1:7])]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i8") for x in columns[6]], arrow[7].type))
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    laid = _laid(rows, capacity, tasks)
    return laid.select("doc_id", "doc_tokens", "blocks", "held", "before", "blocks_before").mapInArrow(run, schema)


def sequences_along_curve(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves, ``capacity`` tokens at most each, which bounds the groups."""
    packed = pack_along_curve(docs, path, capacity, end, keep_ids=True)
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def op12_curve_packing(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``pack_along_curve``."""
    return pack_along_curve(docs)
