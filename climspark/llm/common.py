"""Helpers the training-data operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of an Arrow batch that are turned into Python objects at once.
BATCH_ROWS = 1_000
# A side of a join is broadcast up to this many bytes, counted before.
BROADCAST_BYTES = 32 << 20

# Words of the contract: runs of digits, letters and everything beyond ASCII, with A-Z in lower case.
# Other ASCII bytes part words; UTF-8 puts no ASCII byte into a longer character.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def encoded(text: str | None) -> bytes:
    """UTF-8; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return encoded(text).translate(_ALNUM).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def map_batches(
    df: DataFrame,
    rows: Callable[[pa.RecordBatch], Sequence],
    added: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``carry`` columns of ``df``, then the columns ``added`` (a DDL string) that ``rows`` makes from each Arrow
    batch, one list or array a column. Rows keep their order and number."""
    new = T.StructType.fromDDL(added)
    schema = T.StructType([df.schema[c] for c in carry] + new.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in sliced(batches):
            kept = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            made = rows(batch)
            arrays = kept + [
                x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, list(arrow)[len(kept) :])
            ]
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow)], names=arrow.names
            )

    return df.mapInArrow(run, schema)


def plain_names(df: DataFrame, keep: Sequence[str] = ("doc_id", "text", "lang", "source")) -> DataFrame:
    """``df`` with other columns than ``keep`` named by their place, so that any name (with a dot, a blank or a backtick)
    can be selected; ``toDF(*df.columns)`` names them back."""
    return df.toDF(*[c if c in keep else f"_c{i}" for i, c in enumerate(df.columns)])


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], Sequence[bool]]) -> DataFrame:
    """The rows of ``df`` that ``keep`` marks, with all their columns."""
    plain = plain_names(df)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows surely fit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
