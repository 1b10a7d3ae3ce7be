"""Benchmark decontamination: one Aho-Corasick automaton over the words of all benchmark items.

Benchmark texts are cut into windows of 13 words (a shorter item is one window). Words get numbers and every window
becomes a path of the automaton, so that a document is read once, whatever the number of windows. Matches end at word
positions, and these are mapped back to character offsets of the original text.

Only the benchmark travels: its windows are counted first, and dealt into blocks of at most ``BLOCK_WINDOWS`` windows,
one automaton each. Almost always there is one block; with more, the documents pass block after block through tables
in the shared folder, so memory stays bounded for any benchmark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climspark.llm.common import alnum_words, map_batches
from climspark.sources.staging import stage

WINDOW = 13
# Windows of one automaton (up to 13 nodes each), and words of one piece of a long item.
BLOCK_WINDOWS = 100_000
PIECE_WORDS = 4_096

# Words in the original text, before A-Z are lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RESULT = "n_words long, hits array<int>, items array<string>"


def item_pieces(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` (string), ``words`` (joined by spaces) and ``n`` windows: items in pieces that overlap by 12 words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str, int]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum_words(text)
                for i in range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS):
                    part = words[i : i + PIECE_WORDS + WINDOW - 1]
                    if part:
                        out.append((item, b" ".join(part).decode(), max(1, len(part) - WINDOW + 1)))
            item, words, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int32())],
                names=["item", "words", "n"],
            )

    source = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "item string, words string, n int")


class Automaton:
    """Windows of items as paths over word numbers; a value is (words of the window, its items)."""

    def __init__(self, pieces: Sequence[tuple[str | None, str]]):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str | None]] = {}
        for item, words in pieces:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words.encode().split()]
            for i in range(max(1, len(ids) - WINDOW + 1)):
                windows.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows.items():
            self.tree.add_word(window, (len(window), items))
        self.tree.make_automaton()
        self.empty = not windows

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Ranges of hit words, in order and merged, and the items found."""
        if self.empty or not words:
            return [], set()
        number = self.vocabulary.get
        ranges: list[tuple[int, int]] = []
        found: set[str | None] = set()
        for last, (n, items) in self.tree.iter(tuple([number(w, 0) for w in words])):
            ranges.append((last - n + 1, last + 1))
            found |= items
        return merged(ranges), found


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


@dataclass(frozen=True)
class Block:
    key: str
    shipped: Broadcast


_built: dict[str, Automaton] = {}


def _automaton(block: Block) -> Automaton:
    """The automaton of a block, built once in each Python worker."""
    if block.key not in _built:
        _built.clear()
        _built[block.key] = Automaton(block.shipped.value)
    return _built[block.key]


def blocks(benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The pieces of the benchmark in broadcast blocks of about ``block_windows`` windows."""
    spark = benchmark.sparkSession
    pieces = stage(item_pieces(benchmark).distinct(), "benchmark")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // block_windows))
    for i in range(n):
        mine = pieces.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == i) if n > 1 else pieces
        rows = [(r.item, r.words) for r in mine.collect()]
        yield Block(uuid.uuid4().hex, spark.sparkContext.broadcast(rows))


def scan(
    docs: DataFrame, benchmark: DataFrame, carry: Sequence[str] = ("doc_id",), block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``carry`` columns of ``docs``, then n_words, hits (starts and ends of hit word ranges, flat) and items.

    One row for each row of ``docs``, repeated ones too. A null or empty text has no words and no hits. An item without
    words hits nothing; one whose id is null makes hits and is not listed; repeated items count once. Columns in
    ``carry`` must not be named like the three results.
    """
    frame, state = docs, False
    own = [c for c in dict.fromkeys([*carry, "text"])]
    todo = list(blocks(benchmark, block_windows))
    for k, block in enumerate(todo):

        def rows(batch: pa.RecordBatch, block=block, state=state):
            automaton = _automaton(block)
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            n_words, hits, items = [], [], []
            for i, text in enumerate(texts):
                words = alnum_words(text)
                ranges, found = automaton.scan(words)
                found = {x for x in found if x is not None}
                if state:
                    had = batch.column(batch.schema.get_field_index("hits"))[i].as_py()
                    ranges = merged([*ranges, *zip(had[::2], had[1::2])])
                    found |= set(batch.column(batch.schema.get_field_index("items"))[i].as_py())
                n_words.append(len(words))
                hits.append([x for r in ranges for x in r])
                items.append(sorted(found))
            return n_words, hits, items

        last = k == len(todo) - 1
        source = frame.select(*own, *(["hits", "items"] if state else []))
        frame = map_batches(source, rows, _RESULT, list(carry) if last else own)
        if not last:
            frame = stage(frame, "scanned")
        state = True
    return frame


def n_hit(hits: str = "hits") -> Column:
    """Hit words: the lengths of the ranges."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(2)),
        F.lit(0).cast("long"),
        lambda sum_, i: sum_ + F.coalesce(F.get(F.col(hits), i) - F.get(F.col(hits), i - 1), F.lit(0)),
    )


def is_contaminated(n_hit_: Column, n_words: Column) -> Column:
    """At least one word hit, and at least a twentieth of all words."""
    return (n_hit_ > 0) & (20 * n_hit_ >= n_words)


def original_spans(text: str | None, hits: Sequence[int]) -> list[tuple[int, int]]:
    """Character offsets in the original text of hit word ranges."""
    places = [m.span() for m in _WORD.finditer(text or "")]
    return [(places[lo][0], places[hi - 1][1]) for lo, hi in zip(hits[::2], hits[1::2])]


def hit_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, start and end (characters of the original text) of every merged passage taken from the benchmark."""
    found = scan(docs, benchmark, carry=("doc_id", "text")).filter(F.size("hits") > 0)

    def rows(batch: pa.RecordBatch):
        text, hits = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "hits"))
        return ([[{"start": a, "end": b} for a, b in original_spans(t, h)] for t, h in zip(text, hits)],)

    spans = map_batches(found, rows, "spans array<struct<start:int,end:int>>", ["doc_id"])
    return spans.select("doc_id", F.inline("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.toDF(*[names.get(c, c) for c in docs.columns])
    judged = scan(renamed, benchmark, carry=renamed.columns)
    clean = judged.filter(~is_contaminated(n_hit(), F.col("n_words")))
    return clean.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def op3_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of ``scan``."""
    found = scan(docs, benchmark).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
