"""Best-fit packing by minimum bin slack.

Only lengths matter to the packing, and there are at most ``capacity`` of them, so the counts per length are all that
reaches the driver, for any number of documents. For each bin the largest length left is taken, and a bitset of
reachable sums (a dynamic programme over the lengths left, as often as they are left) finds the fullest combination
that fits beside it. That combination is used as often as its lengths last, then the next one is sought, so the plan
has a few thousand patterns at most.

Pieces get a rank within their length by range partitioning (so one length that holds a third of all pieces is split
over tasks), and the plan turns ranks into sequences and offsets. Texts are tokenised once; only keys are moved.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climspark.llm.common import crc32, sliced
from climspark.llm.sharding import positions
from climspark.sources.staging import stage

CAPACITY = 2048
END = 0
ROWS_PER_TASK = 1_000_000
TOKENIZER = "word_bpe_49k.json"
# Words and parts of words in each of the two generations that a Python worker keeps with their ids, and the longest
# word kept.
CACHE_WORDS = 400_000
CACHE_CHARS = 48

_PIECE = "piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent(dict):
    """What ``make`` gives for a key, kept for the keys used of late.

    When ``most`` are held they become the older generation, and the one before it goes; a key found there moves up.
    So hot keys stay, and at most twice ``most`` are held. ``longest`` keys are kept, longer ones made each time.
    """

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int):
        super().__init__()
        self._make, self._most, self._longest, self._older = make, most, longest, {}

    def __missing__(self, key: str) -> bytes:
        made = self._older.get(key)
        if made is None:
            made = self._make(key)
        if len(key) <= self._longest:
            if len(self) >= self._most:
                self._older = dict(self)
                self.clear()
            self[key] = made
        return made


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers, by the library's vocabulary.

    White space parts what the vocabulary can join, so ids are looked up word by word. Words of ASCII and Latin-1
    letters go part by part to the library's merge model; any other word, and any text with separators that the
    languages class differently, is encoded by the library itself.
    """

    _PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    _UNSURE = "\x1c\x1d\x1e\x1f"
    # The vocabulary's own pattern, for plain words in lower case. Most words are letters, or letters and one sign.
    _PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self.size = self._library.get_vocab_size()
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        self._letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._words = Recent(self._word, most or CACHE_WORDS, CACHE_CHARS)

    def _exact(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join([self._letters[b] for b in part.encode()])
        ids = array("I", [t.id for t in self._model.tokenize(part)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        """A word's ids; those of a part are the ids of a word that is that part."""
        if word.isascii():
            if word.isalpha():
                return self._part(word) if word.islower() else self._words[word.lower()]
            if word[:-1].isalpha() and word[-1].isprintable():
                return self._words[word[:-1].lower()] + self._words[word[-1]]
        if not self._PLAIN.fullmatch(word) or "<|" in word:
            return self._exact(word)
        parts = self._PARTS.findall(word.lower())
        return self._part(parts[0]) if len(parts) == 1 else b"".join(map(self._words.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(sign in text for sign in self._UNSURE):
            return self._exact(text)
        return b"".join(map(self._words.__getitem__, text.split()))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenized_pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and, if asked for, ids as an array) of every piece.

    A document is its ids and the end id; only documents longer than ``capacity`` are cut. A null or empty text is
    one piece that holds the end id.
    """
    path = path or tokenizer_path()
    ddl = _PIECE + (", ids array<long>" if keep_ids else "")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(ddl).fields])
    step = 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encode = tokenizer_of(path).encode
        for batch in sliced(batches):
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text) + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    out.append((k, at // 4, len(part) // 4, crc32(part), part))
            columns = list(zip(*out)) if out else [()] * 5
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, f.type) for c, f in zip(columns[:4], list(arrow)[1:5])]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype("i8") for p in columns[4]], arrow[5].type))
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


# --- the plan, over counts of lengths


def fullest(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """Lengths (and how often) whose sum is the largest that ``room`` holds; larger lengths are preferred."""
    reach, full = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, times, sums reachable before
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            times *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to times) and how many bins each fills, by minimum bin slack."""
    left = {length: n for length, n in counts.items() if n}
    out = []
    while left:
        largest = max(left)
        left[largest] -= 1
        rest = {x: n for x, n in left.items() if n}
        pattern = fullest(rest, capacity - largest)
        left[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        bins = min(left[x] // times for x, times in pattern.items())
        out.append((pattern, bins))
        for x, times in pattern.items():
            left[x] -= bins * times
            if not left[x]:
                del left[x]
    return out


@dataclass(frozen=True)
class Layout:
    """Stretches of pieces in the order of (length, any): where each starts, and how it fills bins."""

    first: np.ndarray
    length: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.first, place, side="right") - 1
        within = place - self.first[k]
        return self.sequence[k] + within // self.times[k], self.offset[k] + within % self.times[k] * self.length[k]


def layout(counts: Mapping[int, int], capacity: int = CAPACITY) -> Layout:
    next_place, start = {}, 0
    for length in sorted(counts):
        next_place[length] = start
        start += counts[length]
    rows, sequence = [], 0
    for pattern, bins in plan(counts, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            times = pattern[length]
            rows.append((next_place[length], length, times, sequence, offset))
            next_place[length] += bins * times
            offset += length * times
        sequence += bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Layout(*table.T)


def assign(pieces: DataFrame, capacity: int = CAPACITY, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``pieces`` (with a column length) and each one's sequence_id and offset. Columns named _row or _place must not
    be among theirs."""
    rows = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    tasks = max(1, -(-total // rows_per_task), min(64, total // 2_000))
    placed = positions(rows, ["length", "_row"], "_place", tasks)
    shipped = rows.sparkSession.sparkContext.broadcast(layout(counts, capacity))
    schema = T.StructType([*pieces.schema.fields, *T.StructType.fromDDL("sequence_id long, offset long").fields])
    names = pieces.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shipped.value.at(batch.column(len(names)).to_numpy())
            arrays = [batch.column(i) for i in range(len(names))] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return placed.select(*names, "_place").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every row of ``docs`` with its place in a sequence of at most ``capacity`` tokens.

    Repeated rows are packed as often as they come, null ids too. No rows: no rows.
    """
    return assign(tokenized_pieces(docs, path, capacity), capacity)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves. A sequence holds ``capacity`` tokens at most, which
    bounds each group."""
    packed = assign(tokenized_pieces(docs, path, capacity, keep_ids=True), capacity)
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def op5_packing(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``pack``."""
    return pack(docs)
