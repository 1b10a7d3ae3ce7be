"""Token counts at every prefix of a text, by dynamic programming over the last token.

A sequence of tokens is what byte-pair merging makes of its text exactly if each token is, and each two neighbours are,
what merging makes of their own text. So the last token of a prefix that ends at j is the one token t ending there that
fits the last token of the prefix before it, and count(j) = count(j - len(t)) + 1. Every prefix count of a word comes
from one pass, and no piece crosses the start of a run of spaces, so a text's counts are its words' counts added up.
Truncation and budget questions are then lookups.

Words recur, so each Python worker keeps the tables of the words it has seen, up to a bound.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climspark.llm.common import map_batches, sliced

LIMIT = 4096
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Tables kept in each Python worker, and the longest word kept; pairs of tokens kept.
CACHE_WORDS = 800_000
CACHE_CHARS = 48
CACHE_PAIRS = 500_000
# Characters of the texts whose words are looked up together.
GROUP_CHARS = 2_000_000
# Characters of one row of a stored table of prefix counts.
BLOCK = 4096


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """Exact token counts of all prefixes under a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self._score = {
            lib.id_to_piece(i): lib.get_score(i)
            for i in range(lib.vocab_size())
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))
        }
        self._pieces = ["", *self._score]
        self._number = {piece: n for n, piece in enumerate(self._pieces) if n}
        # The pieces as a trie from their ends: a node maps a character to (number of the piece that starts here or 0,
        # next node).
        self._ends: dict = {}
        for piece, number in self._number.items():
            node = self._ends
            for char in piece[:0:-1]:
                node = node.setdefault(char, [0, {}])[1]
            node.setdefault(piece[0], [0, {}])[0] = number
        # When a piece's merge has its turn; single characters are there from the start.
        self._turn = [0.0] + [-1.0 if len(p) == 1 else -self._score[p] for p in self._pieces[1:]]
        self._halves: dict[int, tuple[int, int] | None] = {}
        chars = set("".join(self._score))
        # Characters in no piece part words; pieces hold a space at their start or are all spaces.
        apart = "".join(c for c in "\n\t\r" if c not in chars)
        assert not any(SPACE in p.lstrip(SPACE) for p in self._score), "pieces with inner spaces are not supported"
        self._segment = re.compile(f"{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+" + (f"|[{apart}]" if apart else ""))
        assert chars <= set(self._score), "each character of a piece must be a piece"
        self._pairs: dict[int, bool] = {}
        self._tables: dict[str, Sequence[int]] = {}
        # Runs of spaces merge from the left; beyond the longest run that is a piece the pattern repeats.
        self._period = max(len(p) for p in self._score if not p.strip(SPACE))
        self._runs = [0] + [self._run(k) for k in range(1, self._period + 1)]

    def _run(self, k: int) -> int:
        # The library puts one space before a text.
        return len(self.library.encode(" " * (k - 1))) if k > 1 else 1

    def run(self, k: int) -> int:
        """Tokens of k spaces in a row."""
        return k // self._period * self._runs[self._period] + self._runs[k % self._period]

    def _derive(self, number: int) -> tuple[int, int] | None:
        """The two pieces that byte-pair merging joins last on the way to a piece; None if it does not get there.

        The best score merges first, of equal ones the leftmost."""
        if number not in self._halves:
            name, score = self._pieces[number], self._score
            parts, halves = list(name), (0, 0)
            while len(parts) > 1:
                joined = [score.get(x + y, -np.inf) for x, y in zip(parts, parts[1:])]
                at = max(range(len(joined)), key=joined.__getitem__)
                if joined[at] == -np.inf:
                    halves = None
                    break
                halves = (self._number[parts[at]], self._number[parts[at + 1]])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[number] = halves
        return self._halves[number]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging leaves two neighbours (or, after 0, a single piece) as they are.

        The merges that made the two are undone from the last one back. At each time the parts that meet at their
        border must not be a piece whose turn came before the merge that is undone; of equal turns, the left one comes
        first."""
        if len(self._pairs) > CACHE_PAIRS:
            self._pairs.clear()
        key, turn, names = left * len(self._pieces) + right, self._turn, self._pieces
        fits = self._derive(right) is not None
        before = np.inf
        while fits and left:
            joined = self._number.get(names[left] + names[right])
            if joined and turn[joined] < before:
                fits = False
            elif turn[left] > turn[right]:
                before, left = turn[left], self._derive(left)[1]
            elif turn[right] >= 0:
                before, right = turn[right] + 1, self._derive(right)[0]
            else:  # both are single characters
                break
        self._pairs[key] = fits
        return fits

    def _extend(self, word: str, counts: list[int], last: list[int]) -> None:
        """Adds the prefixes of a word beyond those the two lists hold: tokens, and the number of the last token (0
        where there is none, or bytes). A word has one leading space at most."""
        ends, pairs, many = self._ends, self._pairs, len(self._pieces)
        for j in range(len(counts), len(word) + 1):
            node, i = ends, j
            while i:
                i -= 1
                found = node.get(word[i])
                if found is None:
                    break
                number, node = found
                if number:
                    fits = pairs.get(last[i] * many + number)
                    if self._fits(last[i], number) if fits is None else fits:
                        counts.append(counts[i] + 1)
                        last.append(number)
                        break
            if len(counts) == j:  # no piece has the character: its bytes are tokens, and nothing joins them
                counts.append(counts[-1] + len(word[j - 1].encode("utf-8", "surrogatepass")))
                last.append(0)

    def _lone(self, word: str, last: list[int]) -> list[bool]:
        """Whether the first token of each prefix is a lone space, following the last tokens back."""
        space, lone = self._number[SPACE], [False] * len(last)
        for j in range(1, len(last)):
            i = j - (len(self._pieces[last[j]]) if last[j] else 1)
            lone[j] = last[j] == space if i == 0 else lone[i]
        return lone

    def _spaced(self, segment: str, word: str) -> list[int]:
        """Counts of all prefixes of a segment that starts with several spaces."""
        k = len(segment) - len(word)
        counts = [self.run(i) for i in range(1, k + 1)]
        if word:
            # Pieces of spaces score below all others, so the last space first joins the word if it can.
            own, last = [0], [0]
            self._extend(SPACE + word, own, last)
            alone = self._lone(SPACE + word, last)
            counts += [self.run(k) + c - 1 if a else self.run(k - 1) + c for c, a in zip(own[2:], alone[2:])]
        return counts

    def _tables_of(self, segments: Iterable[str]) -> Iterator[tuple[str, Sequence[int]]]:
        """Counts of all prefixes of each segment. In sorted order, a word goes on from the prefix that it shares with
        the one before."""
        before, counts, last = "", [0], [0]
        for segment in sorted(segments):
            if segment.startswith(SPACE * 2):
                found = self._spaced(segment, segment.lstrip(SPACE))
            else:
                shared, most = 0, min(len(before), len(segment))
                while shared < most and before[shared] == segment[shared]:
                    shared += 1
                del counts[shared + 1 :], last[shared + 1 :]
                self._extend(segment, counts, last)
                before, found = segment, counts[1:]
            yield segment, bytes(found) if max(found) < 256 else array("l", found)

    def all_tables(self, texts: Iterable[str | None]) -> Iterator[list[Sequence[int]]]:
        """For each text the prefix counts of its segments as the model sees it, one space before it included."""
        group, chars = [], 0
        for text in texts:
            group.append(self._segment.findall(SPACE + text.replace(" ", SPACE)) if text else [])
            chars += len(text or "")
            if chars > GROUP_CHARS:
                yield from self._looked_up(group)
                group, chars = [], 0
        yield from self._looked_up(group)

    def _looked_up(self, group: list[list[str]]) -> Iterator[list[Sequence[int]]]:
        cache = self._tables
        if len(cache) > CACHE_WORDS:
            cache.clear()
        long = {}
        for segment, table in self._tables_of(set().union(*group).difference(cache)):
            (cache if len(segment) <= CACHE_CHARS else long)[segment] = table
        for segments in group:
            yield [cache[s] if s in cache else long[s] for s in segments] if long else list(map(cache.__getitem__, segments))

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text."""
        return [sum([t[-1] for t in tables]) for tables in self.all_tables(texts)]

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to its length."""
        (tables,) = self.all_tables([text])
        if not tables:
            return np.zeros(1, dtype=np.int64)
        sizes = [len(t) for t in tables]
        totals = np.array([t[-1] for t in tables], dtype=np.int64)
        out = np.concatenate([np.frombuffer(t, np.uint8 if isinstance(t, bytes) else np.dtype("l")) for t in tables])
        out = out + np.repeat(np.cumsum(totals) - totals, sizes)
        out[0] = 0  # the place before the text: nothing is encoded as nothing
        return out

    def cut(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        return text[: int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])] if text else text


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row; null and empty texts have neither. Repeated rows repeat."""
    path = path or model_path()

    def rows(batch: pa.RecordBatch):
        return (_counter(path).counts(_texts(batch)),)

    sized = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sized = sized.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return map_batches(sized, rows, "n_tokens long", ["doc_id", "n_bytes"])


def prefix_table(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, block and counts: the tokens of text[:i] for the i of block * BLOCK and on, each row of bounded size."""
    path = path or model_path()
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("block long, counts array<long>").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in sliced(batches):
            rows, blocks, counts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                all_ = counter.prefix_counts(text)
                for k in range(0, len(all_), block):
                    rows.append(i)
                    blocks.append(k // block)
                    counts.append(all_[k : k + block])
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(blocks, pa.int64()), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "block", "counts"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def counts_at(table: DataFrame, questions: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, position and n_tokens of text[:position], read from a stored ``prefix_table``; no text is needed.

    Positions beyond the text have null.
    """
    asked = questions.select("doc_id", "position", F.floor(F.col("position") / block).alias("block"))
    found = asked.join(table, ["doc_id", "block"], "left")
    at = (F.col("position") - F.col("block") * block).cast("int")
    return found.select("doc_id", "position", F.get("counts", at).alias("n_tokens"))


def truncate(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens; null stays null."""
    path = path or model_path()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.toDF(*[names.get(c, c) for c in docs.columns])

    def rows(batch: pa.RecordBatch):
        counter = _counter(path)
        return ([None if t is None else counter.cut(t, budget) for t in _texts(batch)],)

    out = map_batches(renamed, rows, "cut string", [c for c in renamed.columns if c != "text"])
    return out.select(*[F.col("cut" if c == "text" else names[c]).alias(c) for c in docs.columns])


def op10_tokens(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``count_tokens``."""
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
