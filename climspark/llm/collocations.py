"""Collocations of each language by Toivonen mining of frequent phrases.

A phrase is a run of 1 to 4 words within a piece of text. A phrase is at most as frequent as its parts, so:

* A sample of the documents, mined length by length at a lowered threshold, proposes frequent phrases.
* A full pass counts the proposed phrases and their negative border: phrases whose first words and whose last words (all
  but one) are proposed. Every single word is counted.
* Phrases of the border that turn out frequent are failures: phrases above them were not counted. Further passes count
  just those, until a pass finds no failure. Then the frequent phrases are closed, and nothing that is missing can be
  frequent. A poor sample costs passes (as many as a phrase has words, at most), never results.
* The words of nearly all of them are found in the sample; a last pass over all documents finds the rest.

Passes know phrases by 62-bit keys, and tasks send them as packed arrays, a row for each range of keys, which numpy sums:
most phrases of a border are rare, and a row for each would cost ten times as much. Keys that two phrases are seen to
share are counted again in the last pass, which tells phrases apart by 64 bits more. Unseen, a rare phrase shares the key
of a frequent one with a chance of 2 ** -62 a pair: 10 ** -5 for a corpus of 10 ** 8 phrases, 10 ** 5 of them frequent.
Known phrases reach the tasks as a Bloom filter of bounded size. What it lets through by mistake is counted too, so its
errors cost time only.

Every task sums its own phrases before it sends them, so a language, or a phrase, that holds a third of all words is
spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climspark.llm.common import encoded, small_side, text_or_empty
from climspark.sources.staging import stage

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
# Fixed values of the report: the score's scale, and the share (in hundredths) of a phrase's places that a longer one
# must hold to replace it.
SCALE = 2_000_000
REPLACED = 80
UNKNOWN = "und"

# One document in so many is in the sample; there, a phrase is proposed from this part of its fair share of MIN_COUNT on.
SAMPLE = 8
LOWERED = 0.8
# Bits of the filter a phrase, and the least and most bits in all (16 MB). Beyond that, more passes by mistake.
BITS_A_PHRASE = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27
CHUNK_BITS = 1 << 16
# Characters of text that become words at once, phrases that a task holds before it sends them (in the last pass, a
# quarter of that), and characters of the corpus for each range of keys.
STRETCH_CHARS = 3_000_000
PHRASES_HELD = 2_000_000
CHARS_A_RANGE = 8_000_000
MAX_RANGES = 1 << 16
# Bytes a row of frequent phrases is reckoned at, and shares a language's candidates are ranked in first.
PHRASE_BYTES = 128
SHARES = 64

# Signs that part pieces become a full stop, which no word holds; A-Z become lower case, tabs spaces.
_BREAK = ord(".")
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else _BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)
)
# Odd multipliers of the hash that joins words to phrases.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# --- phrases of a stretch of text


def _keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """Keys of phrases of ``n`` words: hashes, mixed, with the length in the lowest two bits."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * _MIX[1]
    return (hashes ^ (hashes >> np.uint64(29))) & ~np.uint64(3) | np.uint64(n - 1)


def length_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(3)).astype(np.int64) + 1


def word_keys(lang: str, words: list[bytes], salt: int = 0) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(encoded(lang), salt)
    return _keys(np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64), 1)


def extended(prefixes: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Keys of phrases of ``n`` words: the given prefixes and one word more."""
    return _keys(prefixes * _MIX[0] + words * _MIX[2] + np.uint64(1), n)


@dataclass(frozen=True)
class Bloom:
    """A set of hashes; two bits each. It may hold more than was put in, never less."""

    bits: np.ndarray  # one byte for eight

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in places(hashes, len(self.bits) * 8):
            found &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash, of a number of ``bits`` that is a power of two."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) * _MIX[0] >> np.uint64(20) & mask


def words_of(texts: Iterable[str | None]) -> list[bytes]:
    """The words of all texts; a full stop stands between pieces and between texts."""
    return b" . ".join([encoded(t).translate(_BYTES).replace(b".", b" . ") for t in texts]).split()


@dataclass(frozen=True)
class Phrases:
    """Phrases of ``n`` words that a pass reaches in a stretch of text, an entry for each place (of single words, for each
    word, with counts)."""

    n: int
    keys: np.ndarray
    checks: np.ndarray | None  # 64 bits more, if asked for
    starts: np.ndarray
    counts: np.ndarray | None
    fresh: np.ndarray  # not counted by an earlier pass
    ids: np.ndarray
    vocabulary: pa.Array

    def texts(self, starts: np.ndarray) -> pa.Array:
        words = [self.vocabulary.take(pa.array(self.ids[starts + k])) for k in range(self.n)]
        return pc.binary_join_element_wise(*words, " ")


def reached(
    lang: str, words: list[bytes], longest: int, known: Bloom | None, counted: tuple[Bloom, ...], checked: bool = False
) -> Iterator[Phrases]:
    """All words, then, length by length, the phrases whose first and last n - 1 words are reached and ``known``. The
    passes of ``counted`` have counted those that they reached in the same way."""
    if not words:
        return
    coded = pa.array(words, pa.binary()).dictionary_encode()
    vocabulary, ids = coded.dictionary, coded.indices.to_numpy()
    listed = vocabulary.to_pylist()
    salts = (0, 1) if checked else (0,)
    of_word = [word_keys(lang, listed, salt) for salt in salts]
    real = np.array([w != b"." for w in listed])
    vocabulary = vocabulary.cast(pa.string())
    first = np.zeros(len(listed), np.int64)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    each, counts = np.flatnonzero(real), np.bincount(ids, minlength=len(listed))
    yield Phrases(
        1, of_word[0][each], of_word[1][each] if checked else None, first[each], counts[each],
        np.full(len(each), not counted), ids, vocabulary,
    )
    if known is None:
        return
    filters = (known, *counted)
    # For each phrase of n words in the text: where it begins, its key (and check), and for each filter whether its pass
    # reached the phrase and could go on from it.
    starts = np.flatnonzero(real[ids])
    here = ids[starts]
    keys = [of[here] for of in of_word]
    open_ = [f.has(of_word[0])[here] for f in filters]
    for n in range(2, longest + 1):
        follows = np.diff(starts, append=-1) == 1
        both = [o & np.append(o[1:], False) & follows for o in open_]
        here = np.flatnonzero(both[0])
        reach = [b[here] for b in both]
        starts = starts[here]
        last = ids[starts + n - 1]
        keys = [extended(k[here], of[last], n) for k, of in zip(keys, of_word)]
        fresh = ~np.logical_or.reduce([np.zeros(len(here), bool), *reach[1:]])
        yield Phrases(n, keys[0], keys[1] if checked else None, starts, None, fresh, ids, vocabulary)
        if n < longest:
            open_ = [r & f.has(keys[0]) for f, r in zip(filters, reach)]


def _stretches(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[str, list[bytes]]]:
    """The words of each language, a stretch of texts at a time. Columns are lang and text."""
    held: dict[str, list[str]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            held.setdefault(lang.as_py(), []).append(text)
            size += len(text)
            if size >= chars:
                for one, texts in held.items():
                    yield one, words_of(texts)
                held, size = {}, 0
    for one, texts in held.items():
        yield one, words_of(texts)


# --- passes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(keys) else counts


def _range_ends(keys: np.ndarray, ranges: int) -> tuple[list[int], list[int], list[int]]:
    """The ranges that ascending ``keys`` are in, and where each begins and ends."""
    number = (keys >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64) if ranges > 1 else np.zeros(len(keys), int)
    found, begins = np.unique(number, return_index=True)
    return found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)]


def _survivors(
    docs: DataFrame, lengths: range, known: Bloom | None, counted: tuple[Bloom, ...], least: int, ranges: int
) -> DataFrame:
    """Rows of keys that occur ``least`` times, and their counts (packed), of the phrases that this pass is for."""
    shipped = docs.sparkSession.sparkContext.broadcast((known, counted))

    def send(places: list[np.ndarray], words: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *places]), return_counts=True)
        if words:
            pairs = [(keys, counts), *words]
            keys, counts = summed(np.concatenate([k for k, _ in pairs]), np.concatenate([c for _, c in pairs]))
        rows = []
        for k, begin, end in zip(*_range_ends(keys, ranges)):
            some, times = keys[begin:end], counts[begin:end]
            once = times == 1  # most phrases; their counts are not sent
            rows.append((k, some[once].tobytes(), some[~once].tobytes(), times[~once].astype("<i8").tobytes()))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = zip(*rows) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["range", *_PACKED])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted = shipped.value
        places, words, size = [], [], 0
        for lang, text in _stretches(batches, STRETCH_CHARS):
            for p in reached(lang, text, lengths.stop - 1, known, counted):
                if p.n not in lengths or not p.fresh.any():
                    continue
                if p.n == 1:
                    words.append((p.keys, p.counts))
                else:
                    places.append(p.keys[p.fresh])
                size += int(p.fresh.sum())
            if size >= PHRASES_HELD:
                yield send(places, words)
                places, words, size = [], [], 0
        if size:
            yield send(places, words)

    def keep(table: pa.Table) -> pa.Table:
        once, many, times = (b"".join(table.column(c).to_pylist()) for c in _PACKED)
        once, many, times = np.frombuffer(once, "<u8"), np.frombuffer(many, "<u8"), np.frombuffer(times, "<i8")
        keys, counts = summed(np.concatenate([once, many]), np.concatenate([np.ones(len(once), np.int64), times]))
        kept = counts >= least
        columns = [keys[kept].tobytes(), counts[kept].astype("<i8").tobytes(), int(kept.sum())]
        return pa.table(dict(zip(["keys", "counts", "held"], ([c] for c in columns))))

    sent = docs.select("lang", "text").mapInArrow(run, "range int, once binary, many binary, times binary")
    return stage(sent.groupBy("range").applyInArrow(keep, "keys binary, counts binary, held long"), "phrases")


_PACKED = ["once", "many", "times"]


def bloom_of(packed: DataFrame, shorter_than: int) -> Bloom:
    """The filter of the packed keys of phrases of fewer words. Tasks set its bits; the driver joins chunks of fixed size."""
    n = packed.agg(F.sum("held")).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (max(1, n) * BITS_A_PHRASE - 1).bit_length()))

    def bit_places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed_keys in batch.column(0).to_pylist():
                keys = np.frombuffer(packed_keys, "<u8")
                at = np.unique(np.concatenate(places(keys[length_of(keys) < shorter_than], bits))).astype(np.int64)
                numbers, begins = np.unique(at // CHUNK_BITS, return_index=True)
                parts = [p.astype("<u4").tobytes() for p in np.split(at % CHUNK_BITS, begins[1:])][: len(numbers)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers.astype("i4")), pa.array(parts, pa.binary())], names=["chunk", "places"]
                )

    def chunk(table: pa.Table) -> pa.Table:
        held = np.zeros(CHUNK_BITS, bool)
        for part in table.column("places").to_pylist():
            held[np.frombuffer(part, "<u4")] = True
        bitmap = np.packbits(held, bitorder="little").tobytes()
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([bitmap], pa.binary())})

    at = packed.select("keys").mapInArrow(bit_places, "chunk int, places binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in at.groupBy("chunk").applyInArrow(chunk, "chunk int, bits binary").collect():
        out[r.chunk * CHUNK_BITS // 8 : (r.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return Bloom(out)


def _failures(packed: DataFrame, known: Bloom, longest: int) -> bool:
    """Whether some key of a phrase that could be extended is unknown."""
    shipped = packed.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
            missed = int((~shipped.value.has(keys[length_of(keys) < longest])).sum())
            yield pa.RecordBatch.from_pydict({"missed": pa.array([missed], pa.int64())})

    return bool(packed.select("keys").mapInArrow(run, "missed long").agg(F.sum("missed")).first()[0])


def _rows(packed: DataFrame) -> DataFrame:
    """(key, f), a row a phrase."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({"key": np.frombuffer(keys, "<i8"), "f": np.frombuffer(counts, "<i8")})

    return packed.select("keys", "counts").mapInArrow(run, "key long, f long")


def _packed(rows: DataFrame) -> DataFrame:
    """(keys, held) of a table with a column key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().astype("<i8").tobytes()
            yield pa.RecordBatch.from_pydict({"keys": pa.array([keys], pa.binary()), "held": pa.array([batch.num_rows], pa.int64())})

    return rows.select("key").mapInArrow(run, "keys binary, held long")


def _named(docs: DataFrame, known: Bloom, wanted: Bloom, longest: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, key, f) of the phrases that are ``wanted`` among those reached through ``known``, and (lang,
    words).

    Key and check tell phrases apart. A task sends counts for them, and the words of each once."""
    shipped = docs.sparkSession.sparkContext.broadcast((known, wanted))
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())]

    def send(lang: str, words: int, counts: list[np.ndarray], named: list[np.ndarray], texts: list) -> pa.RecordBatch:
        rows = {-1: [lang, words, None, None, None]}
        for place, parts in ((2, counts), (3, named)):
            table = np.concatenate([np.zeros((0, 3), np.uint64), *parts])
            order = np.argsort(table[:, 0])
            table = table[order]
            phrases = pa.chunked_array(texts, pa.string()).take(pa.array(order)) if place == 3 else None
            for k, begin, end in zip(*_range_ends(table[:, 0], ranges)):
                row = rows.setdefault(k, [lang, 0, b"", b"", []])
                row[place] = table[begin:end].tobytes()
                if phrases is not None:
                    row[4] = phrases.slice(begin, end - begin).to_pylist()
        columns = zip(*([k, *row] for k, row in rows.items()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["range", *_NAMED])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shipped.value
        found: dict[str, tuple[list, list, list]] = {}
        totals: dict[str, int] = {}
        seen, size = np.zeros(0, np.uint64), 0
        for lang, text in _stretches(batches, STRETCH_CHARS):
            counts, named, texts = found.setdefault(lang, ([], [], []))
            totals.setdefault(lang, 0)
            for p in reached(lang, text, longest, known, (), checked=True):
                if p.n == 1:
                    totals[lang] += int(p.counts.sum())
                chosen = np.flatnonzero(wanted.has(p.keys))
                chosen = chosen[np.argsort(p.keys[chosen])]
                if not len(chosen):
                    continue
                keys, checks = p.keys[chosen], p.checks[chosen]
                begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])))
                times = np.add.reduceat(p.counts[chosen], begins) if p.n == 1 else np.diff(begins, append=len(keys))
                table = np.column_stack([keys[begins], checks[begins], times.astype(np.uint64)])
                counts.append(table)
                size += len(table)
                both = table[:, 0] * _MIX[0] ^ table[:, 1]
                at = np.searchsorted(seen, both)
                new = np.flatnonzero(np.append(seen, np.uint64(0))[at] != both) if len(seen) else np.arange(len(both))
                if len(new):
                    named.append(table[new])
                    texts.append(p.texts(p.starts[chosen[begins[new]]]))
                    fresh = np.unique(both[new])
                    seen = np.insert(seen, np.searchsorted(seen, fresh), fresh)
            if size >= PHRASES_HELD // 4:
                yield from (send(one, totals.pop(one), *held) for one, held in found.items())
                found, seen, size = {}, seen[:0], 0
        yield from (send(one, totals[one], *held) for one, held in found.items())

    def add(table: pa.Table) -> pa.Table:
        import pandas as pd

        counts, named = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), "<u8").reshape(-1, 3) for c in ("packed", "named")
        )
        sums = pd.DataFrame({"key": counts[:, 0], "check": counts[:, 1], "f": counts[:, 2].astype("i8")})
        sums = sums.groupby(["key", "check"], as_index=False)["f"].sum()
        texts = pd.DataFrame({"key": named[:, 0], "check": named[:, 1], "phrase": table.column("phrases").combine_chunks().flatten()})
        kept = sums.merge(texts.drop_duplicates(["key", "check"]), on=["key", "check"])
        n = (kept["key"].to_numpy() & np.uint64(3)).astype("i4") + 1
        lang = pa.repeat(table.column("lang")[0], len(kept))
        phrases = pa.array(kept["phrase"].tolist(), pa.string())
        keys = kept["key"].to_numpy().view("i8")
        return pa.table({"lang": lang, "n": pa.array(n, pa.int32()), "phrase": phrases, "key": keys, "f": kept["f"].to_numpy()})

    ddl = "range int, lang string, words long, packed binary, named binary, phrases array<string>"
    sent = stage(docs.select("lang", "text").mapInArrow(run, ddl), "sent")
    totals = sent.filter(F.col("range") == -1).groupBy("lang").agg(F.sum("words").alias("words"))
    counted = sent.filter(F.col("range") >= 0).groupBy("range", "lang")
    return stage(counted.applyInArrow(add, "lang string, n int, phrase string, key long, f long"), "named"), totals


_NAMED = ["lang", "words", "packed", "named", "phrases"]


def frequent_phrases(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    one_in: int = SAMPLE,
    lowered: float = LOWERED,
) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of every phrase of up to ``longest`` words that occurs ``min_count`` times in its language,
    and (lang, words) of every language. ``docs`` has the columns lang and text, without nulls, and pick, a hash by which
    the sample is drawn.

    Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``; A-Z are lower-cased.
    """
    fair = max(2, round(min_count / one_in * lowered))
    sample = stage(docs.filter(F.pmod("pick", F.lit(one_in)) == 0).select("lang", "text"), "sample")
    chars = (sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * one_in
    ranges = min(MAX_RANGES, 1 << (max(1, chars // CHARS_A_RANGE) - 1).bit_length())
    found, known = [], None
    for n in range(1, longest):
        found.append(_survivors(sample, range(n, n + 1), known, (), fair, ranges))
        known = bloom_of(reduce(DataFrame.unionByName, found), longest)

    # The pass over all documents counts what was proposed and its negative border.
    counted: tuple[Bloom, ...] = ()
    frequent = newest = _survivors(docs, range(1, longest + 1), known, counted, min_count, ranges)
    while _failures(newest, known, longest):
        # Frequent phrases that could be extended were not known, so phrases above them were passed by.
        counted = (*counted, known)
        known = bloom_of(frequent, longest)
        newest = _survivors(docs, range(2, longest + 1), known, counted, min_count, ranges)
        frequent = frequent.unionByName(newest)
    every = bloom_of(frequent, longest + 1)
    counts = stage(_rows(frequent), "counts")
    # Words from the sample, for keys that one phrase there has; the others are counted by their words.
    seen, _ = _named(sample, every, every, longest, ranges)
    alone = seen.groupBy("key").agg(F.count(F.lit(1)).alias("phrases")).filter(F.col("phrases") == 1)
    seen = seen.drop("f").join(alone.select("key"), "key", "left_semi").join(counts, "key")
    seen = stage(seen.select("lang", "n", "phrase", "f", "key"), "seen")
    rest = bloom_of(stage(_packed(counts.join(seen, "key", "left_anti")), "rest"), longest + 1)
    found, totals = _named(docs, every, rest, longest, ranges)
    found = found.filter(F.col("f") >= min_count).join(seen, "key", "left_anti")
    columns = ["lang", "n", "phrase", "f"]
    return stage(seen.select(*columns).unionByName(found.select(*columns)), "phrases"), totals


# --- the report


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, n_words, phrase, a, l, r, n, score) of every candidate, with the cut of the lowest score.

    Numbers are joined exactly: products are decimals, the quotient is that of whole numbers.
    """
    parts = small_side(counts.select("lang", F.col("phrase").alias("part"), "f"), counts.count(), PHRASE_BYTES)
    at = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")
    cuts = counts.filter(F.col("n") >= 2).select("lang", "phrase", "n", F.col("f").alias("a"), at)
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring_index(phrase, ' ', k - n)"))
    firsts, rests = (parts.withColumnsRenamed({"part": p, "f": f}) for p, f in (("first", "l"), ("rest", "r")))
    cuts = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    exact = F.expr(f"(cast({SCALE} as decimal(10, 0)) * cast(a as decimal(19, 0))) div cast(l + r as decimal(20, 0))")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "n", "a", "l", "r")).alias("b")
    )
    best = best.select("lang", "phrase", F.col("b.n").alias("n_words"), "b.a", "b.l", "b.r", "b.score")
    totals = totals.withColumnRenamed("words", "n")
    return best.join(small_side(totals, totals.count(), PHRASE_BYTES), "lang")


def maximal(candidates: DataFrame, counts: DataFrame, replaced: int = REPLACED) -> DataFrame:
    """The candidates that no longer candidate holds in ``replaced`` of a hundred of their places."""
    inner = [
        F.expr(f"substring_index(substring_index(phrase, ' ', {begin + size}), ' ', -{size})")
        for size in range(2, LONGEST)
        for begin in range(0, LONGEST - size + 1)
    ]
    inside = F.filter(F.array_distinct(F.array(*inner)), lambda p: p != F.col("phrase"))
    longer = counts.filter(F.col("n") > 2).select("lang", "f", F.explode(inside).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = candidates.join(held, ["lang", "phrase"], "left")
    hundred = F.lit(100).cast("decimal(3, 0)")
    over = hundred * F.col("held").cast("decimal(19, 0)") >= F.lit(replaced).cast("decimal(3, 0)") * F.col("a").cast("decimal(19, 0)")
    return kept.filter(~F.coalesce(over, F.lit(False))).drop("held")


def mine_collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, one_in: int = SAMPLE, lowered: float = LOWERED
) -> DataFrame:
    """Each language's ``top`` collocations: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is ``und``, and is counted with documents that say so. Repeated rows count as
    often as they come. Ties in score and count go to the smaller phrase, by its bytes. No phrases: no rows.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        text_or_empty().alias("text"),
        F.xxhash64("doc_id", "text").alias("pick"),
    )
    counts, totals = frequent_phrases(rows, min_count, LONGEST, one_in, lowered)
    kept = stage(maximal(scored(counts, totals), counts), "collocations")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    first = kept.withColumn("_nth", F.row_number().over(share)).filter(F.col("_nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op11_collocations(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``mine_collocations``."""
    return mine_collocations(docs)
