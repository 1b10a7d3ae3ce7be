"""Language ID by language-bitmask n-gram filters.

Training collects, per language, the character n-grams that are typical of it. They go into one Bloom filter per
language, all with the same hashes and stored bit-sliced: cell i holds a bitmask of the languages whose filter has bit i
set, in as many 64-bit words as the languages need. Looking up an n-gram ANDs the few cells it hashes to and yields all languages that contain it at once. A text's
n-grams are counted per language; the counts are corrected for each filter's rate of false positives, and the language
with the largest share decides.

The filters are fitted on a bounded sample of labelled documents, ``SAMPLE_DOCS`` a language; their size follows the
n-grams of that sample. Prediction reads whole texts, and nothing but the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climspark.llm.common import filter_batches, map_batches, sliced, small_side
from climspark.sources.staging import stage

UNKNOWN = "und"
# The bound of the training sample: documents a language (in expectation).
SAMPLE_DOCS = 1_500
# Languages of one word of a cell.
WORD = 64
ORDERS = (3, 4)
# An n-gram is typical of a language in which at least so many documents, and this share of the rate of the language
# that uses it most, have it.
MIN_DOCS = 3
MIN_SHARE = 0.2
# Of a language with fewer documents, every n-gram counts.
SMALL_LANGUAGE = 30
HASHES = 3
BITS_PER_GRAM = 16
# The filter stage drops a text of at least MIN_GRAMS n-grams if no language stands out with MIN_SCORE (by its own share
# of the n-grams or by its lead over the second, however many languages there are), or if even the best one knows less
# than MIN_KNOWN of the n-grams. Shorter texts say too little against themselves.
MIN_GRAMS = 50
MIN_SCORE = 0.3
MIN_KNOWN = 0.1
# Characters that are looked up at once.
CHUNK = 1 << 19
# Bytes of a language's row, for the size check of the join.
LANGUAGE_BYTES = 100

_SPACE = 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters; made once in each Python worker."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)
    return _is_letter


def codes(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text, runs of other characters than letters as one space, in chunks that overlap
    by the longest n-gram less one."""
    letters, tail = _letters(), np.array([_SPACE], dtype=np.uint32)
    for i in range(0, len(text), CHUNK):
        part = text[i : i + CHUNK].lower().encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(part, dtype=np.uint32)
        points = np.where(letters[points], points, _SPACE).astype(np.uint32)
        points = np.concatenate([tail, points])
        points = points[np.concatenate([[True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)])]
        yield points
        tail = points[-(max(ORDERS) - 1) :]
    if len(text) and tail[-1] != _SPACE:
        yield np.append(tail, np.uint32(_SPACE))


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the n-grams of one order that hold a letter."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        out = (out ^ points[k : k + n]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return out


def text_grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams, each place once."""
    first = True
    for points in codes(text):
        for order in ORDERS:
            # The overlap is as long as the longest n-gram needs; shorter ones skip what they have seen.
            yield grams(points if first else points[max(ORDERS) - order :], order)
        first = False


@dataclass(frozen=True)
class Filters:
    """Languages, bit-sliced cells (a row of them for each word), and the rate of false positives of each language's
    filter."""

    languages: list[str]
    cells: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def build(languages: Sequence[str], members: Sequence[np.ndarray]) -> Filters:
        """``members[i]``: hashes of the n-grams of language i."""
        most = max([len(m) for m in members], default=0)
        size = 1 << max(10, int(most * BITS_PER_GRAM).bit_length())
        bits = min(len(languages), WORD)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= bits)
        cells = np.zeros((-(-len(languages) // WORD), size), dtype=kind)
        fill = []
        for i, hashes in enumerate(members):
            mine = np.zeros(size, dtype=bool)
            for place in _places(hashes, size):
                mine[place] = True
            cells[i // WORD] |= mine.astype(kind) << kind(i % WORD)
            fill.append(mine.mean())
        return Filters(list(languages), cells, np.array(fill) ** HASHES)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains."""
        places, kind = list(_places(hashes, self.cells.shape[1])), self.cells.dtype.type
        masks = []
        for word in self.cells:
            mask = word[places[0]]
            for place in places[1:]:
                mask = mask & word[place]
            masks.append(mask)
        return np.array(
            [np.count_nonzero(masks[i // WORD] & (kind(1) << kind(i % WORD))) for i in range(len(self.languages))]
        )

    def shares(self, text: str | None) -> tuple[np.ndarray, int] | None:
        """The share of the text's n-grams that each language knows, and their number; None without a letter or a
        language."""
        if not self.languages or not text or not _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return None
        hits, n = np.zeros(len(self.languages)), 0
        for hashes in text_grams(text):
            if len(hashes):
                hits += self.counts(hashes)
                n += len(hashes)
        if not n:
            return hits, 0
        return np.clip((hits / n - self.false_rate) / (1 - self.false_rate), 0, 1), n

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the language's part of all shares."""
        found = self.shares(text)
        if found is None:
            return UNKNOWN, 0.0
        share, best = found[0], int(np.argmax(found[0]))
        return self.languages[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0

    def judge(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, how far it stands out, the share of the n-grams that it knows, and their number.

        It stands out by that share, or by its lead over the second as a part of the share, whichever is more. Neither
        shrinks as further languages join that know less than the second.
        """
        found = self.shares(text)
        if found is None:
            return UNKNOWN, 0.0, 0.0, 0
        share, n = found
        best = int(np.argmax(share))
        known = float(share[best])
        second = float(np.delete(share, best).max(initial=0.0))
        return self.languages[best], max(known, (known - second) / known) if known > 0 else 0.0, known, n

    def accepts(self, text: str | None, min_score: float = MIN_SCORE) -> bool:
        lang, score, known, n = self.judge(text)
        return lang != UNKNOWN and (n < MIN_GRAMS or (score >= min_score and known >= MIN_KNOWN))


def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - (size.bit_length() - 1))
    for k in range(HASHES):
        mixed = (hashes + np.uint64(k)) * _MIX[3 - k]
        yield (mixed ^ (mixed >> np.uint64(31))) * _MIX[0] >> shift


def bucket(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 4; held-out documents have 2. A null id counts as empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters of the languages in ``lang``, from at most about ``sample_docs`` documents of each.

    Only documents with a text, a lang and a bucket other than 2 count. The sample is drawn by a hash of doc_id, so it
    does not depend on partitions. No such document: no language, and every prediction is ``und``.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket("doc_id") != 2)).select(
        F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text")
    )
    counts = stage(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_docs")), "languages")
    sizes = {r.lang: r["_docs"] for r in counts.collect()}
    if not sizes:
        return Filters([], np.zeros((0, 1), np.uint8), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    known = labelled.join(small_side(counts, len(sizes), LANGUAGE_BYTES), "lang")
    sample = known.filter(draw < F.lit(sample_docs) / F.col("_docs"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        docs_of: dict[str, int] = defaultdict(int)
        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_of[lang] += 1
                parts = list(text_grams(text))
                for g in np.unique(np.concatenate(parts)).tolist() if parts else ():
                    seen[lang][g] += 1
        for lang, found in seen.items():
            # An n-gram's row, and the number of documents under the number 0.
            keys = np.fromiter(found.keys(), np.uint64, len(found)).view(np.int64)
            keys, n = np.append(keys, 0), np.append(np.fromiter(found.values(), np.int64, len(found)), docs_of[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"]
            )

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    small = [lang for lang, n in sizes.items() if n < SMALL_LANGUAGE]
    enough = (F.col("n") >= MIN_DOCS) | (F.col("gram") == 0) | F.col("lang").isin(small)
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(enough)
    pdf = totals.toPandas().sort_values(["lang", "gram"])
    docs_of = pdf[pdf.gram == 0].set_index("lang").n
    pdf = pdf[(pdf.gram != 0) & pdf.lang.isin(docs_of.index)]
    pdf = pdf.assign(rate=pdf.n / pdf.lang.map(docs_of))
    typical = pdf[pdf.rate >= MIN_SHARE * pdf.groupby("gram").rate.transform("max")]
    languages = sorted(docs_of.index)
    members = [typical[typical.lang == x].gram.to_numpy().view(np.uint64) for x in languages]
    return Filters.build(languages, members)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every row; ``und`` if the text is null or has no letter. Ties go to the language
    that sorts first. Repeated rows repeat."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the training sample

    def rows(batch: pa.RecordBatch):
        found = [shipped.value.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        return [x[0] for x in found], [x[1] for x in found]

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(source, rows, "lang_pred string, score double", ["doc_id"])


def keep_identified(docs: DataFrame, filters: Filters | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that have a letter and are not plainly in no known language, all columns kept."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters if filters is not None else fit(docs))

    def keep(batch: pa.RecordBatch) -> list[bool]:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        return [shipped.value.accepts(t, min_score) for t in texts]

    return filter_batches(docs, keep)


def op8_language(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return predict(docs, fit(docs)).select(
        "doc_id", (bucket("doc_id") == 2).alias("held_out"), "lang_pred", "score"
    )
