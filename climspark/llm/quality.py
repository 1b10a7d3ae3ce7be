"""Quality rules with adaptive thresholds.

Only DataFrame functions are used. Each text is read once: its counts are written to the shared folder, and all that
follows works on these few numbers. Quantile sketches (mergeable, so each task reduces its own rows first) describe
every measure per language and source, over the documents that pass the base rules. A document is out of line with its
own kind beyond the group's median and ``SPREAD`` times the way from there to the outer decile. No fence has a floor of
its own: pseudo-counts give texts without any symbol or repeat a rate that shrinks with their length, so the sketches
tell how much of it is chance, and a document is let off that many. A group's way to its outer decile counts no further than ``LOOSEN`` times that of all
documents (and the group's own median), so junk in more than a tenth of a group doesn't open its fence. A group's fence
is blended with that of all documents, in parts n and ``PRIOR``. Fences are joined back to the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climspark.llm.common import small_side
from climspark.sources.staging import stage

# The contract's base rules.
MIN_WORDS = 20
MAX_REPEAT = 0.3
WINDOW = 8

# Relative error of a quantile's rank is 1 / ACCURACY.
ACCURACY = 1_000
SPREAD = 3.0
LOOSEN = 2.0
# Documents that the fence of all documents counts for beside a group's own.
PRIOR = 30
# Measures with an upper fence: what is counted, of how many, and the pseudo-count, half of what a text may show by
# chance (eight symbols, one line, two windows).
COUNTED = {
    "symbols": ("n_symbols", "word_chars", 4.0),
    "dup_lines": ("n_dup_lines", "n_lines", 0.5),
    "repeats": ("n_repeat_words", "n_words", 8.0),
}
# The mean length of words has a fence on each side, on a log scale. A text of n words may stray by NOISE / sqrt(n).
NOISE = 1.0
# Differences below this are rounding.
EPSILON = 1e-9
# Bytes of a row of fences, for the size check of the join.
FENCE_BYTES = 300

_SPACES = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns and the counts of each text; null counts as empty.

    Repeated windows are found by sorting (hash, place) pairs, and only in texts in which some hash is repeated, so
    the work is n log n for any text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [F.col(c).alias(f"_k{i}") for i, c in enumerate(carry)]
    df = docs.select(*own, text.alias("text"))
    df = df.select(
        *[c for c in df.columns if c != "text"],
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "").alias("lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    rest = [c for c in df.columns if c not in ("words", "lines")]
    windows = F.transform(
        F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW))
    )
    df = df.select(
        *rest,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, windows).alias("hashes"),
    )
    rest = [c for c in df.columns if c != "hashes"]
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.select(*rest, F.when(repeated, F.array_sort(placed)).alias("placed"))
    at = lambda k: F.get(F.col("placed"), k)["h"]
    twice = F.filter("placed", lambda x, k: F.coalesce(x["h"] == at(k - 1), F.lit(False)) | F.coalesce(x["h"] == at(k + 1), F.lit(False)))
    df = df.select(*rest, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("starts"))
    # Each repeated window adds the words up to the next one's start, eight at most.
    gaps = F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return df.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)], *counts)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))


def rate(name: str, padded: bool) -> Column:
    """Share of a counted measure: half of what chance may show is added for the sketches, all of it is let off for
    the document's own."""
    count, of, pseudo = COUNTED[name]
    return (F.col(count) + F.lit(pseudo if padded else -2 * pseudo)) / (F.col(of) + F.lit(2 * pseudo))


def log_length() -> Column:
    return F.ln(F.nullif(F.col("word_chars"), F.lit(0)) / F.nullif(F.col("n_words"), F.lit(0)))


# Each fence: the measure, its middle and its way to the outer decile, above or below.
FENCES = [*COUNTED, "longer", "shorter"]


def spreads(counts: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of ``keys``: documents that pass the base rules, and per fence the median of its measure and the
    way from there to the outer decile."""
    sketch = {m: F.percentile_approx(rate(m, True), [0.1, 0.5, 0.9], ACCURACY) for m in COUNTED}
    sketch["lengths"] = F.percentile_approx(log_length(), [0.1, 0.5, 0.9], ACCURACY)
    grouped = counts.filter(~base_failed()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_docs"), *[v.alias(m) for m, v in sketch.items()]
    )
    q = lambda name, i: F.get(F.col(name), F.lit(i))
    out = []
    for m in FENCES:
        source = m if m in COUNTED else "lengths"
        way = q(source, 1) - q(source, 0) if m == "shorter" else q(source, 2) - q(source, 1)
        out += [q(source, 1).alias(f"{m}_mid"), way.alias(f"{m}_way")]
    return grouped.select(*keys, "n_docs", *out)


def within(overall: dict) -> Column:
    """Whether a document lies within all fences: its group's columns of ``spreads`` blended with ``overall``."""
    n = F.coalesce(F.col("n_docs"), F.lit(0)).cast("double")
    fits = F.lit(True)
    for m in FENCES:
        mid, way = (F.lit(overall[f"{m}_{x}"]).cast("double") for x in ("mid", "way"))
        most = way * LOOSEN + (F.col(f"{m}_mid") if m in COUNTED else F.lit(0.0))
        sign = -1.0 if m == "shorter" else 1.0
        own = F.col(f"{m}_mid") + F.least(F.col(f"{m}_way"), most) * (sign * SPREAD)
        fence = (n * F.coalesce(own, F.lit(0.0)) + (mid + way * (sign * SPREAD)) * PRIOR) / (n + PRIOR)
        if m in COUNTED:
            beyond = rate(m, False) - fence
        else:
            beyond = (log_length() - fence) * sign - F.lit(NOISE) / F.sqrt(F.nullif(F.col("n_words"), F.lit(0)))
        fits &= ~F.coalesce(beyond > EPSILON, F.lit(False))
    return fits


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every row of ``docs``.

    Null languages and sources are groups of their own. A document that fails the base rules is not kept; any other is
    kept if no measure lies beyond its fence. Null and empty texts have no words and fail. Repeated rows count and come
    out as often as they are. No rows: no rows.
    """
    keys = [F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source")]
    counts = stage(measured(docs.select("doc_id", "text", *keys), ["doc_id", "_lang", "_source"]), "counts")
    overall = spreads(counts, []).first().asDict()
    groups = stage(spreads(counts, ["_lang", "_source"]).withColumnsRenamed({"_lang": "_l", "_source": "_s"}), "spreads")
    same = F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s"))
    joined = counts.join(small_side(groups, groups.count(), FENCE_BYTES), same, "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within(overall))


def keep_good(docs: DataFrame) -> DataFrame:
    """doc_id of the documents that are kept."""
    return judge(docs).filter("kept").select("doc_id")


def op9_quality(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``judge``."""
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
