import random
import re
from collections import Counter

import numpy as np
import pytest

from climspark.llm import collocations as op
from tests.llm import cases

AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_count, top):
    counts, totals = Counter(), Counter()
    for row in rows:
        lang, text = row[2] or "und", (row[1] or "").translate(AZ)
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    frequent = {p: f for p, f in counts.items() if f >= min_count}
    out = []
    for lang in {p[0] for p in frequent}:
        found = []
        for phrase, a in frequent.items():
            words = phrase[1:]
            if phrase[0] != lang or len(words) < 2:
                continue
            longer = [f for p, f in frequent.items() if p[0] == lang and len(p) > len(phrase) and 100 * f >= 80 * a]
            inside = [
                p for p, f in frequent.items()
                if longer and p[0] == lang and len(p) > len(phrase) and 100 * f >= 80 * a
                and any(p[i : i + len(words)] == words for i in range(1, len(p)))
            ]
            if inside:
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
                cuts.append((2_000_000 * a // (left + right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return cases.ordered(out)


def text_of(rng, n):
    common = ["Salt and Pepper", "by and large", "on the other hand", "the the the", "çà et là"]
    signs = [" ", " ", " ", ", ", ". ", "\n", "\t", "!", "\x0b"]
    return "".join(
        (rng.choice(common) if rng.random() < 0.4 else cases.words(rng, 1, "abc")) + rng.choice(signs) for _ in range(n)
    )


def corpus(seed=2, docs=60):
    rng = random.Random(seed)
    return [(i, text_of(rng, 40), rng.choice(["en", "en", "fr", None, "und"]), "a", 0) for i in range(docs)]


@pytest.mark.parametrize("one_in, lowered", [(1, 0.5), (2, 1.0), (4, 0.8), (10**9, 0.8)])
def test_any_sample_gives_the_same(spark, one_in, lowered):
    """The whole as sample, halves at a full threshold, and an empty sample, which leaves all to further passes."""
    rows = corpus()
    got = op.mine_collocations(cases.documents(spark, rows), 6, 25, one_in, lowered)
    want = brute(rows, 6, 25)
    assert cases.ordered(got.collect()) == want and len(want) > 25


def test_awkward_rows(spark):
    rows = cases.awkward_rows() + corpus(7, 20) + [(900 + i, "q r s t u, q r", "en", "hot", 1) for i in range(40)]
    want = brute(rows, 5, 50)
    assert cases.ordered(op.mine_collocations(cases.documents(spark, rows), 5, 50).collect()) == want
    got = op.mine_collocations(cases.widened(spark, rows), 5, 50)
    assert cases.ordered(got.collect()) == want


def test_crowded_filter_costs_passes_not_results(spark, monkeypatch):
    """With a filter of 64 bits nearly all seems known; small stretches and batches change nothing."""
    for name, value in {"MIN_BITS": 64, "MAX_BITS": 64, "CHUNK_BITS": 8, "STRETCH_CHARS": 300, "PHRASES_HELD": 50, "CHARS_A_RANGE": 1000, "SHARES": 3}.items():
        monkeypatch.setattr(op, name, value)
    rows = corpus(3, 30)
    got = op.mine_collocations(cases.documents(spark, rows), 4, 10, 3)
    assert cases.ordered(got.collect()) == brute(rows, 4, 10)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame(
        [("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)], "lang string, n int, phrase string, f long"
    )
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, words long")
    row = op.scored(counts, totals).first()
    assert row.score == 2_000_000 * (big - 2) // (2 * big - 1) and (row.a, row.l, row.r, row.n) == (big - 2, big, big - 1, 3 * big)


def test_filter_holds_what_was_put_in(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, 3000, np.uint64)
    packed = spark.createDataFrame([(bytearray(keys[i : i + 1000].tobytes()), 1000) for i in (0, 1000, 2000)], "keys binary, held long")
    short = op.length_of(keys) < 4
    bloom = op.bloom_of(packed, 4)
    assert bloom.has(keys[short]).all() and short.sum() < 3000
    assert bloom.has(rng.integers(0, 1 << 62, 5000, np.uint64)).mean() < 0.05


def test_keys_know_language_length_and_order():
    a, b = op.word_keys("en", [b"a", b"b"])
    ab, ba = op.extended(np.array([a, b]), np.array([b, a]), 2)
    assert len({int(x) for x in (a, b, ab, ba, *op.word_keys("fr", [b"a", b"b"]))}) == 6
    assert op.length_of(np.array([a, ab])).tolist() == [1, 2]


def test_empty_table(spark):
    assert op.op11_collocations(cases.empty(spark)).collect() == []
    assert op.op11_collocations(cases.documents(spark, [(1, None, None, None, None), (2, " ., ", "en", "a", 1)])).collect() == []
