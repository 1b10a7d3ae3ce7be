import random
import zlib

import numpy as np
import pytest

from climspark.llm import langid as op
from tests.llm import cases

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["schl", "ung", "ber", "ö"], "cc": ["ción", "ñe", "que", "los"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, prose(rng, lang, rng.randint(5, 60)), lang, "a", 1) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=240))]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def test_held_out_accuracy(spark, rows):
    got = {r.doc_id: r for r in op.op8_language(cases.documents(spark, rows)).collect()}
    assert all(got[r[0]].held_out == held_out(r[0]) and 0 <= got[r[0]].score <= 1 for r in rows)
    judged = [got[r[0]].lang_pred == r[2] for r in rows if held_out(r[0])]
    assert len(judged) > 30 and np.mean(judged) > 0.97


def test_held_out_labels_are_not_learnt(spark, rows):
    """Other labels on the held-out rows change nothing."""
    changed = [(*r[:2], "zz" if held_out(r[0]) else r[2], *r[3:]) for r in rows]
    first = op.op8_language(cases.documents(spark, rows)).collect()
    second = op.op8_language(cases.documents(spark, changed)).collect()
    assert sorted(first) == sorted(second)


def test_filters_return_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (4000, 3000, 10)]
    members[1][:500] = members[0][:500]
    filters = op.Filters.build(["a", "b", "c"], members)
    assert filters.counts(members[0][:500]).tolist()[:2] == [500, 500]
    assert filters.counts(members[2])[2] == 10
    other = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    assert np.allclose(filters.counts(other) / 50_000, filters.false_rate, atol=2e-3)


def test_chunks_give_the_same_grams(monkeypatch):
    rng = random.Random(2)
    text = " ".join(cases.words(rng, 30).split() + ["ÄÖ", "中文", "..!"] * 5)
    whole = np.sort(np.concatenate(list(op.text_grams(text))))
    monkeypatch.setattr(op, "CHUNK", 7)
    assert np.array_equal(np.sort(np.concatenate(list(op.text_grams(text)))), whole)


def test_awkward_rows(spark, rows):
    docs = cases.documents(spark, [(1000 + r[0], *r[1:]) for r in rows] + cases.awkward_rows())
    got = op.predict(docs, op.fit(docs)).collect()
    assert len(got) == len(rows) + len(cases.awkward_rows())
    texts = {r[0]: r[1] for r in cases.awkward_rows()}
    for r in got:
        if r.doc_id in (1, 2, 3, 4):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id in texts and any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert r.lang_pred != "und"


def test_filter_keeps_known_languages(spark, rows):
    docs = cases.clashing(spark)
    filters = op.fit(cases.documents(spark, rows + cases.awkward_rows()))
    out = op.keep_identified(docs, filters, min_score=0.0)
    assert out.schema == docs.schema
    kept = {r.doc_id for r in out.collect()}
    # Texts without a letter go; short ones, whatever they are in, stay.
    assert not kept & {1, 2, 3, 4} and {5, 6} <= kept


def test_only_long_strange_texts_are_dropped(spark, rows):
    filters = op.fit(cases.documents(spark, rows))
    assert filters.accepts("Zw.") and filters.accepts("kato miru")
    assert not filters.accepts("zzxw qqvj wxyz jjqq " * 20) and not filters.accepts("12 34 ..") and not filters.accepts(None)


def test_without_training_data(spark):
    assert op.op8_language(cases.empty(spark)).count() == 0
    unlabelled = cases.documents(spark, [(1, "some words", None, "a", 1)])
    assert op.op8_language(unlabelled).first().lang_pred == "und"


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    words = {f"l{i:02}": rng.sample(letters, 12) for i in range(70)}
    text = lambda lang: " ".join("".join(rng.choice(words[lang]) for _ in range(2)) for _ in range(40))
    rows = [(1000 * j + i, text(lang), lang, "a", 1) for i, lang in enumerate(words) for j in range(8)]
    got = {r.doc_id: r.lang_pred for r in op.op8_language(cases.documents(spark, rows)).collect()}
    judged = [got[r[0]] == r[2] for r in rows if held_out(r[0])]
    assert len(got) == len(rows) and len(judged) > 70 and np.mean(judged) > 0.97


def test_cells_of_several_words_return_all_languages_of_a_gram():
    rng = np.random.default_rng(2)
    members = [rng.integers(0, 2**64, 300, dtype=np.uint64) for _ in range(130)]
    for i in (0, 63, 64, 127, 128):
        members[i][:100] = members[129][:100]
    filters = op.Filters.build([f"{i:03}" for i in range(130)], members)
    found = filters.counts(members[129][:100])
    assert {i for i, n in enumerate(found) if n == 100} == {0, 63, 64, 127, 128, 129} and np.sort(found)[:-6].max() < 20


def known_by(text, parts):
    """Filters of as many languages as ``parts``, each with that part of the text's n-grams."""
    grams = np.unique(np.concatenate(list(op.text_grams(text))))
    rng = np.random.default_rng(3)
    members = [rng.permutation(grams)[: round(p * len(grams))] for p in parts]
    return op.Filters.build([f"{i:02}" for i in range(len(parts))], members)


@pytest.mark.parametrize("others", [1, 3, 40, 80])
def test_acceptance_does_not_follow_the_number_of_languages(others):
    rng = random.Random(9)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    assert known_by(text, [1.0] + [0.9] * others).accepts(text)
    assert known_by(text, [0.2] + [0.1] * others).accepts(text)
    assert not known_by(text, [0.2] + [0.19] * others).accepts(text)
    assert not known_by(text, [0.05] + [0.0] * others).accepts(text)
