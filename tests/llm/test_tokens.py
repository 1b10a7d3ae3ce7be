import random

import pytest

from climspark.llm import tokens as op
from tests.llm import cases


@pytest.fixture(scope="module")
def counter():
    return op.PrefixCounter(op.model_path())


def odd_texts():
    rng = random.Random(3)
    letters = list("abcdetion  \n\t▁.,!0123<>s/äéßΣ中文字🙂́​\x00\x1cÅTHE")
    odd = ["", "   ", " a", "a ", "<s>", "<0x0A>", "</s> x", "a\n\n b", " " * 100, "x" + " " * 37 + "the", "▁▁a", "\r\n"]
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(150)]


def test_every_prefix_against_the_library(counter):
    for text in odd_texts():
        want = [len(counter.library.encode(text[:i])) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, text
        assert counter.counts([text])[0] == want[-1]


def test_counts_of_rows(spark, counter):
    rows = cases.awkward_rows()
    got = op.op10_tokens(cases.clashing(spark))
    want = []
    for r in rows:
        n = len(counter.library.encode(r[1] or ""))
        want.append((r[0], len((r[1] or "").encode()), n, n > 4096))
    assert cases.ordered(got.collect()) == cases.ordered(want)


def test_stored_table_answers_without_texts(spark, counter):
    docs = spark.createDataFrame([(1, "the quick brown fox " * 30), (2, None)], "doc_id long, text string")
    table = op.prefix_table(docs, block=64)
    asked = spark.createDataFrame([(1, 0), (1, 63), (1, 64), (1, 600), (1, 601), (2, 0)], "doc_id long, position long")
    got = {(r.doc_id, r.position): r.n_tokens for r in op.counts_at(table, asked, block=64).collect()}
    text = "the quick brown fox " * 30
    want = {(1, i): len(counter.library.encode(text[:i])) for i in (0, 63, 64, 600)}
    assert got == want | {(1, 601): None, (2, 0): 0}


def test_truncation_is_the_longest_prefix(spark, counter):
    docs = cases.clashing(spark)
    out = op.truncate(docs, 9)
    assert out.schema == docs.schema
    cut = {(r.doc_id, r.text) for r in out.collect()}
    want = set()
    for r in cases.awkward_rows():
        text = r[1]
        if text:
            fits = [i for i in range(min(len(text), 200) + 1) if len(counter.library.encode(text[:i])) <= 9]
            text = text[: fits[-1]]
        want.add((r[0], text))
    assert cut == want


def test_empty_table(spark):
    assert op.op10_tokens(cases.empty(spark)).count() == 0
    assert op.prefix_table(cases.empty(spark)).count() == 0
