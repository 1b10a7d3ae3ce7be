import hashlib
import random
import re

import pytest

from climspark.llm import decontaminate as op
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w = brute_words(text)
        hit, found = set(), set()
        for item, passage in items:
            p = brute_words(passage)
            n = min(13, len(p))
            for i in range(len(p) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[i : i + n]:
                        hit.update(range(j, j + n))
                        found |= {str(item)} if item is not None else set()
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), names, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return cases.ordered(out)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    long_ = cases.words(rng, 30)
    return [(1, long_), (2, cases.words(rng, 13)), (10, "one"), (11, None), (12, ""), (None, "two words"), (2, "e, D!"), (3, long_)]


@pytest.fixture(scope="module")
def rows(items):
    rng = random.Random(6)
    out = [(r[0], r[1]) for r in cases.awkward_rows()]
    passage = items[0][1].split()
    for i in range(100, 110):
        part = " ".join(passage[i - 100 : i - 100 + 15]).upper()
        out.append((i, f"{cases.words(rng, 20)}; {part}\n{cases.words(rng, rng.choice([5, 400]))}"))
    return out


@pytest.mark.parametrize("block_windows", [op.BLOCK_WINDOWS, 5])
def test_against_brute_force(spark, rows, items, block_windows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = op.scan(docs, bench, block_windows=block_windows).withColumn("n_hit", op.n_hit())
    if block_windows == op.BLOCK_WINDOWS:
        assert cases.ordered(op.op3_decontaminate(docs, bench).collect()) == brute(rows, items)
    got = cases.ordered((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect())
    assert got == cases.ordered(r[:4] for r in brute(rows, items))


def test_spans_are_places_of_the_original(spark):
    docs = spark.createDataFrame([(1, "Ähm -- Say THE quick, brown fox! end"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the quick brown")], "item_id long, text string")
    (row,) = op.hit_spans(docs, bench).collect()
    assert "Ähm -- Say THE quick, brown fox! end"[row.start : row.end] == "THE quick, brown"


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(8)
    text = cases.words(rng, 90)
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    monkeypatch.setattr(op, "PIECE_WORDS", 20)
    pieces = op.item_pieces(bench).collect()
    windows = {tuple(p.words.split()[i : i + 13]) for p in pieces for i in range(p.n)}
    w = brute_words(text)
    assert len(pieces) > 1 and windows == {tuple(w[i : i + 13]) for i in range(len(w) - 12)}


def test_filter_keeps_columns_and_clean_rows(spark, items):
    docs = cases.clashing(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = op.drop_contaminated(docs, bench)
    assert out.schema == docs.schema
    judged = brute([(r[0], r[1]) for r in cases.awkward_rows()], items)
    assert out.count() == sum(not r[5] for r in judged)


def test_empty_tables(spark):
    docs, none = cases.empty(spark), spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert op.op3_decontaminate(docs, bench).count() == 0
    assert op.op3_decontaminate(cases.documents(spark), none).filter("n_hit > 0").count() == 0
    assert op.drop_contaminated(docs, none).count() == 0
