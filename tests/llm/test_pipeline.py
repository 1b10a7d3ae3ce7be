"""The pipeline's stages against brute force, on a table of awkward and planted rows."""

import random

import pytest

import corpus_pipeline
from climspark.llm import langid, pii
from climspark.sources.staging import new_folder
from tests.llm import cases
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_langid import prose
from tests.llm.test_packing import brute_pieces, check_sequences
from tests.llm.test_pii import brute as brute_private
from tests.llm.test_simhash import expected as brute_classes


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(7)
    rows = cases.awkward_rows()
    passage = prose(rng, "aa", 20)
    for i in range(300, 420):
        lang = rng.choice(["aa", "bb"])
        text = prose(rng, lang, rng.randint(20, 80))
        if i % 10 == 0:
            text = f"{prose(rng, lang, 30)} {passage} {prose(rng, lang, 30)}"
        if i % 10 == 1:
            text += f" mail a{i}@mail.example.com or +1 (556) 555-{i:04d}"
        rows += [(i, text, lang, "hot", len(text))] * (3 if i % 10 == 2 else 1)
    path = new_folder(spark, "corpus")
    cases.documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage


def test_stages_each_on_all_that_the_last_kept(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = function(spark, docs, path)
        after = [tuple(r) for r in out.collect()]
        if k < 4:
            assert out.columns == columns, name
        if name == "language_id":
            filters = langid.fit(docs)
            want = []
            for r in before:
                lang, score, known, n = filters.judge(r[1])
                clear = score >= langid.MIN_SCORE and known >= langid.MIN_KNOWN
                want += [r] if lang != "und" and (n < langid.MIN_GRAMS or clear) else []
            assert cases.ordered(after) == cases.ordered(want)
            assert {r[0] for r in after} >= set(range(300, 420)) and 4 not in {r[0] for r in after}
        if name == "near_duplicates":
            want = {w[2] for w in brute_classes(before)}
            assert sorted(cases.plain(r[0]) for r in after) == sorted(map(cases.plain, want))
            assert set(after) <= set(before)
        if name == "decontamination":
            judged = brute_contamination([(r[0], r[1]) for r in before], [(1, passage)])
            dirty = {j[0] for j in judged if j[5]}
            assert dirty and cases.ordered(after) == cases.ordered(r for r in before if r[0] not in dirty)
        if name == "personal_data":
            assert len(after) == len(before)
            old = {r[0]: r for r in before}
            for r in after:
                assert not brute_private(r[1] or "")
                if not pii._TRIGGER.search(old[r[0]][1] or ""):
                    assert r[1] == old[r[0]][1]
                assert r[1] is None or r[4] == len(r[1])
        if name == "packing":
            from tokenizers import Tokenizer

            from climspark.llm import packing

            library = Tokenizer.from_file(packing.tokenizer_path())
            assert cases.ordered(r[:5] for r in after) == brute_pieces(library, [(r[0], r[1]) for r in before])
            rows = out.collect()
            assert check_sequences(rows) <= -(-sum(r.length for r in rows) // 2048) + 1
        stored = f"{new_folder(spark, 'stage')}"
        out.write.parquet(stored)
        docs = spark.read.parquet(stored)


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs, folder[0]).count() == 0, name


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "decontamination", "personal_data", "packing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None
