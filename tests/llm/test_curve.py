import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from climspark.llm import curve as op
from climspark.llm.packing import tokenizer_path
from tests.llm import cases


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [op.END]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def check(library, rows, got, capacity=op.CAPACITY):
    """Pieces cover each document once, checksums are those of its ids, sequences are gapless and need no padding."""
    texts, by_doc, by_sequence = defaultdict(list), defaultdict(list), defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id].append(ids_of(library, text))
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        wanted, copies = texts[doc_id], len(texts[doc_id])
        assert sum(p.length for p in pieces) == sum(map(len, wanted))
        assert {p.doc_tokens for p in pieces} == {len(w) for w in wanted}
        for p in pieces:
            cuts = [w[p.start : p.start + p.length] for w in wanted if len(w) == p.doc_tokens]
            assert any(len(c) == p.length and crc(c) == p.ids_crc32 for c in cuts)
        if copies == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    return by_sequence


def test_awkward_rows(spark, library):
    check(library, cases.awkward_rows(), op.op12_curve_packing(cases.clashing(spark)).collect())


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_small_capacities(spark, library, capacity):
    rows = [r for r in cases.awkward_rows() if r[0] != 8]
    got = op.pack_along_curve(cases.documents(spark, rows), capacity=capacity).collect()
    sequences = check(library, rows, got, capacity)
    total = sum(len(ids_of(library, r[1])) for r in rows)
    assert sum(sum(n for _, n in parts) == capacity for parts in sequences.values()) >= total // capacity - 1


def test_many_tasks_give_one_stretch(spark, library):
    rows = cases.awkward_rows() * 3
    got = op.pack_along_curve(cases.documents(spark, rows), capacity=256, rows_per_task=20).collect()
    check(library, rows, got, 256)


def test_sequences_hold_the_ids(spark, library):
    rows = cases.awkward_rows()
    docs = cases.documents(spark, rows)
    ids = [i for r in op.sequences_along_curve(docs, capacity=128).collect() for i in r.ids]
    assert sorted(ids) == sorted(i for r in rows for i in ids_of(library, r[1]))
    pieces = op.pack_along_curve(docs, capacity=128, keep_ids=True).collect()
    assert all(crc(p.ids) == p.ids_crc32 and len(p.ids) == p.length for p in pieces)


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_and_moves_one_step(dimensions, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = op.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_equal_texts_lie_together_and_keys_fit(spark):
    documents = [np.array(ids, np.uint32) for ids in ([5, 9, 9], [5, 9, 9], [], [400, 7])]
    vectors = op.hashed_vectors(documents, op.slots(500))
    assert np.allclose(vectors[0], vectors[1]) and np.allclose((vectors**2).sum(axis=1), [1, 1, 0, 1])
    keys = op.hilbert_keys(op.cells(vectors, op.directions()))
    assert keys[0] == keys[1] and (keys >= 0).all() and (keys < 1 << 60).all()


def test_neighbours_use_similar_words(spark):
    """Documents of two vocabularies: most sequences hold one of them, where chance would mix nearly all."""
    rng = random.Random(5)
    rows = [(i, cases.words(rng, 40, "abcdefg" if i % 2 else "opqrstu"), "en", "a", 0) for i in range(600)]
    got = op.pack_along_curve(cases.documents(spark, rows), capacity=1024).collect()
    of = defaultdict(set)
    for r in got:
        of[r.sequence_id].add(r.doc_id % 2)
    mixed = sum(len(kinds) == 2 for kinds in of.values())
    assert len(of) > 20 and mixed <= len(of) / 2


def test_empty_table(spark):
    assert op.op12_curve_packing(cases.empty(spark)).collect() == []


def test_stretch_ends_in_powers_of_two():
    for total in range(0, 70):
        stretch = op.Stretch(total, 16)
        parts = list(stretch.cut(0, total))
        assert sum(n for _, _, n in parts) == total and [s for s, _, _ in parts] == list(range(stretch.sequences()))
        assert all(n == 16 or n & (n - 1) == 0 for _, _, n in parts)
