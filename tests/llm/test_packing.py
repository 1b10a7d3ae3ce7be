import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from climspark.llm import packing as op
from tests.llm import cases


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op.tokenizer_path())


def test_ids_are_the_library_s(library):
    rng = random.Random(3)
    mine = op.WordTokenizer(op.tokenizer_path())
    letters = list("abcdetion  \n\t.,!0123<>|'s/äéßΣ中文字🙂́​\x00\x1c\x85Å½_THEİ")
    odd = ["", " ", "<|endoftext|> x", "a<|startoftext|>b", "it's I'LL 'd '", "É́ ΑΣ", "__init__ a_b", "x" * 3000]
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text in odd + [r[1] or "" for r in cases.awkward_rows()]:
        got = np.frombuffer(mine.encode(text), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def brute_pieces(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out.append((doc_id, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    return cases.ordered(out)


def check_sequences(rows):
    """Offsets are gapless from 0 and no sequence is too long; returns the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_pieces_and_sequences(spark, library):
    rows = cases.awkward_rows()
    got = op.op5_packing(cases.clashing(spark)).collect()
    want = brute_pieces(library, [(r[0], r[1]) for r in rows])
    assert cases.ordered(r[:5] for r in got) == want
    assert check_sequences(got) == -(-sum(r.length for r in got) // 2048)


def test_sequences_hold_the_ids(spark, library):
    docs = cases.documents(spark)
    packed = op.pack(docs)
    sizes = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n").collect()}
    for r in op.sequences(docs).collect():
        assert len(r.ids) == sizes[r.sequence_id] and r.ids[-1] == 0 or len(r.ids) == 2048


def exact_bins(lengths, capacity):
    """The fewest bins, by exhaustive search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_all_and_few_bins(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
    pattern = op.plan(Counter(lengths), 20)
    used = Counter()
    for lengths_of, bins in pattern:
        assert sum(x * t for x, t in lengths_of.items()) <= 20
        used.update({x: t * bins for x, t in lengths_of.items()})
    assert used == Counter(lengths)
    assert sum(b for _, b in pattern) <= exact_bins(lengths, 20) + 1


def test_fullest_is_the_fullest():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 15) for _ in range(7)]
        room = rng.randint(1, 30)
        best = max(s for s in {sum(items[i] for i in range(7) if m >> i & 1) for m in range(128)} if s <= room)
        chosen = op.fullest(Counter(items), room)
        assert sum(x * t for x, t in chosen.items()) == best
        assert all(t <= items.count(x) for x, t in chosen.items())


def test_empty_table(spark):
    assert op.op5_packing(cases.empty(spark)).count() == 0
