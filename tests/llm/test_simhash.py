import random
import re

import numpy as np
import pytest
import xxhash

from climspark.llm import simhash as op
from tests.llm import cases

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Roots (smallest index) of the graph of fingerprints within 3 bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near_copies(seed=2):
    """Texts of one long passage with a few words changed, of several lengths."""
    rng, out = random.Random(seed), []
    for k in range(4):
        base = cases.words(rng, 300).split()
        for i in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = "changed"
            out.append((200 + 20 * k + i, " ".join(w), "en", "a", 1))
    return out


@pytest.fixture(scope="module")
def rows():
    return cases.awkward_rows() + near_copies()


def expected(rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    return [(r[0], f"{p:016x}", least.get(root)) for r, p, root in zip(rows, prints, roots)]


def test_against_brute_force(spark, rows):
    want = expected(rows)
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # some fingerprints are linked
    got = op.op6_simhash(spark.createDataFrame(rows, cases.SCHEMA))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert cases.ordered(got.collect()) == cases.ordered(want)


def test_small_groups_force_the_deeper_deal(spark, rows):
    prints = sorted({brute_fingerprint(r[1]) for r in rows})
    links = op.near_links(
        spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long"), group_limit=3
    ).collect()
    at = {int(np.uint64(p).astype(np.int64)): i for i, p in enumerate(prints)}
    classes = op.Classes(len(prints))
    classes.union(np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert classes.root.tolist() == brute_components(prints)


@pytest.mark.parametrize("seed", range(4))
def test_trie_walk(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 20, dtype=np.uint64)
    keys = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(b)
            keys.add(x)
    keys = np.array(sorted(keys), dtype=np.uint64)
    classes = op.Classes(len(keys))
    for block in range(op.BLOCKS):
        a, b = op.forest_links(keys, block)
        assert len(a) < len(keys)
        classes.union(np.searchsorted(keys, a), np.searchsorted(keys, b))
    assert classes.root.tolist() == brute_components(keys.tolist())


def test_dense_ball_gives_a_forest_only():
    """Every two of 2^12 neighbours of a point are near; no pair list arises."""
    keys = np.arange(1 << 12, dtype=np.uint64) << np.uint64(3)
    a, _ = op.forest_links(keys, 0)
    assert len(a) == len(keys) - 1


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)]
    got = dict(op.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_one_row_of_each_group_stays(spark):
    docs = cases.clashing(spark)
    out = op.drop_near_duplicates(docs)
    assert out.schema == docs.schema
    want = expected(cases.awkward_rows())
    classes = {w[2] for w in want}
    assert sorted(cases.plain(r.doc_id) for r in out.collect()) == sorted(map(cases.plain, classes))


def test_empty_table(spark):
    assert op.op6_simhash(cases.empty(spark)).count() == 0
    assert op.drop_near_duplicates(cases.empty(spark)).count() == 0
