import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from climspark.llm import prefixes as op
from tests.llm import cases

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The trie by nested prefixes, one conversation at a time."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - c % 20, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def own_saving(node):
        return (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0

    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            saved[node[:d]] += own_saving(node)
            leaves[node[:d]] += not children[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(node))
        out.append((
            convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children[node]),
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def same(spark, rows, schema=SCHEMA, **options):
    got = op.prefix_trie(spark.createDataFrame(rows, schema), **options).collect()
    assert cases.ordered(got) == cases.ordered(brute(rows))
    return got


def talk(rng, conv, n, texts):
    return [(conv, t, "user" if t % 2 == 0 else "assistant", rng.choice(texts)) for t in range(n)]


def test_shared_openings_and_deep_conversations(spark):
    rng = random.Random(4)
    rows = [r for c in range(60) for r in talk(rng, c, rng.randint(1, 9), ["a b", "a", "c d e"])]
    rows += talk(rng, 61, 37, ["x y"]) + talk(rng, 62, 33, ["x y"]) + talk(rng, 81, 64, ["x y"])
    got = same(spark, rows)
    assert max(r.depth for r in got) > 60 and any(r.n_children > 1 and r.depth > 2 for r in got)


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (1, None, "user", "null turn first"), (1, 0, None, None),
        (1, 0, "user", "tie"), (1, 0, "assistant", "tie"), (1, 0, "assistant", "tie"), (2, -3, "", ""),
        (20, 0, "user", "one only"), (21, 0, "user", "w"), (22, 0, "user", "w"), (22, 1, "user", "w " * 9000),
        (23, 0, "u", "ser"), (24, 0, "us", "er"), (25, 5, "user", "Ünï 中 文\x0b🙂\x1cx"), (41, 0, "user", "base is absent"),
        (-7, 0, "user", "negative"), (9_000_000_000_000, 1, "user", "large id"),
    ]
    same(spark, rows)
    clashing = [(*r, "x", 1, 2) for r in rows]
    got = op.op13_prefix_trie(spark.createDataFrame(clashing, SCHEMA + ", x string, depth int, `a.b` int")).collect()
    assert cases.ordered(got) == cases.ordered(brute(rows))


def test_conversations_may_be_left_without_turns(spark):
    short = [c for c in range(101, 140) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20]
    rows = [(c, 0, "user", "gone") for c in short[:3]]
    got = same(spark, rows)
    assert [(r.depth, r.n_convs, r.n_leaves) for r in got] == [(0, 3, 1)]


def test_hot_groups_over_many_tasks(spark, monkeypatch):
    """Copies of one conversation, one opening and one endless conversation, with all bounds small."""
    for name, value in {"TURNS_PER_KEY": 4, "MANY_CHILDREN": 3, "IDS_PER_TEXT": 5}.items():
        monkeypatch.setattr(op, name, value)
    rng = random.Random(9)
    rows = [(c, t, "user", f"same {t}") for c in range(200, 240) for t in range(3)]
    rows += [r for c in range(300, 330) for r in [(c, 0, "user", "open"), (c, 1, "user", str(c))]]
    rows += talk(rng, 400, 100, ["on and on", "and on"])
    same(spark, rows, rows_per_task=25)


def test_empty_table(spark):
    got = op.op13_prefix_trie(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and dict(got.dtypes)["parent_conv_id"] == "bigint"


@pytest.mark.parametrize("depth", [1, 2, 3, 8])
def test_single_conversation(spark, depth):
    same(spark, [(7, t, "user", f"turn {t}") for t in range(depth)])
