import random
import re

import pytest

from climspark.llm import licenses as op
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


@pytest.mark.parametrize("seed", range(60))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    templates = [(f"l{k}", " ".join(rng.choices("abcd", k=rng.randint(1, 12)))) for k in range(rng.randint(1, 4))]
    base = {" ".join(rng.choices("abcd", k=rng.randint(1, 3))): f"b{k}" for k in range(3)}
    scanner = op.Scanner(templates, base)
    words = rng.choices("abcde", k=30)
    runs_of = [t.split() for _, t in templates] + [b.split() for b in base]

    def occurs(run):
        return any(s[i : i + len(run)] == run for s in runs_of for i in range(len(s)))

    places, runs = scanner.statistics([scanner.numbers.get(w.encode(), 0) for w in words])
    assert sorted(places) == sorted(
        (i, k) for k, p in enumerate(base) for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
    )
    longest = [0] + [max(n for n in range(i + 1) if not n or occurs(words[i - n : i])) for i in range(1, len(words) + 1)]
    ends = [i for i in range(1, len(words) + 1) if longest[i] and (i == len(words) or longest[i + 1] != longest[i] + 1)]
    assert [(end, size) for end, size, _ in runs] == [(i, longest[i]) for i in ends]
    for end, size, state in runs:
        want = {
            (k, i + size - 1)
            for k, (_, t) in enumerate(templates)
            for i in range(len(t.split()))
            if t.split()[i : i + size] == words[end - size : end]
        }
        assert {p for p in scanner.automaton.places[state] if p[0] >= 0} == want


def licensed_rows():
    rng = random.Random(2)
    notice = op.TEMPLATES[0][1]
    changed = notice.replace("free of charge, ", "").replace("merge, ", "merge, mend, ")
    texts = [
        "Licensed under the Apache License, Version 2.0.", "MIT License\nmit license MIT-License", "cc by cc by-nc", "the apache, license",
        f"{cases.words(rng, 50)}\n{changed}\n{cases.words(rng, 50)}", notice[:60], "GNU general PUBLIC license", "gnu general license",
    ]
    return [(100 + i, t, "en", "a", 1) for i, t in enumerate(texts)] + cases.awkward_rows()


def test_base_columns_against_brute_force(spark):
    rows = licensed_rows()
    want = []
    for r in rows:
        w = brute_words(r[1])
        starts, labels = [], set()
        for phrase, label in op.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        first, last = (min(starts), max(starts)) if starts else (None, None)
        want.append((r[0], len(w), len(starts), first, last, ",".join(sorted(labels))))
    got = op.op1_licenses(cases.documents(spark, rows)).collect()
    assert cases.ordered(r[:6] for r in got) == cases.ordered(want)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_changed_notice_is_chained(spark):
    rows = [r for r in licensed_rows() if r[0] == 104]
    (got,) = op.scan(cases.documents(spark, rows)).collect()
    assert got.base_labels == "" and got.labels == "mit" and 0.9 < got.score < 1
    (span,) = [s for s in got.spans if s.label == "mit"]
    assert span.start == 50 and span.end == len(brute_words(rows[0][1])) - 50


@pytest.mark.parametrize("between", [0, 1, 5, 40])
@pytest.mark.parametrize("copies", [2, 3, 30])
def test_every_copy_of_a_notice_has_a_span(spark, between, copies):
    """Whole and changed copies in turn, next to each other or apart."""
    rng = random.Random(4)
    notice = op.TEMPLATES[0][1]
    changed = notice.replace("free of charge, ", "").replace("merge, ", "merge, mend, ")
    text, want = [], []
    for i in range(copies):
        text += [f"w{rng.random()}x"] * between
        copy = brute_words(changed if i % 2 else notice)
        have = len(brute_words(" ".join(text)))
        want.append((have, have + len(copy)))
        text += copy
    (got,) = op.scan(cases.documents(spark, [(1, " ".join(text), "en", "a", 1)])).collect()
    mit = [s for s in got.spans if s.label == "mit" and s.end - s.start > len(brute_words(notice)) / 2]
    assert [(s.start, s.end) for s in mit] == want and got.score == 1


def test_partial_notice_has_a_score_and_no_label(spark):
    rows = [r for r in licensed_rows() if r[0] == 105]
    (got,) = op.op1_licenses(cases.documents(spark, rows)).collect()
    assert got.labels == "" and 0 < got.score < op.MIN_COVER


def test_clashing_and_empty(spark):
    assert op.op1_licenses(cases.clashing(spark)).count() == len(cases.awkward_rows())
    assert op.op1_licenses(cases.empty(spark)).count() == 0
