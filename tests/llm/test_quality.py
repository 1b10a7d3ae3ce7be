import random
import re

import pytest

from climspark.llm import quality as op
from tests.llm import cases


def quality_rows():
    rng = random.Random(3)
    line = cases.words(rng, 9)
    eight = cases.words(rng, 8)
    texts = [
        f"{line}\n{line}\n \n{line} \n\n", f"{eight} {eight}", f"{eight} x {eight} {eight[:5]} {eight}", "a " * 40, "&&& <b> ## 100% $|*",
        f"{eight}\n{eight}\n{cases.words(rng, 60)}", f"{cases.words(rng, 5)}\x1c{cases.words(rng, 5)}\xa0x\x0by",
    ]
    return [(200 + i, t, "en", "hot", 1) for i, t in enumerate(texts)] + cases.awkward_rows()


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    from collections import Counter

    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_counts_against_brute_force(spark):
    rows = quality_rows()
    got = op.op9_quality(cases.documents(spark, rows)).collect()
    want = [(r[0], *brute_counts(r[1])) for r in rows]
    assert cases.ordered(r[:7] for r in got) == cases.ordered(want)
    assert all(not r.kept for r in got if r.base_failed)


def test_fences_follow_language_and_source(spark):
    """What is usual in one source is out of line in another."""
    rng = random.Random(5)
    rows = []
    for i in range(200):
        rows.append((i, cases.words(rng, 40), "en", "prose", 1))
        rows.append((1000 + i, " ".join(w + "#" for w in cases.words(rng, 40).split()), "en", "code", 1))
    rows += [(5000, rows[1][1], "en", "prose", 1), (5001, rows[3][1], None, None, 1)]
    got = {r.doc_id: r.kept for r in op.op9_quality(cases.documents(spark, rows)).collect()}
    assert all(got[i] and got[1000 + i] for i in range(200)) and not got[5000]


def kept_of(spark, rows):
    return {r.doc_id: r.kept for r in op.op9_quality(cases.documents(spark, rows)).collect()}


def prose(rng, n, source="prose", first=0):
    """Documents of four lines without symbols or repeats."""
    return [(first + i, "\n".join(cases.words(rng, 20) for _ in range(4)), "en", source, 1) for i in range(n)]


def test_group_of_few_takes_mostly_the_fence_of_all(spark):
    rng = random.Random(6)
    rows = prose(rng, 100)
    rows += [(500 + i, " ".join(w + "###" for w in cases.words(rng, 40).split()), "xx", "few", 1) for i in range(3)]
    got = kept_of(spark, rows)
    assert all(got[i] for i in range(100)) and not any(got[500 + i] for i in range(3))


@pytest.mark.parametrize("measure", ["symbols", "dup_lines", "repeats", "longer", "shorter"])
def test_every_measure_rejects_alone(spark, measure):
    """A document that passes the base rules is out of line by one measure; its neighbours stay."""
    rng = random.Random(8)
    eight = cases.words(rng, 8)
    odd = {
        "symbols": " ".join(w + ("#" if i % 3 else "") for i, w in enumerate(cases.words(rng, 80).split())),
        "dup_lines": "\n".join([cases.words(rng, 120)] + [f"line {i // 9}" for i in range(18)]),
        "repeats": f"{eight} {cases.words(rng, 140)} " + " x ".join([eight] * 5),
        "longer": " ".join(w * 4 for w in cases.words(rng, 80).split()),
        "shorter": " ".join(w[:1] for w in cases.words(rng, 80).split()),
    }
    rows = prose(rng, 150) + [(900, odd[measure], "en", "prose", 1)]
    counts = brute_counts(odd[measure])
    assert not counts[5]
    got = kept_of(spark, rows)
    assert not got[900] and sum(got[i] for i in range(150)) >= 149


def test_junk_in_a_third_of_a_source_does_not_open_its_fence(spark):
    rng = random.Random(9)
    rows = prose(rng, 300, "clean") + prose(rng, 100, "mixed", 1000)
    rows += [(2000 + i, " ".join(w + "$$" for w in cases.words(rng, 60).split()), "en", "mixed", 1) for i in range(40)]
    got = kept_of(spark, rows)
    assert not any(got[2000 + i] for i in range(40)) and sum(got.values()) >= 398


def test_no_step_at_any_group_size(spark):
    """The same odd document in groups around the weight of all documents: one verdict, or one change of it."""
    rng = random.Random(10)
    odd = " ".join(w + "#" for w in cases.words(rng, 60).split())
    rows = prose(rng, 5000)
    for n in (1, 28, 29, 30, 31, 300):
        rows += [(10000 * n + i, " ".join(w + "#" for w in cases.words(rng, 60).split()), "en", f"s{n}", 1) for i in range(n)]
        rows.append((10000 * n + 9999, odd, "en", f"s{n}", 1))
    got = kept_of(spark, rows)
    verdicts = [got[10000 * n + 9999] for n in (1, 28, 29, 30, 31, 300)]
    assert not verdicts[0] and verdicts[-1] and verdicts == sorted(verdicts)


def test_one_symbol_or_repeated_line_is_no_fault(spark):
    rng = random.Random(11)
    rows = prose(rng, 150)
    line = cases.words(rng, 6)
    rows += [(901, cases.words(rng, 30) + " 100%", "en", "prose", 1), (902, f"{line}\n{cases.words(rng, 40)}\n{line}", "en", "prose", 1)]
    got = kept_of(spark, rows)
    assert got[901] and got[902]


def test_no_python_on_the_main_path(spark):
    plan = op.measured(cases.documents(spark), ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_keep_clashing_and_empty(spark):
    kept = op.keep_good(cases.clashing(spark))
    assert kept.columns == ["doc_id"]
    assert op.op9_quality(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [7, 8, 9])
def test_lengths_around_the_window(spark, n):
    text = " ".join("abcdefghi"[:n])
    (got,) = op.op9_quality(cases.documents(spark, [(1, text, "en", "a", 1)])).collect()
    assert tuple(got)[1:7] == brute_counts(text)
