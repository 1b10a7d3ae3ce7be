import random
import re

import numpy as np
import pytest

from climspark.llm import pii as op
from tests.llm import cases

# The contract's patterns as they stand.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute(text):
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits(m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], op.KINDS.index(s[2])))


def private_rows():
    texts = [
        "mail a.b+c@mail.example.com, or x@y", "from 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 ok 4111-1111-1111-1112",
        "+1 (556) 555-3414 and +49 30 1", "é 🙂 a@b.co 🙂 +1 (556) 555-3414", "a@b.c@d.e 4111111111111111@host.com +1 4111111111111111",
    ]
    return [(300 + i, t, "en", "a", 1) for i, t in enumerate(texts)] + cases.awkward_rows()


def test_base_rules_against_the_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789012345678..@@ab-+() é") for _ in range(rng.randint(1, 60)))
        assert op.base_spans(text) == brute(text), text
    for r in private_rows():
        assert op.base_spans(r[1]) == brute(r[1] or "")


def test_base_rules_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "+1" + " " * 300_000, "1." * 100_000, "a@" * 100_000):
        op.base_spans(text)


def test_gradients_by_differences():
    tagger = op.Tagger.fresh(1)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    codes = np.random.default_rng(0).integers(0, op.ALPHABET, (3, 7)).astype(np.uint8)
    tags = np.random.default_rng(1).integers(0, op.TAGS, (3, 7)).astype(np.int8)
    _, grads = tagger.gradients(codes, tags)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for step in (1e-3, -2e-3):
            tagger.weights[name][at] += step
            losses.append(tagger.gradients(codes, tags)[0])
        tagger.weights[name][at] += 1e-3
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[at], rel=1e-3)


def test_viterbi_is_the_best_path():
    import itertools

    tagger = op.Tagger.fresh(3)
    tagger.weights["trans"] = np.random.default_rng(2).standard_normal((op.TAGS, op.TAGS)).astype(np.float32)
    codes = np.random.default_rng(4).integers(0, op.ALPHABET, (2, 4)).astype(np.uint8)
    emit, _ = tagger.scores(codes)
    for w, got in enumerate(tagger.decode(codes)):
        def score(path):
            return sum(emit[t, w, path[t]] for t in range(4)) + sum(tagger.weights["trans"][a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(op.TAGS), repeat=4), key=score)
        assert tuple(got) == best


@pytest.fixture(scope="module")
def tagger(spark):
    rng = random.Random(1)
    rows = [(i, cases.words(rng, 40, "aehinorst"), "en", "a", 1) for i in range(200)]
    for i in range(100):
        value = rng.choice(["a.b@mail.example.com", "71.217.155.22", "4111 1111 1111 1111", "+1 (556) 555-3414"])
        rows.append((1000 + i, f"{cases.words(rng, 10, 'aehinorst')} {value} {cases.words(rng, 10, 'aehinorst')}", "en", "a", 1))
    return op.fit(cases.documents(spark, rows))


def test_held_out_windows(tagger):
    """Planted spans of another seed: nearly every window is labelled exactly."""
    rng = random.Random(9)
    windows = [(cases.words(rng, 40, "aehinorst")[: op.WINDOW], []) for _ in range(150)]
    codes, tags = op.labelled_windows(windows, seed=77)
    assert (tagger.decode(codes) == tags).all(axis=1).mean() > 0.85


def test_model_adds_spans_and_keeps_the_base(tagger):
    text = "reach me at (555) 123-4567 or bob.smith (at) example (dot) com or +1 (556) 555-3414 thanks"
    ((base, spans),) = op.spans_of([text], tagger)
    assert base == brute(text) and set(base) <= set(spans)
    assert {text[a:b] for a, b, _ in spans} >= {"(555) 123-4567", "+1 (556) 555-3414"}


def test_windows_are_reconciled(tagger):
    """A span gets the same labels wherever the windows' edges fall."""
    for shift in range(0, 70, 7):
        text = "ha ern " * 10 + "x" * shift + " call 555-123-4567 then " + "tho ner " * 20
        ((_, spans),) = op.spans_of([text], tagger)
        assert [text[a:b] for a, b, _ in spans] == ["555-123-4567"]


def test_windows_cover_all_triggers():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("a     1") for _ in range(rng.randint(0, 400)))
        place = -1
        covered = set()
        for at, upto in op.windows_of(text):
            assert at < upto <= at + op.WINDOW and upto > place
            covered.update(range(at, upto))
            place = upto
        assert {i for i, c in enumerate(text) if c == "1"} <= covered


def test_digest(spark, tagger):
    import hashlib

    rows = private_rows()
    found = {r.base: r for r in op.find(cases.documents(spark, rows), tagger).collect()}
    assert set(found) == {op.listed(brute(r[1] or "")) for r in rows}
    got = op.op7_pii(cases.documents(spark, rows)).collect()
    want = []
    for r in rows:
        spans = brute(r[1] or "")
        counts = [sum(s[2] == k for s in spans) for k in op.KINDS]
        want.append((r[0], *counts, hashlib.sha256(op.listed(spans).encode()).hexdigest()))
    assert cases.ordered(r[:6] for r in got) == cases.ordered(want)


def test_redaction(spark, tagger):
    docs = cases.documents(spark, private_rows())
    out = op.redact(docs, tagger)
    assert out.schema == docs.schema
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert texts[304] == "é 🙂 [EMAIL] 🙂 [PHONE]" and texts[1] is None and texts[2] == ""
    assert all(not brute(t or "") for t in texts.values())
    clashing = cases.clashing(spark)
    assert op.redact(clashing, tagger).schema == clashing.schema


def test_empty_table(spark):
    assert op.op7_pii(cases.empty(spark)).count() == 0


def test_bounded_sample_holds_windows_of_every_script(spark, monkeypatch):
    rng = random.Random(12)
    texts = [cases.words(rng, 60, letters) for letters in ("bcd", "яшю") for _ in range(200)]
    docs = cases.documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    monkeypatch.setattr(op, "SAMPLE_WINDOWS", 60)
    found = [text for text, _ in op.sample_windows(docs)]
    assert len(found) == 60 and found == [text for text, _ in op.sample_windows(docs.repartition(3))]
    assert 15 <= sum(any(c in "яшю" for c in t) for t in found) <= 45 and any(t[:1] in set("яшю") for t in found)
