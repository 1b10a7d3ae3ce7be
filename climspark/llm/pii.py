"""Personal data: base rules, and a character-level bidirectional LSTM with a CRF on top, trained in numpy.

The base rules find spans of four kinds. The model is trained on labelled spans: those that the rules find in a bounded
sample of documents, and spans written in other usual ways (phone numbers without a plus, mail addresses spelt with
"at" and "dot"), planted into windows of the same documents.

All four kinds hold a digit or an at sign, written or spelt in brackets, so only the surroundings of these are read:
overlapping windows of ``WINDOW`` characters. Each window is decoded by Viterbi, and each character takes its label from
the window in whose middle it stands. Spans are then read off the whole text, checked, and added where no base span is.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climspark.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# --- base rules

_CLASS = "A-Za-z0-9._%+-"
_LOCAL_END = re.compile(f"[^{_CLASS}]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: a shorter start of the same run could not match either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Around each at sign: all characters of the local class before it, back to the previous match, and a domain."""
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and not _LOCAL_END.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        after = found.end() if found else at + 1
        if found:
            yield start, after, "email"
        at = text.find("@", after)


def base_spans(text: str | None) -> list[Span]:
    """Leftmost matches of each kind that pass its check, by start, then in the order of the kinds."""
    if not text or not _TRIGGER.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# --- the model

WINDOW = 64
STRIDE = 32
HIDDEN = 16
EMBED = 12
# Windows that go through the network at once.
BATCH = 512
# The bound of the training sample, in documents (in expectation) and windows; steps and windows a step.
SAMPLE_DOCS = 1_500
SAMPLE_WINDOWS = 2_000
STEPS = 260
STEP_WINDOWS = 48
SEED = 7

# Labels: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
# Characters: letters by themselves whatever the case, one class for digits, signs by themselves, others by class.
_SIGNS = "@.+-()_% :/[]{},;\n\"'=#"
_CODES = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate(_SIGNS):
    _CODES[ord(_c)] = 3 + _i
_CODES[ord("0") : ord("9") + 1] = 1
for _i in range(26):
    _CODES[ord("a") + _i] = _CODES[ord("A") + _i] = 3 + len(_SIGNS) + _i
ALPHABET = 3 + len(_SIGNS) + 26


def char_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 256, _CODES[np.minimum(points, 255)], 2).astype(np.uint8)


def labels_of(spans: Iterable[Span], start: int, length: int) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int8)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        lo, hi = max(a - start, 0), min(b - start, length)
        if lo < hi:
            tags[lo:hi] = 2 + 2 * k
            if a >= start:
                tags[lo] = 1 + 2 * k
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Tagger:
    """Embeddings, two LSTMs (one per direction), output layer and CRF transitions, by name."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = SEED) -> Tagger:
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        weights = {"embed": draw(ALPHABET, EMBED) * 3, "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32)}
        for way in ("f", "b"):
            weights[f"{way}_in"] = draw(EMBED, 4 * HIDDEN)
            weights[f"{way}_rec"] = draw(HIDDEN, 4 * HIDDEN)
            weights[f"{way}_bias"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        weights["trans"] = np.zeros((TAGS, TAGS), np.float32)
        return Tagger(weights)

    def _lstm(self, x: np.ndarray, way: str, keep: bool):
        """Hidden states (time first) of one direction; with ``keep`` also what the way back needs."""
        rec = self.weights[f"{way}_rec"]
        inputs = x @ self.weights[f"{way}_in"] + self.weights[f"{way}_bias"]
        steps, size = x.shape[0], x.shape[1]
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        out, kept = np.empty((steps, size, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ rec
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            if keep:
                kept.append((t, h, before, i, f, o, g, squashed))
            h = o * squashed
            out[t] = h
        return out, kept

    def scores(self, codes: np.ndarray, keep: bool = False):
        """Tag scores, time first, for windows of codes."""
        x = self.weights["embed"][codes.T]
        (hf, kf), (hb, kb) = self._lstm(x, "f", keep), self._lstm(x, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.weights["out"] + self.weights["bias"], (x, h, kf, kb)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best tags of each window by Viterbi."""
        emit, _ = self.scores(codes)
        trans = self.weights["trans"]
        steps, size = emit.shape[:2]
        best, back = emit[0], np.empty((steps, size, TAGS), np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + trans[None]
            back[t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + emit[t]
        tags = np.empty((size, steps), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(size)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
        w = self.weights
        emit, (x, h, kf, kb) = self.scores(codes, keep=True)
        steps, size = emit.shape[:2]
        trans, gold = w["trans"], tags.T.astype(np.int64)
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = _softmax_sum(alpha[t - 1][:, :, None] + trans[None], 1) + emit[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _softmax_sum(trans[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        norm = _softmax_sum(alpha[-1], 1)
        rows = np.arange(size)
        gold_score = sum(emit[t, rows, gold[t]] for t in range(steps))
        gold_score = gold_score + sum(trans[gold[t - 1], gold[t]] for t in range(1, steps))
        loss = float((norm - gold_score).mean())

        d_emit = np.exp(alpha + beta - norm[None, :, None])
        d_trans = np.zeros_like(trans)
        for t in range(1, steps):
            pair = alpha[t - 1][:, :, None] + trans[None] + (emit[t] + beta[t])[:, None, :] - norm[:, None, None]
            d_trans += np.exp(pair).sum(axis=0)
            np.add.at(d_trans, (gold[t - 1], gold[t]), -1)
        for t in range(steps):
            d_emit[t, rows, gold[t]] -= 1
        d_emit, d_trans = (d_emit / size).astype(np.float32), d_trans / size

        flat_h, flat_d = h.reshape(-1, 2 * HIDDEN), d_emit.reshape(-1, TAGS)
        grads = {"out": flat_h.T @ flat_d, "bias": flat_d.sum(axis=0), "trans": d_trans.astype(np.float32)}
        d_h = d_emit @ w["out"].T
        d_x = np.zeros_like(x)
        for way, kept, part in (("f", kf, d_h[:, :, :HIDDEN]), ("b", kb, d_h[:, :, HIDDEN:])):
            rec = w[f"{way}_rec"]
            d_in = np.zeros_like(w[f"{way}_in"])
            d_rec, d_bias = np.zeros_like(rec), np.zeros_like(w[f"{way}_bias"])
            dh, dc = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g, squashed in reversed(kept):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate(
                    [dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1
                )
                d_rec += h0.T @ dz
                d_in += x[t].T @ dz
                d_bias += dz.sum(axis=0)
                d_x[t] += dz @ w[f"{way}_in"].T
                dh, dc = dz @ rec.T, dc * f
            grads |= {f"{way}_in": d_in, f"{way}_rec": d_rec, f"{way}_bias": d_bias}
        d_embed = np.zeros_like(w["embed"])
        np.add.at(d_embed, codes.T.reshape(-1), d_x.reshape(-1, EMBED))
        return loss, grads | {"embed": d_embed}


def train(codes: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = SEED, rate: float = 0.02) -> Tagger:
    """Adam on random windows, with a falling rate."""
    tagger, rng = Tagger.fresh(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    power = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(codes), STEP_WINDOWS)
        _, grads = tagger.gradients(codes[pick], tags[pick])
        scale = min(1.0, 5.0 / max(1e-6, float(np.sqrt(sum((g**2).sum() for g in grads.values())))))
        now = rate * (1 - step / (steps + 1)) ** 0.5
        for k, g in grads.items():
            g = g * scale
            mean[k] = 0.9 * mean[k] + 0.1 * g
            power[k] = 0.99 * power[k] + 0.01 * g * g
            tagger.weights[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(power[k] / (1 - 0.99**step)) + 1e-7)
    return tagger


# --- labelled windows


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9)))


def planted(rng: random.Random) -> tuple[str, str | None]:
    """A span to plant and its kind; None for look-alikes that are no personal data."""
    n, name = lambda k: _number(rng, k), lambda: _name(rng)
    kind = rng.choice([*KINDS, "phone", "email", None, None])
    if kind == "email":
        user, host, end = f"{name()}{rng.choice(['', '.' + name(), n(2)])}", name(), rng.choice(["com", "org", "net", "de"])
        if rng.random() < 0.5:
            return f"{user}@{host}.{end}", kind
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" [at] ", "."), ("(at)", "(dot)"), (" (at) ", ".")])
        return f"{user}{at}{host}{dot}{end}", kind
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4)), kind
    if kind == "card":
        digits = rng.choice("3456") + n(14)
        digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
        sep = rng.choice(["", " ", "-"])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4)), kind
    if kind == "phone":
        form = rng.choice(
            ["+{a} ({b}) {c}-{d}", "+{a} {b} {c} {d}", "({b}) {c}-{d}", "{b}-{c}-{d}", "{b}.{c}.{d}", "00{e} {b} {c} {d}"]
        )
        return form.format(a=rng.randint(1, 99), b=n(3), c=n(3), d=n(4), e=rng.randint(10, 99)), kind
    other = [
        n(rng.randint(1, 9)), f"{n(4)}-{n(2)}-{n(2)}", f"{n(1)}.{n(1)}", f"{n(2)}:{n(2)}", f"{n(3)},{n(3)}.{n(2)}", f"{n(1)}.{n(1)}.{n(2)}",
        "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40))), f"AKIA{n(2)}{name().upper()}{n(3)}", f"{n(4)} {n(4)}",
    ]
    return rng.choice(other), None


def labelled_windows(windows: Sequence[tuple[str, list[Span]]], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags: each window as it is, and each with a planted span in place of a stretch without one."""
    rng = random.Random(seed)
    texts: list[tuple[str, list[Span]]] = []
    for text, spans in windows or [("the quick brown fox. " * 4, [])] * 200:
        texts.append((text, spans))
        for _ in range(2):
            value, kind = planted(rng)
            at = rng.randint(0, max(0, WINDOW - min(len(value), WINDOW) - 1))
            around = re.sub("[0-9@]", "e", text)
            new = f"{around[:at]} {value}{rng.choice([' ', ' ', '. ', ', ', chr(10)])}{around[at:]}"
            own = [] if kind is None else [(at + 1, at + 1 + len(value), kind)]
            texts.append((new, own))
    codes = np.zeros((len(texts), WINDOW), np.uint8)
    tags = np.zeros((len(texts), WINDOW), np.int8)
    for i, (text, spans) in enumerate(texts):
        row = char_codes(text[:WINDOW])
        codes[i, : len(row)] = row
        tags[i] = labels_of(spans, 0, WINDOW)
    return codes, tags


def sample_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, list[Span]]]:
    """Windows of about ``sample_docs`` documents (by a hash of doc_id): around the first base spans, and a plain one."""
    rows = docs.count()
    if not rows:
        return []
    draw = F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = docs.filter(draw < min(1.0, sample_docs / rows)).select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in filter(None, batch.column(0).to_pylist()):
                spans = base_spans(text)
                rng = random.Random(len(text))
                starts = [s[0] - rng.randint(0, WINDOW // 2) for s in spans[:4]] + [rng.randint(0, len(text))]
                for a in (max(0, x) for x in starts):
                    near = [(s - a, e - a, k) for s, e, k in spans if s < a + WINDOW and e > a]
                    out.append((text[a : a + WINDOW], listed(near)))
            text, near = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(near, pa.string())], names=["text", "near"])

    # Ordered by a hash, so that those within the bound are drawn from windows of every beginning and script.
    order = [F.xxhash64(F.lit("window"), "text", "near"), "text", "near"]
    found = sample.mapInArrow(run, "text string, near string").distinct().orderBy(*order).limit(SAMPLE_WINDOWS)
    parsed = []
    for r in found.collect():
        spans = [p.split(":") for p in r.near.split(",") if p]
        parsed.append((r.text, [(int(a), int(b), k) for k, a, b in spans]))
    return parsed


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Tagger:
    """A tagger trained on labelled windows of a bounded sample; without documents, on planted spans alone."""
    return train(*labelled_windows(sample_windows(docs, sample_docs)))


# --- whole texts

_SPELT = re.compile(r"[A-Za-z0-9._%+-]+\s?[(\[{]\s?at\s?[)\]}]\s?[A-Za-z0-9-]+(?:\s?(?:[(\[{]\s?dot\s?[)\]}]|\.)\s?[A-Za-z0-9-]+)+", re.I)
_DIALLED = re.compile(r"\(?[0-9][0-9 ().-]*[0-9]")


def _accepted(text: str, start: int, end: int, kind: str) -> bool:
    """The exact check of a span that the model adds."""
    value = text[start:end]
    if start and text[start - 1].isalnum() and value[0].isalnum():
        return False
    if end < len(text) and text[end].isalnum() and value[-1].isalnum():
        return False
    if kind == "email":
        return bool(_SPELT.fullmatch(value))
    digits = _NOT_DIGIT.sub("", value)
    if kind == "phone":
        parts = re.findall("[0-9]+", value)
        return bool(_DIALLED.fullmatch(value)) and 10 <= len(digits) <= 15 and 3 <= len(parts) <= 6 and max(map(len, parts)) <= 8
    return False  # the base rules find every ip and card that their checks accept


def windows_of(text: str) -> list[tuple[int, int]]:
    """Start of each window, and the place up to which its labels count; windows cover all triggers' surroundings."""
    out: list[tuple[int, int]] = []
    zones: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if zones and lo <= zones[-1][1]:
            zones[-1][1] = hi
        else:
            zones.append([lo, hi])
    for lo, hi in zones:
        at = lo
        while True:
            last = at + WINDOW >= hi
            out.append((at, hi if last else at + (WINDOW + STRIDE) // 2))
            if last:
                break
            at += STRIDE
    return out


def model_spans(tagger: Tagger, texts: Sequence[str]) -> list[list[Span]]:
    """What the model finds in whole texts, after reconciling windows and the exact check."""
    found: list[list[Span]] = [[] for _ in texts]
    pending: list[tuple[int, int, int]] = []  # text, window, labels up to
    tags: dict[int, list[tuple[int, np.ndarray]]] = {}

    def decode() -> None:
        codes = np.zeros((len(pending), WINDOW), np.uint8)
        for r, (i, at, _) in enumerate(pending):
            row = char_codes(texts[i][at : at + WINDOW])
            codes[r, : len(row)] = row
        for (i, at, upto), got in zip(pending, tagger.decode(codes)):
            parts = tags.setdefault(i, [])
            # The window before has decided up to its own bound, if the two overlap.
            begin = max(at, parts[-1][0] + len(parts[-1][1])) if parts else at
            parts.append((begin, got[begin - at : upto - at]))
        pending.clear()

    for i, text in enumerate(texts):
        for at, upto in windows_of(text):
            pending.append((i, at, upto))
            if len(pending) == BATCH:
                decode()
    if pending:
        decode()
    for i, parts in tags.items():
        found[i] = [s for s in _read(parts) if _accepted(texts[i], *s)]
    return found


def _read(parts: Sequence[tuple[int, np.ndarray]]) -> Iterator[Span]:
    """Spans from labels that follow each other, across windows."""
    start, kind, place = 0, -1, -1
    for begin, tags in parts:
        if begin != place and kind >= 0:
            yield start, place, KINDS[kind]
            kind = -1
        for at, tag in enumerate(tags.tolist(), begin):
            k = (tag - 1) // 2 if tag else -1
            if kind >= 0 and (k != kind or tag % 2):
                yield start, at, KINDS[kind]
                kind = -1
            if k >= 0 and kind < 0:
                start, kind = at, k
        place = begin + len(tags)
    if kind >= 0:
        yield start, place, KINDS[kind]


def all_spans(base: Sequence[Span], added: Sequence[Span]) -> list[Span]:
    """Base spans, and those of the model that touch none of them."""
    extra = [s for s in added if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
    return sorted([*base, *extra], key=lambda s: (s[0], KINDS.index(s[2])))


def spans_of(texts: Sequence[str | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base and all spans of each text."""
    base = [base_spans(t) for t in texts]
    added = model_spans(tagger, [t or "" for t in texts])
    return [(b, all_spans(b, a)) for b, a in zip(base, added)]


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, base and spans (``kind:start:end`` by start, comma-joined; code points) of every row.

    Null and empty texts have none. Repeated rows repeat. Spans of different kinds may overlap in the base.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tagger)

    def rows(batch: pa.RecordBatch):
        found = spans_of(_texts(batch), shipped.value)
        return [listed(b) for b, _ in found], [listed(a) for _, a in found]

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(source, rows, "base string, spans string", ["doc_id"])


def redacted(text: str, spans: Sequence[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with all spans replaced in ``text``; null stays null, and all rows and columns stay."""
    shipped = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.toDF(*[names.get(c, c) for c in docs.columns])

    def rows(batch: pa.RecordBatch):
        texts = _texts(batch)
        found = spans_of(texts, shipped.value)
        return ([t if t is None else redacted(t, s) for t, (_, s) in zip(texts, found)],)

    out = map_batches(renamed, rows, "clean string", [c for c in renamed.columns if c != "text"])
    return out.select(*[F.col("clean" if c == "text" else names[c]).alias(c) for c in docs.columns])


def op7_pii(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``find``."""
    found = find(docs, fit(docs))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")

