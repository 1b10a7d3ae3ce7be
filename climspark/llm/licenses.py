"""Licence scans by a generalised suffix automaton over the words of licence templates.

Every text is streamed once through the automaton, which yields matching statistics: after each word, the longest run of
words ending there that occurs in some template. Runs that cannot grow and are long enough are anchors; anchors that
follow each other in the text and in one template, with small gaps, are chained into a span of that template. A
template whose words are covered well enough gives its label.

The base phrases are templates too: a phrase ends at a word exactly if the state reached there, or one on its chain of
suffix links, is the phrase's own state.

Only the templates (a bounded list, a parameter) travel; each document is judged by itself, so nothing is shuffled.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climspark.llm.common import alnum_words, map_batches

# The contract's phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of well-known public licences, by label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
     "work"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
)

# Words of an anchor (or the whole template, if shorter), words that a chain may skip, and the share of a template's
# words that a span must cover for its label.
MIN_ANCHOR = 4
MAX_GAP = 12
MIN_COVER = 0.6


@dataclass(frozen=True)
class Span:
    """A stretch of words [start, end) that covers a share of a template."""

    template: int
    start: int
    end: int
    cover: float


class SuffixAutomaton:
    """All runs of words of several sequences; state 0 is the empty run."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        # (sequence, index of the last word) of the places at which a state's own run was appended.
        self.places: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.next) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, number: int, words: Sequence[int]) -> int:
        """Appends a sequence; the state of the whole of it."""
        at = 0
        for place, word in enumerate(words):
            q = self.next[at].get(word)
            if q is not None:  # an earlier sequence has this run
                at = q if self.length[q] == self.length[at] + 1 else self._clone(at, word, q)
            else:
                new, p = self._state(self.length[at] + 1, 0, {}), at
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
                at = new
            self.places[at].append((number, place))
        return at

    def close(self) -> None:
        """Hands places up the suffix links, longest runs first."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                up = self.places[self.link[state]]
                up.extend(set(self.places[state]).difference(up))


class Scanner:
    """The automaton of a list of templates and base phrases, and what it says about a text."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, base: Mapping[str, str] = BASE):
        self.numbers: dict[bytes, int] = {}
        self.labels = [label for label, _ in templates]
        self.automaton = SuffixAutomaton()
        self.sizes = []
        for k, (_, text) in enumerate(templates):
            words = self._words(text)
            self.sizes.append(len(words))
            self.automaton.add(k, words)
        self.base_labels = list(base.values())
        self.base_sizes = []
        for k, phrase in enumerate(base):
            words = self._words(phrase)
            self.base_sizes.append(len(words))
            self.automaton.add(-1 - k, words)
        # Cloning may have moved a phrase to another state, so it is looked up in the finished automaton.
        self.automaton.close()
        self._phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.automaton.next)
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, phrase in enumerate(base):
            state = 0
            for word in self._words(phrase):
                state = self.automaton.next[state][word]
            own[state].append((k, self.base_sizes[k]))
        for state in sorted(range(1, len(self.automaton.next)), key=self.automaton.length.__getitem__):
            self._phrases[state] = (*own.get(state, ()), *self._phrases[self.automaton.link[state]])

    def _words(self, text: str) -> list[int]:
        return [self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(text)]

    def statistics(self, words: Sequence[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Base places (start, phrase), and runs that cannot grow (end, length, state).

        A run cannot grow if the next word does not lengthen it, and no longer run ended at its last word."""
        auto = self.automaton
        next_, link, length, phrases = auto.next, auto.link, auto.length, self._phrases
        base: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []
        state = size = 0
        for i, word in enumerate(words):
            if not word:
                if size:
                    runs.append((i, size, state))
                    state = size = 0
                continue
            to = next_[state].get(word)
            if to is None:
                if size:
                    runs.append((i, size, state))
                while state and to is None:
                    state = link[state]
                    to = next_[state].get(word)
                size = length[state]
            state, size = to, size + 1
            for phrase, n in phrases[state]:
                if n <= size:
                    base.append((i + 1 - n, phrase))
        if size:
            runs.append((len(words), size, state))
        return base, runs

    def spans(self, runs: Sequence[tuple[int, int, int]]) -> list[Span]:
        """For each template its chains of anchors that keep clear of a heavier one; the heaviest comes first."""
        anchors: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # text end, template end, words
        for end, size, state in runs:
            for template, last in self.automaton.places[state]:
                if template >= 0 and size >= min(MIN_ANCHOR, self.sizes[template]):
                    anchors[template].append((end, last + 1, size))
        return [span for t, found in sorted(anchors.items()) for span in self._chains(t, found)]

    def _chains(self, template: int, found: list[tuple[int, int, int]]) -> list[Span]:
        """The heaviest chain, and every further one that covers ``MIN_COVER`` of the template and overlaps none that
        is heavier. Anchors of a chain move on in text and template by ``MAX_GAP`` words at most."""
        found.sort()
        covered, start, first = [], [], 0
        for i, (end, last, size) in enumerate(found):
            covered.append(size)
            start.append(end - size)
            linked = False
            # Chains only join within a gap, so the window of earlier anchors is short.
            while found[first][0] < end - size - MAX_GAP:
                first += 1
            for j in range(first, i):
                gone, at, _ = found[j]
                # Words that two anchors share count once.
                shared = max(0, gone - (end - size), at - (last - size))
                if gone < end and at < last and last - size - at <= MAX_GAP and shared < size:
                    total = covered[j] + size - shared
                    # Of equal chains the one that begins later is shorter, and leaves the copy before it alone.
                    if total > covered[i] or (linked and total == covered[i] and start[j] > start[i]):
                        covered[i], start[i], linked = total, start[j], True
        ends = sorted(range(len(found)), key=lambda i: (-covered[i], found[i][0], -start[i]))
        taken: list[tuple[int, int]] = []  # disjoint, ascending
        out = []
        for i in ends:
            if out and covered[i] < MIN_COVER * self.sizes[template]:
                break
            span = (start[i], found[i][0])
            at = bisect.bisect_left(taken, (span[1], 0))
            if at and taken[at - 1][1] > span[0]:
                continue
            taken.insert(at, span)
            out.append(Span(template, *span, covered[i] / self.sizes[template]))
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[Span]]:
        """Number of words, base places (start, phrase) and template spans."""
        words = alnum_words(text)
        number = self.numbers.get
        base, runs = self.statistics([number(w, 0) for w in words])
        return len(words), base, self.spans(runs)


_scanners: dict[tuple, Scanner] = {}


def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    if templates not in _scanners:
        _scanners[templates] = Scanner(templates)
    return _scanners[templates]


_RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,end:long,cover:double>>"
)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: words, base places and labels, the method's labels, score and template spans (in words).

    The score is the largest share of a template that a span covers, 1 where a base phrase stands. A null or empty
    text has no words, no places, empty labels and score 0. Repeated rows repeat. A notice that stands more than once
    has a span for each place.
    """

    def rows(batch: pa.RecordBatch):
        scanner = _scanner(templates)
        out = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            n, base, spans = scanner.scan(text)
            starts = [s for s, _ in base]
            own = {scanner.base_labels[k] for _, k in base}
            good = [s for s in spans if s.cover >= MIN_COVER]
            labels = own | {scanner.labels[s.template] for s in good}
            score = 1.0 if base else min(1.0, max((s.cover for s in spans), default=0.0))
            listed = [
                {"label": scanner.labels[s.template], "start": s.start, "end": s.end, "cover": s.cover} for s in sorted(good, key=lambda s: (s.template, s.start))
            ]
            first, last = (min(starts), max(starts)) if starts else (None, None)
            out.append((n, len(base), first, last, ",".join(sorted(own)), ",".join(sorted(labels)), score, listed))
        return list(zip(*out)) if out else [[]] * 8

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(source, rows, _RESULT, ["doc_id"])


def op1_licenses(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``."""
    return scan(docs).drop("spans")
