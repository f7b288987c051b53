"""Licence scan with a generalised suffix automaton over licence tokens.

The automaton of all templates is built once; texts stream through it. For each word
it gives the longest run of words ending there that some template contains (the
matching statistics). A place of a base phrase is a word at which that run ends with
the phrase. Runs that cannot be made longer and have ``MIN_RUN`` words or more are
matches; those of one template are chained, in order in text and template, and the
share of a template that a chain covers is the score. A template covered by
``MIN_COVER`` or more adds its label.

The automaton's size depends on the templates alone. Texts are read word by word in
whole; rows never meet.

Defined cases: null and empty texts have no words, places or labels and score 0;
repeated rows each get their row; an empty table gives none; columns that have an
output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsewide.llm.batches import add_columns, as_bytes, folded_words

# Phrases with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices of public licences, with the label each adds.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
     "of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
)

MIN_RUN = 3
MIN_COVER = 0.8
#: Words of other text between two matches of a chain.
MAX_GAP = 24


class Automaton:
    """Suffix automaton of several word sequences, with where each state ends."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.phrases = [(folded_words(p.encode()), label) for p, label in phrases]
        self.templates = [(folded_words(t.encode()), label) for label, t in templates]
        paths = []
        for words, _ in [*self.phrases, *self.templates]:
            last = 0
            for w in words:
                last = self._extend(last, w)
            paths.append(words)
        n = len(self.next)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        children: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            children[self.link[v]].append(v)
        for number, words in enumerate(paths[len(self.phrases):]):
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                self.ends[state].append((number, i + 1))
        order = sorted(range(1, n), key=lambda v: -self.length[v])
        for v in order:
            self.ends[self.link[v]].extend(self.ends[v])
        self.ends[0] = []
        self.phrase_at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for number, words in enumerate(paths[: len(self.phrases)]):
            state = 0
            for w in words:
                state = self.next[state][w]
            below = [state]
            while below:
                v = below.pop()
                self.phrase_at[v].append((len(words), number))
                below.extend(children[v])

    def _extend(self, last: int, w: bytes) -> int:
        known = self.next[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, w)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: bytes) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of phrases as (start, phrase), and maximal runs as (end, length, state)."""
        step, link, length, phrase_at = self.next, self.link, self.length, self.phrase_at
        root = step[0]
        state = size = 0
        places, runs = [], []
        for i, w in enumerate(words):
            if not state:
                if w in root:
                    state, size = root[w], 1
                    for n, number in phrase_at[state]:
                        if n == 1:
                            places.append((i, number))
                continue
            if w in step[state]:
                state = step[state][w]
                size += 1
            else:
                if size >= MIN_RUN:
                    runs.append((i, size, state))
                while state and w not in step[state]:
                    state = link[state]
                    size = length[state]
                if w in step[state]:
                    state = step[state][w]
                    size += 1
                else:
                    state = size = 0
            for n, number in phrase_at[state]:
                if n <= size:
                    places.append((i + 1 - n, number))
        if size >= MIN_RUN:
            runs.append((len(words), size, state))
        return places, runs

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[float, int, int, str]]:
        """Best covered share per label, as (cover, first word, end, label)."""
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in runs:
            for number, t_end in self.ends[state]:
                if t_end >= size:
                    anchors.setdefault(number, []).append((end, t_end, size))
        best: dict[str, tuple[float, int, int, str]] = {}
        for number, found in anchors.items():
            words, label = self.templates[number]
            recent: list[tuple[int, int, int, int]] = []  # end, template end, covered, first word
            for end, t_end, size in found:
                covered, first = size, end - size
                recent = [r for r in recent if end - size - r[0] <= MAX_GAP]
                for r_end, r_t_end, r_covered, r_first in recent:
                    overlap = max(0, r_end - (end - size), r_t_end - (t_end - size))
                    if r_end < end and r_t_end < t_end and overlap < size and r_covered + size - overlap > covered:
                        covered, first = r_covered + size - overlap, r_first
                recent.append((end, t_end, covered, first))
                cover = min(1.0, covered / len(words))
                if label not in best or cover > best[label][0]:
                    best[label] = (cover, first, end, label)
        return sorted(best.values())


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
_OUT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("cover", T.DoubleType())]))),
])


def scan_text(machine: Automaton, text: bytes | None) -> tuple:
    words = folded_words(text)
    places, runs = machine.scan(words)
    chains = machine.chains(runs) if runs else []
    starts = [p for p, _ in places]
    base = {machine.phrases[k][1] for _, k in places}
    covered = [(label, first, end, cover) for cover, first, end, label in chains if cover >= MIN_COVER]
    labels = base | {c[0] for c in covered}
    score = max([c[0] for c in chains], default=0.0)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(labels)), 1.0 if base else score,
        [{"label": a, "first": b, "end": c, "cover": d} for a, b, c, d in sorted(covered)],
    )


def scan_licenses(
    docs: DataFrame,
    *,
    text: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Documents with places of base phrases, labels, the largest covered share as
    ``score`` (1 with a base phrase) and the covered ``spans`` in words."""
    machine = docs.sparkSession.sparkContext.broadcast(Automaton(phrases, templates))

    def start():
        automaton = machine.value

        def work(columns):
            made = [scan_text(automaton, t) for t in as_bytes(columns[0])]
            columns_out = list(zip(*made)) if made else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]
            return [pa.array(c, k) for c, k in zip(columns_out, kinds)]

        return work

    return add_columns(docs, [text], _OUT, start, carry)
