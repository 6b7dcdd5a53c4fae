"""Licence scans: a generalised suffix automaton of licence tokens, matching statistics, chained matches.

The token sequences of all templates share one automaton; each state knows where its strings end in the
templates. A text is streamed through it once; at each word the automaton holds the longest string ending
there that some template has, and through its links the longest one of each template. Where a template can't
lengthen its own, a match of at least LEAST words is recorded with its places there. Matches that advance in both
text and template, at most GAP words apart, are chained; a chain's covered template words over the template's
length are its coverage. A chain that covers ``least_coverage`` of its template, and has the words that set it
apart, gives its label, unless one that covers more words stands in the same place.

Base phrases are counted wherever their words stand consecutively.

Words: ASCII letters lower-cased; digits, letters and all characters beyond ASCII make words.

Defined results: null and empty texts have no words and no labels (empty strings). A repeated row is scanned
again. Rows with null doc_id are scanned like any other. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import ALNUM, coded, parts, words

# The phrases of the contract, and wordings by which licences are granted.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: label, wording, and the words one of which a text must have in the place of the match, so that versions and kinds
#: of one licence are told apart.
TEMPLATES = [
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "fee"),
    ("apache-2", "licensed under the apache license version 2 0", "version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "license 2"),
    ("apache-1", "licensed under the apache license version 1 0", "version 1"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "noncommercial sharealike"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "noncommercial noderivatives"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "attribution noderivatives"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution 4"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "version 2"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "version 2"),
    ("lgpl-3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu lesser"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "license 2"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
]
LEAST, GAP = 3, 12


class Automaton:
    """Suffix automaton of several token sequences. ends[state]: (template, past the last token) of its strings."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, tokens in enumerate(sequences):
            last = 0
            for place, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, token: int) -> int:
        """The state of p's string and token: the next one itself, or a copy of it that is just as long."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = self._split(p, token) if p >= 0 else 0
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each place: the state and the length of the longest known string that ends there."""
        state, length = 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                state, length = 0, 0
            yield state, length


def chains(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(covered template words, first text word, past the last) of the best chain ending in each match.

    matches: (text start, text end, template start, template end) of one template, by text end. Looks back
    only as far as GAP allows, so time is in proportion to the matches of GAP words.
    """
    best: list[tuple[int, int, int]] = []
    for i, (a, b, c, d) in enumerate(matches):
        found, j = (d - c, a, b), i - 1
        while j >= 0 and matches[j][1] >= a - GAP:
            _, b0, _, d0 = matches[j]
            over = max(0, d0 - c, b0 - a)
            if d0 < d and b0 < b and c - d0 <= GAP and over < d - c:
                found = max(found, (best[j][0] + d - c - over, best[j][1], b))
            j -= 1
        best.append(found)
    return best


class Scanner:
    def __init__(self, least_coverage: float = 0.7) -> None:
        self.least_coverage = least_coverage
        own = sorted({w for text in [*BASE, *(t for _, t, _ in TEMPLATES)] for w in text.split()})
        self.number = {w: i for i, w in enumerate(own)}
        self.templates = [[self.number[w] for w in text.split()] for _, text, _ in TEMPLATES]
        self.needs = [[self.number[w] for w in needs.split()] for _, _, needs in TEMPLATES]
        self.automaton = Automaton(self.templates)
        self.known: dict[int, dict[tuple[int, int], int]] = {}
        self.base = [([self.number[w] for w in text.split()], label) for text, label in BASE.items()]

    def reached(self, state: int) -> dict[tuple[int, int], int]:
        """(template, past): the length of the longest suffix of the state's string that ends there; at least LEAST."""
        if state not in self.known:
            found: dict[tuple[int, int], int] = {}
            q = state
            while q > 0 and self.automaton.length[q] >= LEAST:
                for end in self.automaton.ends[q]:
                    found.setdefault(end, self.automaton.length[q])
                q = self.automaton.link[q]
            self.known[state] = found
        return self.known[state]

    def spans(self, ids: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(label, coverage, first word, past the last) of templates found in one text. ids: -1 for other words.

        A match counts where its own template can't lengthen it, whatever others can. Of templates that are found in
        the same place the one with most words covered gives its label.
        """
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        per: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, stop in known.reshape(-1, 2):
            if stop - start < LEAST:
                continue
            before: dict[tuple[int, int], int] = {}
            for i, (state, length) in enumerate([*self.automaton.statistics(ids[start:stop].tolist()), (0, 0)]):
                now = {end: min(size, length) for end, size in self.reached(state).items()}
                for (template, past), size in before.items():
                    if (template, past + 1) not in now:
                        end = int(start) + i
                        per.setdefault(template, []).append((end - size, end, past - size, past))
                before = now
        found = []
        for template, matches in per.items():
            needs, size = self.needs[template], len(self.templates[template])
            for covered, first, past in chains(sorted(matches, key=lambda m: (m[1], m[3]))):
                own = ids[first:past].tolist()
                if covered >= self.least_coverage * size and any(own[k : k + len(needs)] == needs for k in range(len(own))):
                    found.append((covered, TEMPLATES[template][0], min(1.0, covered / size), first, past))
        kept: list[tuple[int, str, float, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[0], -x[2], x[3], x[4], x[1])):
            if all(x[4] <= y[3] or y[4] <= x[3] for y in kept):
                kept.append(x)
        return sorted(x[1:] for x in kept)

    def scan(self, texts: pa.Array) -> pa.RecordBatch:
        bounds, flat = words(texts, ALNUM)
        codes, names = coded(flat)
        ids = np.array([self.number.get(w, -1) for w in names], np.int32)[codes] if names else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        places: list[list[tuple[int, str]]] = [[] for _ in range(len(texts))]
        for phrase, label in self.base:
            n = len(phrase)
            if len(ids) < n:
                continue
            hit = owner[: len(owner) - n + 1] == owner[n - 1 :]
            for k, w in enumerate(phrase):
                hit &= ids[k : len(ids) - n + 1 + k] == w
            for p in np.flatnonzero(hit):
                places[owner[p]].append((int(p - bounds[owner[p]]), label))
        rare = ids >= 0
        # documents with LEAST known words in a row
        run = rare[:-2] & rare[1:-1] & rare[2:] & (owner[:-2] == owner[2:]) if len(rare) > 2 else np.zeros(0, bool)
        live = set(owner[:-2][run].tolist()) if len(run) else set()
        spans = [self.spans(ids[bounds[i] : bounds[i + 1]]) if i in live else [] for i in range(len(texts))]
        starts = [[p for p, _ in x] for x in places]
        columns = {
            "n_words": pa.array(np.diff(bounds), pa.int64()),
            "n_base": pa.array([len(x) for x in places], pa.int64()),
            "first_word": pa.array([min(x, default=None) for x in starts], pa.int64()),
            "last_word": pa.array([max(x, default=None) for x in starts], pa.int64()),
            "base_labels": pa.array([",".join(sorted({y for _, y in x})) for x in places], pa.string()),
            "labels": pa.array([",".join(sorted({y for _, y in x} | {s[0] for s in z})) for x, z in zip(places, spans, strict=True)], pa.string()),
            "score": pa.array([max([float(bool(x)), *(s[1] for s in z)]) for x, z in zip(places, spans, strict=True)], pa.float64()),
            "spans": pa.array([[dict(zip(("label", "coverage", "first", "past"), s, strict=True)) for s in z] for z in spans], SPANS),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


SPANS = pa.list_(pa.struct([("label", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("past", pa.int64())]))


def licence_scan(docs: DataFrame, least_coverage: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(least_coverage)
        for batch in parts(batches, 1):
            found = scanner.scan(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], ["doc_id", *found.schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, coverage: double, first: long, past: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
