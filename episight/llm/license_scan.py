"""Licence scans with a generalised suffix automaton.

The automaton holds every run of words of all licence templates.  A document's
words are streamed through it; at each word it gives the longest run ending
there that some template contains (the matching statistics).  Long matches are
chained per template in order of both positions, and a template is found where
a chain covers enough of it.  Short phrases are templates too: a phrase ends
wherever its state is on the suffix path of the current state.

Words outside the templates, and pairs of words that no template has, end
every match of two or more words, so only the stretches between them are
streamed; that skips nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame

from .common import per_batch, texts

#: The base phrases and their labels.
PHRASES: Mapping[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Fixed values: (label, text) of notices as licensors publish them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: A-Z to a-z; what is in none of the words' classes to a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    r"""The words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text."""
    return raw.translate(WORD_TABLE).split()


class Automaton:
    """A generalised suffix automaton over sequences of word numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].append((k, i + 1))
        # where a state's runs end: its own places and those of all states below it on suffix paths
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] = sorted({*self.ends[self.link[v]], *self.ends[v]})

    def _new(self, size: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.size.append(size)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the longest run of p followed by c, taken out of q if q also has longer ones."""
        if self.size[q] == self.size[p] + 1:
            return q
        r = self._new(self.size[p] + 1, q)
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _extend(self, p: int, c: int) -> int:
        if c in self.next[p]:
            return self._split(p, self.next[p][c], c)
        v = self._new(self.size[p] + 1)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = v
            p = self.link[p]
        self.link[v] = 0 if p < 0 else self._split(p, self.next[p][c], c)
        return v

    def state(self, seq: list[int]) -> int:
        v = 0
        for c in seq:
            v = self.next[v][c]
        return v

    def stream(self, seq: list[int]):
        """(state, length of the longest match) after each word."""
        v = n = 0
        for c in seq:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.size[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            yield v, n


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = 4, max_gap: int = 12, min_cover: float = 0.6):
        seqs = [words_of(t.encode()) for _, t in templates] + [p.encode().split() for p in phrases]
        self.labels = [x for x, _ in templates]
        self.vocab: dict[bytes, int] = {}
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in s] for s in seqs]
        self.lengths = [len(s) for s in coded]
        self.auto = Automaton(coded)
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.unknown = k = len(self.vocab)
        # the pairs of words that templates or phrases have, as sorted numbers; whether a phrase starts with it
        pairs = {x * (k + 1) + y for s in coded for x, y in zip(s, s[1:])}
        starts = {s[0] * (k + 1) + s[1] for s in coded[len(templates) :] if len(s) > 1}
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)
        self.opens = np.array([x in starts for x in self.pairs.tolist()])
        self.single = {s[0]: label for s, label in zip(coded[len(templates) :], phrases.values()) if len(s) == 1}
        own = {self.auto.state(s): (len(s), label) for s, label in zip(coded[len(templates) :], phrases.values()) if len(s) > 1}
        self.phrases: list[list[tuple[int, str]]] = []  # by state: the phrases that end there
        for v in range(len(self.auto.size)):
            at, found = v, []
            while at > 0:
                if at in own:
                    found.append(own[at])
                at = self.auto.link[at]
            self.phrases.append(found)
        # by state: for each template the longest run that ends there and that it has, as a state on the suffix path
        self.reach: list[dict[int, int]] = []
        for v in range(len(self.auto.size)):
            at, found = v, {}
            while at > 0 and self.auto.size[at] >= min_match:
                for t, _ in self.auto.ends[at]:
                    if t < len(self.labels):
                        found.setdefault(t, at)
                at = self.auto.link[at]
            self.reach.append(found)

    def scan(self, raw: bytes) -> dict:
        words = words_of(raw)
        code = np.fromiter((self.vocab.get(w, self.unknown) for w in words), np.int64, len(words))
        number = code[:-1] * (self.unknown + 1) + code[1:]
        at = np.minimum(np.searchsorted(self.pairs, number), len(self.pairs) - 1)
        known = self.pairs[at] == number
        opens = known & self.opens[at]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known, [0]]).astype(np.int8)))
        places: list[tuple[int, str]] = [(int(i), label) for w, label in self.single.items() for i in np.flatnonzero(code == w)]
        matches: list[tuple[int, int, int, int]] = []  # template, end in the text, length, state
        size_of = self.auto.size
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a + 1 < self.min_match and not opens[a:b].any():
                continue
            last: dict[int, tuple[int, int]] = {}  # by template: length and state of its own longest match so far
            for i, (v, n) in enumerate(self.auto.stream(code[a : b + 1].tolist())):
                for size, label in self.phrases[v]:
                    if size <= n:
                        places.append((int(a) + i + 1 - size, label))
                now = {t: (min(n, size_of[u]), u) for t, u in self.reach[v].items() if n >= self.min_match}
                matches += [(t, int(a) + i, m, u) for t, (m, u) in last.items() if now.get(t, (0, 0))[0] != m + 1]
                last = now
            matches += [(t, int(b) + 1, m, u) for t, (m, u) in last.items()]
        spans = self.chain(matches)
        base = {x for _, x in places}
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places)[0] if places else None,
            "last_word": max(places)[0] if places else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s["label"] for s in spans})),
            "score": max([s["covered"] for s in spans], default=0.0),
            "spans": spans,
        }

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[dict]:
        """Matches in order of both positions, with bounded gaps, as covered spans of templates."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, end, n, v in matches:
            for t, at in self.auto.ends[v]:
                if t == k and at >= n:
                    by.setdefault(k, []).append((end - n, at - n, n))
        out = []
        for k, found in sorted(by.items()):
            open_: list[list] = []  # chains: text start, text end, template end, words covered
            for start, at, n in sorted(found):
                best = None
                for c in open_:
                    shared = max(0, c[1] - start, c[2] - at)  # overlap, counted once
                    if shared < n and start - c[1] <= self.max_gap and at - c[2] <= self.max_gap and start + n > c[1] and at + n > c[2] and (best is None or c[3] > best[0][3]):
                        best = (c, n - shared)
                if best:
                    c, more = best
                    c[1], c[2], c[3] = start + n, at + n, c[3] + more
                else:
                    open_.append([start, start + n, at + n, n])
            for c in open_:
                if (share := c[3] / self.lengths[k]) >= self.min_cover:
                    out.append({"label": self.labels[k], "template": k, "first_word": c[0], "end_word": c[1], "covered": min(1.0, share)})
        return out


SPANS = "array<struct<label:string,template:int,first_word:long,end_word:long,covered:double>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **scanner) -> DataFrame:
    """Scan every whole text for licence phrases and notices.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start, else null), base_labels,
    labels, score (the largest covered share of a template) and spans; one row
    for each row of ``docs``, without a shuffle.  A null text counts as empty
    (no words, no labels, score 0), a null id stays null, repeated rows come
    out each, an empty table gives an empty result, other columns are ignored.
    ``scanner``: templates, phrases, min_match, max_gap, min_cover.
    """

    def make():
        s = Scanner(**scanner)

        def work(ids: list, raw: list[bytes]) -> dict[str, list]:
            got = [s.scan(t) for t in raw]
            return {"doc_id": ids} | {k: [g[k] for g in got] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}

        return work

    return per_batch(texts(docs, id_col, text_col), make, SCHEMA)
