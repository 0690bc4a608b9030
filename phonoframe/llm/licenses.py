"""License scans: MinHash bands over overlapping windows of words fetch templates, exact containment decides."""

from __future__ import annotations

import collections
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, whole

WORDS, CONTAINMENT = 5, 0.8
#: One MinHash value a band. A window is at most four times its template, so that the two share at least
#: 0.8 / (4 + 0.2) of their shingles where the template is contained: 48 bands miss it once in 20,000 times.
BANDS = 48
#: Shingles looked at together.
PART = 1 << 13
_WORD = re.compile(rb"[a-z0-9]+")
#: Notices and opening paragraphs of common licenses, as their publishers word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "mit-line": "Released under the MIT License",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "all-rights-line": "All rights reserved. No part of this publication may be reproduced",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


@lru_cache(maxsize=200_000)
def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; of all words where there are fewer, none for no word."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_word_hash(w) for w in words], np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(size, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Scanner:
    """Templates by the size of their windows and by each MinHash value."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS, containment: float = CONTAINMENT):
        rng = np.random.default_rng(5)
        self.times, self.plus = (rng.integers(0, 2**63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        self.containment = containment
        self.sets = {name: np.unique(shingles(words_of(t))) for name, t in sorted(templates.items())}
        self.by_window: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: by the low 16 bits of a value: whether any template may have it
        self.likely: dict[int, np.ndarray] = {}
        sized: dict[int, list[str]] = {}
        for name, s in self.sets.items():
            sized.setdefault(1 << max(1, int(np.ceil(np.log2(2 * len(s))))), []).append(name)
        self.size = {name: size for size, names in sized.items() for name in names}
        #: by license and shingle: its places in the template
        self.order: dict[str, dict[int, list[int]]] = {name: {} for name in self.sets}
        for name in self.sets:
            for i, x in enumerate(shingles(words_of(templates[name])).tolist()):
                self.order[name].setdefault(x, []).append(i)
        self.names = sorted(self.sets)
        for size, names in sorted(sized.items()):
            values = np.concatenate([self.permuted(self.sets[n]).min(axis=1) for n in names])
            owner = np.repeat([self.names.index(n) for n in names], bands)
            order = np.argsort(values, kind="stable")
            self.by_window[size] = values[order], owner[order]
            self.likely[size] = np.zeros(1 << 16, bool)
            self.likely[size][values.astype(np.uint16)] = True

    def permuted(self, s: np.ndarray) -> np.ndarray:
        x = s[None, :] * self.times[:, None] + self.plus[:, None]
        return x ^ (x >> np.uint64(29))

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """For each text (license, first word, words, containment) of each place, in order of license and place.

        The texts' shingles are looked at in a row; a window over the end of a text counts for both sides.
        """
        words = [words_of(t) for t in texts]
        each = [shingles(w) for w in words]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(int)
        s = np.concatenate([*each, np.zeros(0, np.uint64)])
        hits: list[dict[str, set[tuple[int, int]]]] = [{} for _ in texts]
        for base in range(0, len(s), PART):  # in overlapping parts that fit the cache
            for name, a, b in self._part(s, base, min(len(s), base + PART + 2 * max(self.by_window))):
                for i in range(int(np.searchsorted(edges, a, side="right")) - 1, int(np.searchsorted(edges, b))):
                    lo, hi = max(a, edges[i]) - edges[i], min(b, edges[i + 1]) - edges[i]
                    if lo < hi:
                        hits[i].setdefault(name, set()).add((lo, hi))
        return [[x for name in sorted(h) for x in self._places(name, h[name], e, len(w))] for h, e, w in zip(hits, each, words, strict=True)]

    def _places(self, name: str, windows: set[tuple[int, int]], s: np.ndarray, n_words: int) -> Iterator[tuple[str, int, int, float]]:
        """Places apart from each other; the search in a window goes on behind the last place found."""
        template, size, found, end = self.sets[name], self.size[name], [], 0
        for a, b in sorted(windows):
            while (a := max(a, end)) < b:
                lo = max(end, a - size)
                at = lo + np.flatnonzero(np.isin(s[lo : b + size], template))
                inside = at[(at >= a) & (at < b)]
                if len(np.unique(s[inside])) / len(template) < self.containment:
                    break
                found.append(self._stretch(name, at, s[at].tolist(), a))
                end = found[-1][1] + 1
        for (first, last), (stop, _) in itertools.pairwise([*found, (len(s), 0)]):
            ahead = np.arange(last + 1, min(stop, first + size))
            new = ahead[np.isin(s[ahead], template) & ~np.isin(s[ahead], s[first : last + 1])]
            for q in new.tolist():  # what stands in another order than in the template
                if q - last > WORDS + len(template) // 2:
                    break
                last = q
            share = len(np.intersect1d(s[first : last + 1], template)) / len(template)
            yield name, first, min(last + WORDS, n_words) - first, share

    def _stretch(self, name: str, at: np.ndarray, values: list[int], start: int) -> tuple[int, int]:
        """(first, last shingle) of the first place from ``start`` on; ``at`` has the shingles that are the template's.

        The shortest stretch to the first end where the containment is reached goes on as long as the template's order does.
        """
        order, seen = self.order[name], collections.Counter()
        left = right = int(np.searchsorted(at, start))

        def shorten(left: int) -> int:
            while seen[values[left]] > len(order[values[left]]):
                seen[values[left]] -= 1
                left += 1
            return left

        while True:
            seen[values[right]] += 1
            if len(seen) / len(order) >= self.containment:
                break
            right += 1
        left, here = shorten(left), -1
        for v in values[left : right + 1]:
            here = next((p for p in order[v] if p > here), order[v][0])
        while right + 1 < len(at) and at[right + 1] - at[left] < self.size[name]:
            here = next((p for p in order[values[right + 1]] if p > here), -1)
            if here < 0:
                break
            right += 1
            seen[values[right]] += 1
            left = shorten(left)
        here = order[values[left]][0]
        while left > 0 and at[right] - at[left - 1] < self.size[name]:
            before = [p for p in order[values[left - 1]] if p < here]
            if not before or at[left] - at[left - 1] > here - before[-1] + 2 * WORDS:
                break
            left, here = left - 1, before[-1]
        return int(at[left]), int(at[right])

    def _part(self, s: np.ndarray, start: int, stop: int) -> Iterator[tuple[str, int, int]]:
        """(license, from, to) of windows that share a MinHash value with it."""
        lows, width = self.permuted(s[start:stop]), 1
        for size, (values, owner) in self.by_window.items():
            half = size // 2
            while width < half:
                if lows.shape[1] % 2:
                    lows = np.hstack([lows, lows[:, -1:]])
                lows, width = np.minimum(lows[:, ::2], lows[:, 1::2]), width * 2
            windows = np.hstack([np.minimum(lows[:, :-1], lows[:, 1:]), lows[:, -1:]])
            band, place = np.nonzero(self.likely[size][windows.astype(np.uint16)])
            low = windows[band, place]
            at = np.minimum(np.searchsorted(values, low), len(values) - 1)
            for w in np.unique(place[values[at] == low]):
                seen = np.unique(windows[:, w])
                lo, hi = np.searchsorted(values, seen), np.searchsorted(values, seen, side="right")
                a = start + int(w) * half
                for i in {int(o) for x, y in zip(lo, hi, strict=True) for o in owner[x:y]}:
                    yield self.names[i], a, min(a + size, len(s))


#: Bytes of templates that may go to every task.
MOST_TEMPLATES = 8 << 20


def templates_from(table: DataFrame, name: str = "license", text: str = "text") -> dict[str, str]:
    """The templates of a caller's table, for ``scan_licenses``: every row is one, several of a license are named license, license#2 and so on, by their texts' order.

    Rows without a name or a word are refused, as nothing could be found by them; repeated rows count once. Their size is asked for before they are read.
    """
    rows = table.select(F.col(name).alias("name"), F.col(text).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_TEMPLATES:
        raise ValueError(f"templates of {size} bytes in all can't go to every task")
    out: dict[str, str] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["name"] or "", r["text"] or "")):
        if not r["name"] or not words_of(r["text"] or ""):
            raise ValueError(f"a template needs a name and words: {r['name']}")
        k = 1 + sum(n == r["name"] or n.startswith(r["name"] + "#") for n in out)
        out[r["name"] if k == 1 else f"{r['name']}#{k}"] = r["text"]
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """(key, license, place, first_word, n_words, containment): every place of every row that holds a template.

    Words are runs of a-z and 0-9 after A-Z are lower-cased; a place holds a template if at least
    ``containment`` of its five-word shingles are there. Places of one license don't overlap; each is as short as
    it gets and goes on as far as the template's words do. ``place`` counts a row's places of one
    license from 0. Rows without one give no row, nor do null and empty texts. Rows that repeat
    are scanned each for itself; other columns are ignored. The templates are a list of the caller's and travel
    with the code.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(map(len, templates.values())) > MOST_TEMPLATES:
        raise ValueError("templates of over 8 MB in all can't go to every task")
    shared = docs.sparkSession.sparkContext.broadcast(templates)

    def start():
        scanner = Scanner(shared.value, bands, containment)

        def scanned(texts: list[str]) -> list[list[tuple]]:
            rows = []
            for found in scanner.scan(texts):
                seen: dict[str, int] = {}
                row = []
                for name, first, n, share in found:
                    row.append((name, seen.setdefault(name, 0), first, n, share))
                    seen[name] += 1
                rows.append(row)
            return rows

        return scanned

    of = over_texts("array<struct<license:string,place:int,first_word:int,n_words:int,containment:double>>", start)
    return docs.select(F.col(key), F.explode(of(whole(text))).alias("x")).select(key, "x.*")
