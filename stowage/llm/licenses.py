"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits, lower-cased (ASCII); a template of T word shingles belongs to the window class
whose half is the least power of two that is at least T. Windows overlap by half, so an occurrence of T shingles lies
whole in one of them. If at least ``containment`` of a template is there, its Jaccard similarity with the window is at
least ``least_jaccard``; with one row a band and ``BANDS`` bands it is then retrieved with the probability that
``recall_bound`` gives: over 0.998 for every length. A candidate counts only if the words themselves agree. A
template of fewer than ``SHINGLE`` words is one shingle of its own words, looked for by its hash at every word.

Scale: one pass, no shuffle; a slice of a batch is held at a time; the templates are a list on the driver.

Defined results: one row per match (none for a null, empty or clean text); overlapping matches of one template in a
document are one row, that of the highest containment, then the shortest, then the first; a text or template of any length
is read whole; repeated rows are scanned each by itself; an empty table gives an empty result; a template without any
word is refused; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.bytewords import LOWER, shingle_hashes, word_hashes, words
from stowage.llm.common import batches, mapped

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32

#: Notices as their publishers word them. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License",
    "MIT (licensed)": "Licensed under the MIT License",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Starts and ends (bytes) of the words, and the words."""
    raw = text.encode()
    flat = LOWER[np.frombuffer(raw, np.uint8)]
    w = words(flat, np.array([0, len(flat)]), PUNCTUATION)
    low = flat.tobytes()
    return w.start, w.end, [low[a:b] for a, b in zip(w.start, w.end, strict=True)]


def shingles(said: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(said[i : i + SHINGLE]) for i in range(len(said) - SHINGLE + 1)]


def half_window(n: int) -> int:
    """Half a window, in shingles, for a template of n shingles."""
    return 1 << (n - 1).bit_length()


def least_jaccard(n: int, half: int, containment: float) -> float:
    """Of a template of n shingles and a window that has ``containment`` of them."""
    there = ceil(containment * n)
    return there / (2 * half + n - there)


def recall_bound(n: int, half: int, containment: float = CONTAINMENT, bands: int = BANDS) -> float:
    return 1 - (1 - least_jaccard(n, half, containment)) ** bands


class Scanner:
    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, bands: int = BANDS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 1 << 63, bands, dtype=np.uint64) | np.uint64(1)
        self.shifts = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        self.containment, self.names, self.sets, self.halves = containment, list(templates), [], []
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}  # words -> hash -> templates
        for k, text in enumerate(templates.values()):
            said = tokens(text)[2]
            if not said:
                raise ValueError(f"a template without a word: {text!r}")
            if len(said) < SHINGLE:
                self.sets.append({tuple(said): 0})
                self.halves.append(0)
                self.short.setdefault(len(said), {}).setdefault(int(self._hashes(text, len(said))[0]), []).append(k)
                continue
            self.sets.append({s: i for i, s in enumerate(dict.fromkeys(shingles(said)))})
            half = half_window(len(said) - SHINGLE + 1)
            self.halves.append(half)
            h = self._hashes(text)
            for band, least in enumerate(((h[:, None] * self.factors) + self.shifts).min(axis=0)):
                self.tables.setdefault(half, [{} for _ in range(bands)])[band].setdefault(int(least), []).append(k)
        self.filters = {}
        for half, tables in self.tables.items():
            bits = np.zeros((bands, 1 << 16), bool)
            for band, table in enumerate(tables):
                bits[band, [v >> 48 for v in table]] = True
            self.filters[half] = bits

    @staticmethod
    def _hashes(text: str, k: int = SHINGLE) -> np.ndarray:
        flat = LOWER[np.frombuffer(text.encode(), np.uint8)]
        return shingle_hashes(word_hashes(flat, words(flat, np.array([0, len(flat)]), PUNCTUATION)), k)

    def retrieve(self, flat: np.ndarray, at: np.ndarray) -> set[tuple[int, int, int]]:
        """(row, template, word of the row at which the window begins)."""
        low = LOWER[flat]
        w = words(low, at, PUNCTUATION)
        said, found = word_hashes(low, w), set()
        for k, table in self.short.items():
            every = shingle_hashes(said, k)
            for i in np.flatnonzero(np.isin(every, np.array(list(table), np.uint64))):
                if w.owner[i] == w.owner[i + k - 1]:
                    found |= {(int(w.owner[i]), template, int(i - w.first[w.owner[i]])) for template in table[int(every[i])]}
        if not self.tables:
            return found
        h = shingle_hashes(said, SHINGLE)
        place = np.flatnonzero(w.owner[: len(h)] == w.owner[SHINGLE - 1 :]) if len(h) else np.zeros(0, int)
        h, top = h[place], max(self.tables)
        whole = -(-len(h) // top) * top
        v = np.full(whole, np.iinfo(np.uint64).max)
        for band in range(len(self.factors)):
            np.multiply(h, self.factors[band], out=v[: len(h)])
            v[: len(h)] += self.shifts[band]
            mins, half = v, 1
            while half <= top:
                if half > 1:
                    mins = np.minimum(mins[0::2], mins[1::2])
                if half not in self.tables:
                    half *= 2
                    continue
                windows = mins.copy()
                np.minimum(windows[:-1], mins[1:], out=windows[:-1])
                for k in np.flatnonzero(self.filters[half][band][windows >> np.uint64(48)]):
                    for template in self.tables[half][band].get(int(windows[k]), ()):
                        # every document that the window touches
                        near = place[k * half : (k + 2) * half]
                        owners = w.owner[near]
                        for row in np.unique(owners):
                            found.add((int(row), template, int(near[owners == row][0] - w.first[row])))
                half *= 2
        return found

    def verify(self, text: str, candidates: list[tuple[int, int]]) -> list[tuple[int, float, int, int]]:
        """(template, containment, start, end in code points) for candidates (template, first word of a window)."""
        start, end, said = tokens(text)
        hits = []
        for k in sorted({t for t, _ in candidates}):
            want, half = self.sets[k], self.halves[k]
            if not half:  # fewer words than a shingle: the words as they are
                n = len(next(iter(want)))
                done = 0
                for i in sorted({f for t, f in candidates if t == k}):
                    if i >= done and tuple(said[i : i + n]) in want:
                        hits.append((k, 1.0, int(start[i]), int(end[i + n - 1])))
                        done = i + n
                continue
            reach = 2 * len(want)
            seen = set()
            for first in sorted({f for t, f in candidates if t == k}):
                a, b = max(0, first - half), min(len(said) - SHINGLE + 1, first + 3 * half)
                seen |= {i for i in range(a, b) if tuple(said[i : i + SHINGLE]) in want}
            spots, best = sorted(seen), []
            which = [want[tuple(said[i : i + SHINGLE])] for i in spots]
            times, different, until = [0] * len(want), 0, 0  # of the shingles at spots[n:until]
            for n, i in enumerate(spots):
                while until < len(spots) and spots[until] < i + reach:
                    different += not times[which[until]]
                    times[which[until]] += 1
                    until += 1
                if different / len(want) >= self.containment:
                    last, need = i, set()
                    for j, s in zip(spots[n:until], which[n:until], strict=True):
                        if s not in need:
                            need.add(s)
                            last = j
                    best.append((different / len(want), i, last))
                times[which[n]] -= 1
                different -= not times[which[n]]
            taken: list[tuple[int, int]] = []
            for c, i, j in sorted(best, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(j < a or i > b for a, b in taken):
                    taken.append((i, j + SHINGLE - 1))
                    hits.append((k, c, int(start[i]), int(end[j + SHINGLE - 1])))
        raw = text.encode()
        point = (lambda x: x) if len(raw) == len(text) else (lambda x: len(raw[:x].decode()))
        return sorted((k, c, point(a), point(b)) for k, c, a, b in hits)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """doc_id, license, containment, start, end (code points): one row per match."""
    scanner = Scanner(templates or TEMPLATES, containment, bands)

    def run(source):
        for batch, flat, at in batches(source, "text"):
            by_row: dict[int, list[tuple[int, int]]] = {}
            for row, template, first in scanner.retrieve(flat, at):
                by_row.setdefault(row, []).append((template, first))
            rows, found = [], []
            for row in sorted(by_row):
                for hit in scanner.verify(batch.column(1)[row].as_py(), by_row[row]):
                    rows.append(row)
                    found.append(hit)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([scanner.names[k] for k, *_ in found], pa.string()), pa.array([c for _, c, _, _ in found], pa.float64()), pa.array([a for *_, a, _ in found], pa.int64()), pa.array([b for *_, b in found], pa.int64())], names=["doc_id", "license", "containment", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"doc_id {kind}, license string, containment double, start long, end long")
