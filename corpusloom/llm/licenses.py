"""License scan: MinHash bands over overlapping text windows, verified by shingle containment.

Templates are sorted into classes by length (powers of two words). For a class of c words a text is read in windows of
2c words that overlap by half, so any occurrence of a template lies whole in some window and makes up at least a quarter
of its shingles. Each of BANDS bands is one MinHash value: a window that holds a share J of equal shingles meets the
template with probability 1 - (1 - J) ** BANDS, 0.9999 at J = 0.25 and 0.997 at J = 0.15. Retrieved pairs are verified
by the exact share of the template's shingles that the window holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import mix, sequences, text_words, word_blocks

SHINGLE = 3
BANDS = 32
CONTAINMENT = 0.8
TEMPLATE_WORDS = 200_000  # words of all templates together, at most: they go to every task

_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)

# Notices as their publishers word them.
TEMPLATES = [
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit-line", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def _class(n: int) -> int:
    """The least power of two, 8 at least, that is not below n words."""
    return max(8, 1 << (n - 1).bit_length())


def _signature(shingles: np.ndarray) -> np.ndarray:
    """One MinHash value a band, for one set."""
    return np.array([mix(shingles * s).min() for s in _SEEDS], np.uint64)


def _hits(shingles: np.ndarray, valid: np.ndarray, size: int, templates: list[np.ndarray]) -> set[tuple[int, int]]:
    """(window start, template) pairs that agree in a band; windows of 2 x size words step by size words."""
    steps = -(-len(shingles) // size)
    padded = np.full(steps * size, np.uint64(2**64 - 1))
    found: set[tuple[int, int]] = set()
    for band, seed in enumerate(_SEEDS):
        values = mix(shingles * seed)
        padded[:len(shingles)] = np.where(valid, values, np.uint64(2**64 - 1))
        least = padded.reshape(steps, size).min(axis=1)
        both = np.append(np.minimum(least[:-1], least[1:]), least[-1])
        for t, signature in enumerate(templates):
            found.update((int(k) * size, t) for k in np.flatnonzero(both == signature[band]))
    return found


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, start, n_words, containment): each place of a text that holds a template.

    `start` is the first word of the place and n_words its length. Places of one template that overlap are one. Null
    and empty texts hold nothing, as do templates of fewer than SHINGLE words; an equal line may be held by the short
    and the long form of a license, which are told apart by name. Repeated rows are reported each, a null doc_id stays
    null, other columns are ignored, an empty table gives an empty result.
    """
    chosen = TEMPLATES if templates is None else templates
    parsed = [(name, text_words(np.frombuffer(text.encode(), np.uint8), True)[1]) for name, text in chosen]
    parsed = [(name, h) for name, h in parsed if len(h) >= SHINGLE]
    if sum(len(h) for _, h in parsed) > TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {TEMPLATE_WORDS} words together: scan them in several calls")
    classes: dict[int, list[tuple[str, np.ndarray, np.ndarray, int]]] = {}
    for name, h in parsed:
        s = np.unique(sequences(h, SHINGLE))
        classes.setdefault(_class(len(h)), []).append((name, s, _signature(s), len(h)))
    names = ["doc_id", "license", "start", "n_words", "containment"]

    def places(start: int, size: int, shingles: np.ndarray, valid: np.ndarray, wanted: np.ndarray, n: int) -> list[tuple[int, int, float]]:
        """Where the window holds the template: its shingles gathered from left to right, a run a place."""
        part, ok = shingles[start:start + 2 * size], valid[start:start + 2 * size]
        at = np.flatnonzero(ok & np.isin(part, wanted))
        out, k = [], 0
        while k < len(at):
            end = np.searchsorted(at, at[k] + 1.5 * n, "right")
            share = len(np.unique(part[at[k:end]])) / len(wanted)
            if share >= containment:
                last = k  # the shortest run that holds as much
                while len(np.unique(part[at[k:last + 1]])) / len(wanted) < share:
                    last += 1
                out.append((start + int(at[k]), int(at[last] - at[k]) + SHINGLE, share))
                k = last + 1
            else:
                k += 1
        return out

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, last, doc, _, h, _ in word_blocks(batch.column(1), True):
                shingles = sequences(h, SHINGLE)
                if not len(shingles):
                    continue
                valid = doc[:len(shingles)] == doc[SHINGLE - 1:]
                base = np.searchsorted(doc, np.arange(first, last))
                best: dict[tuple[str, int], tuple[int, float]] = {}
                for size, group in classes.items():
                    for start, t in _hits(shingles, valid, size, [g[2] for g in group]):
                        name, wanted, _, n = group[t]
                        for at, words, share in places(start, size, shingles, valid, wanted, n):
                            if doc[at] == doc[at + words - 1]:
                                best[name, at] = max(best.get((name, at), (0, 0.0)), (words, share), key=lambda x: (x[1], -x[0]))
                ends: dict[str, int] = {}
                for (name, at), (words, share) in sorted(best.items()):
                    if at >= ends.get(name, 0):
                        row = int(doc[at])
                        rows.append((row, name, at - int(base[row - first]), words, share))
                        ends[name] = at + words
            r, name, at, words, share = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(r, pa.int64())), pa.array(name, pa.string()), pa.array(at, pa.int64()),
                 pa.array(words, pa.int64()), pa.array(share, pa.float64())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scanned, "doc_id long, license string, start long, n_words long, containment double")
