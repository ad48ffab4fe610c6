"""Sets of word shingles of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corpusloom.llm.words import mix, sequences, word_blocks

WORDS = 5


def shingle_sets(column: pa.Array, words: int = WORDS, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles); a text of fewer words is one shingle, without words none."""
    for first, last, doc, _, hashes, _ in word_blocks(column, lower):
        whole = sequences(hashes, words)
        inside = doc[:len(whole)] == doc[words - 1:words - 1 + len(whole)] if len(whole) else np.empty(0, bool)
        h, d = whole[inside], doc[:len(whole)][inside]
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
        bounds = np.searchsorted(d, np.arange(first, last + 1))
        starts = np.searchsorted(doc, np.arange(first, last + 1))
        for row in range(first, last):
            k = row - first
            if bounds[k + 1] > bounds[k]:
                yield row, h[bounds[k]:bounds[k + 1]]
            elif starts[k + 1] > starts[k]:
                short = hashes[starts[k]:starts[k + 1]]
                yield row, sequences(short, len(short))
            else:
                yield row, h[:0]


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set only."""
    a, b = mix(hashes).sum(dtype=np.uint64), mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))
