"""Words `[^\\x20\\x09-\\x0D]+` of Arrow text columns as 64-bit hashes, a block of bytes at a time.

The hash of a word is a polynomial over random byte values modulo 2**64, mixed afterwards; sequences of words
combine word hashes the same way. Equal sequences always have equal hashes; two different ones share a hash with
a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes worked on at a time: bounds the temporary arrays whatever the batch or the text holds

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n-1 modulo 2**64."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word starts within the bytes and their hashes; the bytes neither start nor end inside a word."""
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    gaps = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, gaps)
    values = _BYTE[raw[starts[0]:]] * powers(int(gaps.max()))[place]
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def text_words(raw: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of each word of one text given as bytes, in blocks cut at white space."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw):  # move on to the next white space
            found = np.flatnonzero(_SPACE[raw[end:end + 4096]])
            if len(found):
                end += int(found[0])
                break
            end = min(len(raw), end + 4096)
        s, h = _block(raw[at:end], lower)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets


def word_blocks(column: pa.Array, lower: bool = False) -> Iterator[tuple]:
    """(first row, last row + 1, doc, start, hash) for runs of whole rows of about BLOCK bytes.

    `doc` is each word's row in the column, `start` its first byte in the returned bytes; a longer text is a run of
    its own, hashed block by block.
    """
    raw, offsets = _buffers(column)
    row = 0
    while row < len(column):
        last = row + 1
        while last < len(column) and offsets[last + 1] - offsets[row] <= BLOCK:
            last += 1
        part = raw[offsets[row]:offsets[last]]
        if last == row + 1:
            starts, hashes = text_words(part, lower)
            doc = np.full(len(starts), row)
        else:
            # a separator between rows, so that no word runs over
            ends = offsets[row:last + 1] - offsets[row]
            padded = np.full(len(part) + (last - row), 32, np.uint8)
            place = np.arange(len(part)) + np.repeat(np.arange(last - row), np.diff(ends))
            padded[place] = part
            starts, hashes = _block(padded, lower)
            doc = np.searchsorted(ends[:-1] + np.arange(last - row), starts, "right") - 1
            starts = starts - doc
            doc = doc + row
        yield row, last, doc, starts, hashes, part
        row = last


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes (length len - n + 1)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += hashes[k:k + size] * _SLOT[k]
    return mix(out)
