"""Vectorised word hashing over Arrow string columns, shared by the text operators.

Words are maximal runs of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); A-Z may be lower-cased first.  A whole Arrow batch
is hashed with a handful of numpy passes over its UTF-8 buffer, so no Python
string is built per word.

A word's hash is a multilinear one modulo 2**64 (each byte's random code times a
random factor of its place in the word) followed by a bit mixer.  No algebra
ties the factors together, and codes differ in their low nine bits, so two
different words share a hash with probability of at most 2**-55; ``table``
chooses one of two independent hashes.  Operators that need certainty compare
the words themselves: :func:`shingle_ids` tells shingles apart without a hash.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes hashed in one pass; longer columns go slice by slice, so that the
#: scratch arrays stay small whatever the batch holds.
SLICE = 1 << 21
#: Short rows are hashed so many bytes together, whose scratch arrays fit a core's cache.
PASS = 1 << 17


@functools.cache
def _table(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the bytes, the same with A-Z as a-z, and factors of the places in a word; made where words are hashed, not in the driver."""
    draw = np.random.Generator(np.random.PCG64((20240917, 771)[number]))
    codes = (draw.integers(0, 2**64, 256, dtype=U) & ~U(511)) | np.arange(1, 257, dtype=U)
    lower = codes.copy()
    lower[65:91] = codes[97:123]
    return codes, lower, draw.integers(0, 2**64, SLICE, dtype=U)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)

@contextmanager
def paused_gc() -> Iterator[None]:
    """No garbage collection inside: it would walk long lists of words that hold no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(NamedTuple):
    """Hashes of all words of a column; row i owns hashes[offsets[i]:offsets[i + 1]]."""

    hashes: np.ndarray
    offsets: np.ndarray


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_slice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], words of a slice of at most SLICE bytes."""
    sizes = ends - starts
    return _hash_words(data[np.repeat(starts, sizes) + _within(sizes)], sizes, codes, factors)


def _hash_words(data: np.ndarray, sizes: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hashes of words of these sizes that stand one behind another."""
    if not len(sizes):
        return np.zeros(0, U)
    first = np.cumsum(sizes) - sizes
    parts = codes[data] * factors[np.arange(len(data)) - np.repeat(first, sizes)]
    return mix(np.add.reduceat(parts, first) + sizes.astype(U) * U(_BASE))


def word_hashes(column: pa.Array | pa.ChunkedArray, *, lower: bool = True, table: int = 0) -> Words:
    """Hash every word of every row of a string column."""
    data, offsets = utf8(column)
    plain, small, factors = _table(table)
    codes, found, counts = (small if lower else plain), [], np.zeros(len(offsets) - 1, np.int64)
    row = 0
    while row < len(offsets) - 1:
        # As many whole rows as fit in a pass, one at least.
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PASS, "right")) - 1)
        piece, edges = data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        solid = ~_SPACE[piece]
        # A word starts where a solid byte follows white space or a row's edge.
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        inner = edges[(edges > 0) & (edges < len(piece))]
        start[inner] = solid[inner]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:]
        stop[inner - 1] = solid[inner - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        if len(piece) <= SLICE:
            found.append(_hash_words(piece[solid], ends - starts, codes, factors))
        else:
            found.append(_hash_long(piece, starts, ends, codes, factors))
        counts[row:last] = np.diff(np.searchsorted(starts, edges))
        row = last
    return Words(np.concatenate(found) if found else np.zeros(0, U), np.concatenate([[0], np.cumsum(counts)]))


def _hash_long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One row of more than SLICE bytes: slices cut at word starts; a longer word is folded part by part."""
    out, i = np.zeros(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        if ends[j - 1] - starts[i] <= SLICE:
            base = starts[i]
            out[i:j] = _hash_slice(data[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base, codes, factors)
        else:
            folded = np.zeros(1, U)
            for at in range(int(starts[i]), int(ends[i]), SLICE):
                part = data[at : min(at + SLICE, int(ends[i]))]
                folded = mix((folded + _hash_slice(part, np.array([0]), np.array([len(part)]), codes, factors)) * U(_BASE))
            out[i] = folded[0]
        i = j
    return out


def ngrams(words: Words, n: int, *, whole_if_short: bool = False) -> Words:
    """Hashes of the n consecutive words at each position, row by row, repeats kept.

    A row with fewer than n words has none, or with ``whole_if_short`` one
    hash of its whole sequence (if it has a word at all).
    """
    hashes, offsets = words
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - n + 1, 0)
    if len(hashes) >= n:
        rolled = np.zeros(len(hashes) - n + 1, U)
        for k in range(n):
            rolled = rolled * U(_BASE) + hashes[k : len(hashes) - n + 1 + k]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, U)
    short = np.flatnonzero((sizes > 0) & (sizes < n)) if whole_if_short else np.zeros(0, np.int64)
    keep = np.repeat(offsets[:-1], counts) + _within(counts)
    own = rolled[keep] if len(keep) else np.zeros(0, U)
    ends = np.concatenate([[0], np.cumsum(counts)])
    if len(short):
        extra = []
        for row in short:
            folded = np.array([sizes[row]], U)
            for h in hashes[offsets[row] : offsets[row + 1]]:
                folded = mix(folded * U(_INVERSE) + h)
            extra.append(folded[0])
        own = np.insert(own, ends[short], np.array(extra, U))
        counts[short] = 1
        ends = np.concatenate([[0], np.cumsum(counts)])
    return Words(own, ends)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def distinct(words: Words, *more: np.ndarray) -> tuple[Words, ...] | Words:
    """Each row's distinct hashes, ascending; of ``more`` arrays the values that go with them."""
    hashes, offsets = words
    out, counts, rest = [], np.zeros(len(offsets) - 1, np.int64), [[] for _ in more]
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b > a:
            if more:
                order = np.argsort(hashes[a:b])
                own = hashes[a:b][order]
            else:
                own = np.sort(hashes[a:b])
            if b - a > 1:
                keep = np.concatenate([[True], own[1:] != own[:-1]])
                own = own[keep]
                if more:
                    order = order[keep]
            for parts, values in zip(rest, more):
                parts.append(values[a:b][order])
            out.append(own)
            counts[row] = len(own)
    ends = np.concatenate([[0], np.cumsum(counts)])
    made = [Words(np.concatenate(parts) if parts else np.zeros(0, U), ends) for parts in (out, *rest)]
    return tuple(made) if more else made[0]


def shingle_ids(column: pa.Array | pa.ChunkedArray, n: int) -> Words:
    """Ids of each row's distinct n-word shingles, ascending: equal within this call if and only if the words are.

    Words are lower-cased in A-Z; a row with fewer than n words has its whole sequence as its only shingle.
    """
    data, offsets = utf8(column)
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    solid = np.asarray(pc.binary_length(words)) > 0
    found = words.dictionary_encode()
    ids = found.indices.to_numpy()[solid].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(solid)])[split.offsets.to_numpy()]
    sizes = np.diff(ends)
    counts = np.maximum(sizes - n + 1, 0)
    starts = np.repeat(ends[:-1], counts) + _within(counts)
    key, bound, base = ids[starts], len(found.dictionary) + 1, len(found.dictionary) + 1
    for k in range(1, n):
        if bound * base >= 2**62:
            distinct_keys, key = np.unique(key, return_inverse=True)
            bound = len(distinct_keys) + 1
        key, bound = key * base + ids[starts + k], bound * base
    short: dict[tuple, int] = {}
    at = np.concatenate([[0], np.cumsum(counts)])
    rows = np.flatnonzero((sizes > 0) & (sizes < n))
    extra = [-1 - short.setdefault(tuple(ids[ends[r] : ends[r + 1]].tolist()), len(short)) for r in rows.tolist()]
    counts[rows] = 1
    key = np.insert(key, at[rows], np.array(extra, np.int64))
    return distinct(Words(key, np.concatenate([[0], np.cumsum(counts)])))
