"""Words of whole texts as arrays: segmentation and hashing on the bytes of Arrow columns.

Inside a task a batch of texts is one byte buffer. Words are found and hashed on it with array
operations, a few megabytes at a time, so memory does not follow the batch or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = 1 << 20
_U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h.astype(_U64, copy=True)
    h ^= h >> _U64(30)
    h *= _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C55 | 1
_POWERS = np.ones(1, dtype=_U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _U64(_BASE), dtype=_U64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


class Alphabet:
    """Which bytes make words, and what they are read as."""

    def __init__(self, inside: np.ndarray, fold: np.ndarray):
        self.inside, self.fold = inside, fold


def _fold_ascii() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def _range_mask(*ranges: tuple[int, int]) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    for low, high in ranges:
        mask[low : high + 1] = True
    return mask


# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased
LETTERS = Alphabet(_range_mask((48, 57), (65, 90), (97, 122), (128, 255)), _fold_ascii())
# [^\x20\x09-\x0D]+
SPACED = Alphabet(~_range_mask((9, 13), (32, 32)), np.arange(256, dtype=np.uint8))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if not len(column) or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def segment(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Start and end of every word, and the number of words of every row."""
    mask = inside[data]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    close = mask.copy()
    close[:-1] &= ~mask[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[filled] = mask[filled]  # a word ends with its row
    edge = filled[filled > 0] - 1
    close[edge] = mask[edge]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def hash_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, none of them empty."""
    n = len(starts)
    out = np.zeros(n, _U64)
    lengths = ends - starts
    total = np.concatenate(([0], np.cumsum(lengths)))
    i = 0
    while i < n:
        j = int(np.searchsorted(total, total[i] + _CHUNK, "right")) - 1
        if j <= i:  # one very long word: hash it in pieces
            value, step = 0, 1
            for at in range(int(starts[i]), int(ends[i]), _CHUNK):
                part = fold[data[at : min(at + _CHUNK, int(ends[i]))]]
                piece = int(np.sum(_BYTE[part] * _powers(len(part))[: len(part)], dtype=_U64))
                value = (value + piece * step) % (1 << 64)
                step = step * pow(_BASE, _CHUNK, 1 << 64) % (1 << 64)
            out[i] = value
            i += 1
            continue
        size = lengths[i:j]
        first = total[i:j] - total[i]
        place = np.arange(int(total[j] - total[i])) - np.repeat(first, size)
        code = fold[data[np.repeat(starts[i:j], size) + place]]
        terms = _BYTE[code] * _powers(int(size.max()))[place]
        out[i:j] = np.add.reduceat(terms, first)
        i = j
    return mix(out ^ (lengths.astype(_U64) * _U64(0xD6E8FEB86659FD93)))


def words(column_bytes: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
    """Starts, ends, counts per row and hashes of the words of a slice of rows."""
    starts, ends, counts = segment(column_bytes, offsets, alphabet.inside)
    return starts, ends, counts, hash_pieces(column_bytes, starts, ends, alphabet.fold)


def word_slices(column: pa.Array, alphabet: Alphabet, limit: int = 2 << 20):
    """For each slice of rows: first row, last row, its bytes and offsets, and its words."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, limit):
        part = data[offsets[i] : offsets[j]]
        own = offsets[i : j + 1] - offsets[i]
        yield i, j, part, own, words(part, own, alphabet)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in a row, and the row of each.

    A row with fewer words, but not none, has one shingle: all of them.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(hashes):
        return np.zeros(0, _U64), rows
    left = np.concatenate(([0], np.cumsum(counts)))
    ahead = np.repeat(left[1:], counts) - np.arange(len(hashes))  # words from here to the row's end
    short = np.repeat(counts, counts) < size
    first = np.arange(len(hashes)) == np.repeat(left[:-1], counts)
    keep = (ahead >= size) | (short & first)
    at = np.flatnonzero(keep)
    value = np.zeros(len(at), _U64)
    for k in range(size):
        have = ahead[at] > k
        nxt = hashes[np.minimum(at + k, len(hashes) - 1)]
        value = np.where(have, mix(value * _U64(0x9E3779B97F4A7C15) + nxt + _U64(k + 1)), value)
    return value, rows[at]


class Lexicon:
    """Sorted 64-bit keys with a bitmap in front, so that most misses cost one look."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, dtype=_U64))
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.keys & _U64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash among the keys, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        may = np.flatnonzero(self.bits[(hashes & _U64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[may]), len(self.keys) - 1)
        out[may] = np.where(self.keys[at] == hashes[may], at, -1)
        return out
