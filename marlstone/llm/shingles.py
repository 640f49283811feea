"""Word shingles of whole Arrow text columns, in numpy over the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the word hash and of the five places of a shingle.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A scrambled number for every byte, A-Z as a-z.
_LETTER = mix64(_LOWER.astype(np.uint64) + np.uint64(1))


def text_slices(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Cut a column into runs of rows of about ``most_bytes`` each (a longer text stands alone)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, int(offsets[start]) + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column end to end, and the offsets of each (a null counts as empty)."""
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :]
    offsets = offsets.astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]  # a text starts a word even where the one before ends without space
    starts = np.flatnonzero(first)
    per_text = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    at = np.flatnonzero(inside)
    letters = _LETTER[data[at]]
    begins = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begins, len(at)))
    places = np.arange(len(at), dtype=np.int64) - np.repeat(begins, lengths)
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    hashed = np.add.reduceat(letters * powers[places], begins)
    return mix64(hashed + lengths.astype(np.uint64)), per_text


def text_parts(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cut one text into parts of about ``size`` bytes, before white space; a longer run without any stays whole."""
    begin, size = 0, max(1, size)
    while begin < len(data):
        end = min(begin + size, len(data))
        while end < len(data):
            space = np.flatnonzero(_SPACE[data[end : end + size]])
            if len(space):
                end += int(space[0])
                break
            end = min(end + size, len(data))
        yield begin, end
        begin = end


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    full = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        full += mix64(words[k : len(words) - size + 1 + k] * _PLACES[k % 5] + np.uint64(k))
    return full


def _sequence(words: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence."""
    return np.add.reduce(mix64(words * mix64(np.arange(len(words), dtype=np.uint64) + _BASE))) + np.uint64(len(words))


def long_shingle_set(data: np.ndarray, part: int, size: int = 5) -> np.ndarray:
    """The set of one very long text, by parts of about ``part`` bytes; equals that of ``shingle_sets``."""
    found, words = [], np.zeros(0, np.uint64)
    for begin, end in text_parts(data, part):
        words = np.concatenate([words[max(0, len(words) - size + 1) :], word_hashes(data[begin:end], np.array([0, end - begin]))[0]])
        if len(words) >= size:
            found.append(np.unique(mix64(_windows(words, size))))
    if not found:
        return mix64(np.array([_sequence(words)])) if len(words) else words
    return np.unique(np.concatenate(found))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5, part: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end, and the offsets of each text's set.

    A text of fewer than ``size`` words has one shingle, its whole word sequence; one without words has none.
    A single text of more than ``part`` bytes is taken by parts, so that memory is that of its set.
    """
    if len(offsets) == 2 and len(data) > part:
        alone = long_shingle_set(data, part // 4, size)
        return alone, np.array([0, len(alone)])
    words, per_text = word_hashes(data, offsets)
    ends = np.cumsum(per_text)
    begins = ends - per_text
    n = len(words)
    text_of = np.repeat(np.arange(len(per_text), dtype=np.int32), per_text)
    parts, owners = [], []
    if n >= size:
        ok = text_of[: n - size + 1] == text_of[size - 1 :]
        parts.append(mix64(_windows(words, size)[ok]))
        owners.append(text_of[: n - size + 1][ok])
    for t in np.flatnonzero((per_text > 0) & (per_text < size)):
        parts.append(mix64(np.array([_sequence(words[begins[t] : ends[t]])])))
        owners.append(np.array([t], np.int32))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(per_text) + 1, np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(len(per_text) + 1))
