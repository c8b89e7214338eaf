"""Word and shingle hashes of whole batches of texts, computed on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, small letters and every byte of a character beyond ASCII make words.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

#: Bytes that are hashed at once, more only within a single word.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int = 0) -> np.ndarray:
    """``n`` odd pseudo-random numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_places = multipliers(64)


def _hash_words(data: np.ndarray, first_of_text: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in ``data``; no word crosses the start of a text."""
    global _places
    lower = _LOWER[data]
    inside = kept[lower]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first_of_text[1:]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(starts[at])
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    if lengths.max() > len(_places):
        _places = multipliers(int(lengths.max()))
    with np.errstate(over="ignore"):
        terms = (lower[at].astype(np.uint64) + np.uint64(1)) * _places[place]
        return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), at[first]


def word_hashes(texts: pa.Array, kept: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text begins among them (n + 1 numbers).

    Words are runs of the bytes in ``kept``, by default as in ``columns.words``; A-Z count as a-z. NULL has none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    hashes, starts = [], []
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and kept[_LOWER[data[end]]] and not begins[end]:
            end += 1
        h, s = _hash_words(data[at:end], begins[at:end], kept)
        hashes.append(h)
        starts.append(s + at)
        at = end
    hashed = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    where = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return hashed, np.searchsorted(where, offsets)


def in_slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 8 << 20):
    """Parts of a batch whose texts have about ``most_bytes`` at most, or a single row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(lengths) // most_bytes
    bounds = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(lengths)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a text of fewer words, but not none, is one shingle."""
    words, bounds = word_hashes(texts)
    factors = multipliers(width, seed=7)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled += words[j:j + n] * factors[j]
        rolled = mix(rolled)
        sets = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                sets.append(np.unique(rolled[a:b - width + 1]))
            elif b > a:
                sets.append(mix(np.array([np.sum(words[a:b] * factors[:b - a])], np.uint64)))
            else:
                sets.append(np.empty(0, np.uint64))
    return sets
