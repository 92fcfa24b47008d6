"""Word shingles of a batch of texts as numpy arrays, without a Python loop over words.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z
lower-cased.  A shingle is a 64-bit hash of five words; a text with fewer words has one, of all its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text that are worked on at a time; a longer text is taken alone.
SLICE = 2_000_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _GOLD), dtype=np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_LETTER[_SPACE] = 0
_PLACES = _powers(4096)
_ORDER = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, ends): the distinct shingles of each text in ascending order, and where each text's end."""
    n = len(offsets) - 1
    starts_mask = ~_SPACE[data]
    if len(data):
        before = np.empty(len(data), bool)
        before[0], before[1:] = True, _SPACE[data[:-1]]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[begins] = True
        starts_mask &= before
    starts = np.flatnonzero(starts_mask)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = _PLACES if lengths.max() <= len(_PLACES) else _powers(int(lengths.max()))
    words = mix(np.add.reduceat(_LETTER[data[starts[0] :]] * powers[place], starts - starts[0]))
    per_text = np.diff(np.searchsorted(starts, offsets))
    n_shingles = np.where(per_text >= WORDS, per_text - WORDS + 1, (per_text > 0).astype(np.int64))
    first = np.cumsum(per_text) - per_text
    full = np.zeros(len(words), np.uint64)
    for j in range(WORDS):
        full[: len(words) - j] += words[j:] * _ORDER[j]
    text = np.repeat(np.arange(n), n_shingles)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + first[text]
    tokens = mix(full[at])
    for i in np.flatnonzero((per_text > 0) & (per_text < WORDS)):
        own = words[first[i] : first[i] + per_text[i]]
        tokens[np.searchsorted(text, i)] = mix((own * _ORDER[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    order = np.lexsort((tokens, text))
    tokens, text = tokens[order], text[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    tokens, text = tokens[new], text[new]
    return tokens, np.searchsorted(text, np.arange(n), side="right")


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, bytes, offsets) of runs of texts of about SLICE bytes; null texts are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, side="right")) - 1)
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def set_hash(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for an empty one."""
    sums = np.append(np.uint64(0), np.cumsum(mix(tokens ^ _GOLD), dtype=np.uint64))
    begins = np.append(0, ends[:-1]).astype(np.int64)
    sizes = (ends - begins).astype(np.uint64)
    return np.where(sizes > 0, mix(sums[ends] - sums[begins] + sizes) | np.uint64(1), np.uint64(0))
