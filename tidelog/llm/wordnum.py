"""Words and 5-word shingles of many texts at once, as 64-bit numbers in numpy.

A word's number is made of its bytes after A-Z become a-z: 8 bytes at a time are mixed, together with the word's length
and the 8 bytes before them, by a bijection; a word of more than 64 bytes is hashed by blake2b. Words of up to 8 bytes that
are equally long never share a number, others do by chance only. Sequences are sums of numbers mixed with their place, so
no pattern of words cancels out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Bytes of text that a step turns into numbers at once; a longer text is a step of its own, cut between words.
STEP_BYTES = 2_000_000
SHINGLE = 5
#: Bytes beyond which a word is hashed alone.
LONG_WORD = 64

_rng = np.random.default_rng(20240607)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_GOLD = 0x9E3779B97F4A7C15
COEFFICIENTS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x + np.uint64((_GOLD * (salt + 1)) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, starts) of the words in raw, which ends in a blank."""
    b = np.frombuffer(raw, np.uint8)
    blank = _BLANK[b]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(b) and not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    size = end - start
    low = np.concatenate([_LOWER[b], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(b) + 1,), "<u8", low, 0, (1,))  # the 8 bytes that begin at each place
    out = mix((eight[start] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * COEFFICIENTS[0])
    rest = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    k = 8
    while len(rest):
        out[rest] = mix(out[rest] * COEFFICIENTS[1] + (eight[start[rest] + k] & _FIRST_BYTES[np.minimum(size[rest] - k, 8)]), k)
        k += 8
        rest = rest[size[rest] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out, start


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words in order, bounds): text i has the words from bounds[i] to bounds[i + 1]."""
    raw = b" ".join(texts) + b" "
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) if texts else np.zeros(1, np.int64)
    numbers, starts, at = [], [], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + STEP_BYTES) if len(raw) - at > 2 * STEP_BYTES else None
        to = gap.end() if gap else len(raw)
        x, start = _numbers(raw[at:to])
        numbers.append(x)
        starts.append(start + at)
        at = to
    return np.concatenate(numbers), np.searchsorted(np.concatenate(starts), begin)


def shingles_of(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle numbers, bounds): a text of n >= 5 words has n - 4, one with fewer words a single one of all, none without."""
    n = np.diff(bounds)
    if len(numbers) >= SHINGLE:
        m = len(numbers) - SHINGLE + 1
        every = sum((numbers[k : m + k] * COEFFICIENTS[k] for k in range(1, SHINGLE)), numbers[:m] * COEFFICIENTS[0])
        every = mix(every)
    else:
        every = np.zeros(0, np.uint64)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    at = bounds[:-1][doc] + np.arange(len(doc)) - out_bounds[:-1][doc]
    out = np.empty(len(doc), np.uint64)
    long = (n >= SHINGLE)[doc]
    out[long] = every[at[long]]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        own = numbers[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = mix((own * COEFFICIENTS[: len(own)]).sum(dtype=np.uint64, keepdims=True), int(len(own)))[0]
    return out, out_bounds


def sequence_keys(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each text's whole sequence of words."""
    n = np.diff(bounds)
    place = (np.arange(len(numbers)) - np.repeat(bounds[:-1], n)).astype(np.uint64)
    out = []
    for salt in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(numbers ^ mix(place, 10 + salt), salt))])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64), salt))
    return out[0], out[1]


def steps(frames: Iterator[pd.DataFrame], column: str = "text") -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """The rows of frames with their texts as bytes, a bounded number of bytes at a time."""
    for frame in frames:
        raw = [(t or "").encode("utf-8", "replace") if isinstance(t, str) or t is None else b"" for t in frame[column]]
        at = 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= STEP_BYTES):
                size += len(raw[to])
                to += 1
            yield frame.iloc[at:to], raw[at:to]
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def unsigned(x) -> np.ndarray:
    return np.asarray(x, dtype=np.int64).view(np.uint64)


def sorted_sets(values: np.ndarray, bounds: np.ndarray, take: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(doc, value) of the texts' values, sorted and without repeats; of those texts only that take marks, if given."""
    values = values.copy()
    for i in range(len(bounds) - 1):
        values[bounds[i] : bounds[i + 1]].sort()
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    if take is not None:
        keep &= take[doc]
    return doc[keep], values[keep]
