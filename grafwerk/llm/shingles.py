"""Hashed word shingles of whole texts, vectorised over batches of texts.

Words are the runs of bytes other than the six blanks of ASCII, with A-Z lower-cased.  A word's hash is a
polynomial in random values of its bytes, taken as a difference of prefix sums; words of more than
``LONG_WORD`` bytes are hashed on their own.  Texts of any length are read in blocks of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

LONG_WORD, BLOCK = 4096, 1 << 15
#: Bytes of text that are held as one buffer (a longer text is a buffer of its own).
BUFFER = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_K1, _K3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K3
    x = (x ^ (x >> np.uint64(32))) * _K3
    return x ^ (x >> np.uint64(32))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_VALUES[65:91] = _VALUES[97:123]
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _tables:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(BLOCK + LONG_WORD, np.uint64)
            done = 1
            while done < len(out):
                more = min(done, len(out) - done)
                out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
                done += more
            _tables.append(out)
    return _tables


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a buffer of bytes."""
    up, down = _powers()
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    long = ends - starts > LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
    usual = np.flatnonzero(~long)
    begun, ended = starts[usual], ends[usual]
    at = 0
    while at < len(usual):
        first = begun[at]
        past = int(np.searchsorted(ended, first + BLOCK, side="right"))
        last = ended[past - 1]
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_VALUES[data[first:last]] * up[: last - first], out=sums[1:])
        s, e = begun[at:past] - first, ended[at:past] - first
        out[usual[at:past]] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = past
    return out, starts


def _short(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    value = np.array([len(words)], np.uint64)
    for i in range(len(words)):
        value = mix(words[i : i + 1] + value * _K1)
    return value


def shingle_lists(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The hashed shingles of each text, repeats included; of a text without words, none."""
    at = 0
    while at < len(texts):
        size, past = len(texts[at]), at + 1
        while past < len(texts) and size + len(texts[past]) < BUFFER:
            size += len(texts[past])
            past += 1
        part = texts[at:past]
        words, starts = word_hashes(np.frombuffer(b" ".join(part), np.uint8))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))
        runs = words[: max(0, len(words) - width + 1)]
        for i in range(1, width):
            runs = runs * _K1 + words[i : len(words) - width + 1 + i] if len(runs) else runs
        runs = mix(runs)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if high - low >= width:
                yield runs[low : high - width + 1]
            else:
                yield _short(words[low:high]) if high > low else words[:0]
        at = past


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and without repeats."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    return map(distinct, shingle_lists(texts, width))
