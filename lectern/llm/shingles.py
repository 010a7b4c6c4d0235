"""Word-shingle sets of a batch of texts, hashed to 64 bits over the UTF-8 bytes as one array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_DRAW = np.random.default_rng(71)
#: A random number for every byte, upper-case ASCII letters taking those of the lower-case ones.
_BYTES = _DRAW.integers(0, 2**64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all of its bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each text ends, from 0."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]).astype(np.int64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the index of each text's first word (one more than texts).

    A word is a run of bytes other than ASCII white space, A-Z read as a-z.
    """
    data, edges = utf8(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    cut = edges[:-1][edges[:-1] < len(data)]
    opens[cut] = solid[cut]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    last = edges[1:] - 1
    last = last[last >= 0]
    closes[last] = solid[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, len(data)), out=running[1:])
    words = (running[ends] - running[starts]) * powers(_INVERSE, len(data))[starts]
    return mix(words + (ends - starts).astype(np.uint64)), np.searchsorted(starts, edges)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words.

    A text of fewer words has one shingle of them all; one without words has none.
    """
    words, first = word_hashes(texts)
    whole = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        whole = whole * _STEP + words[k : k + len(whole)]
    whole = mix(whole)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for h in words[a:b]:
                    short = short * _STEP + h
            sets.append(mix(np.array([short + np.uint64(b - a)], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets
