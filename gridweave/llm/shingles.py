"""Sets of hashed word shingles of whole texts, vectorised over a slice of documents.

Words are runs of bytes other than ASCII white space, A-Z in lower case. A word's hash is the sum
of random numbers drawn for each (place, byte); a shingle's is a random linear form of its words'
hashes, finalised by a bijection. Different shingles agree with a chance of about 2**-63.
"""

from __future__ import annotations

import numpy as np
import xxhash

_PLACES = 64
_RANDOM = np.random.default_rng(20240607)
_TABLE = _RANDOM.integers(0, 2**64, _PLACES * 256, np.uint64)
_FORM = _RANDOM.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def finalised(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no order in its input."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, offsets of each text's words)."""
    data = b"\n".join([*texts, b""]).lower()
    raw = np.frombuffer(data, np.uint8)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    used = ~_BLANK[raw]
    first = used.copy()
    first[1:] &= ~used[:-1]
    begins = np.flatnonzero(first).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
    offsets = np.searchsorted(begins, edges)
    if not len(begins):
        return np.empty(0, np.uint64), offsets
    at = np.flatnonzero(used).astype(begins.dtype)
    word = np.cumsum(first, dtype=begins.dtype)[at] - 1
    place = np.minimum(at - begins[word], _PLACES - 1).astype(np.int16)
    heads = np.flatnonzero(first[at])
    size = np.diff(np.append(heads, len(at)))
    hashes = np.add.reduceat(_TABLE[place * np.int16(256) + raw[at]], heads)
    for k in np.flatnonzero(size > _PLACES):
        hashes[k] = xxhash.xxh3_64_intdigest(data[begins[k] : begins[k] + size[k]])
    return hashes, offsets


def shingle_sets(texts: list[bytes], size: int = 5, together: int = 1 << 20) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a shorter text with words is one shingle. About `together`
    bytes are hashed at a time."""
    if len(texts) > 1 and sum(map(len, texts)) > together:
        out, some, weight = [], [], 0
        for t in texts:
            if some and weight + len(t) > together:
                out += shingle_sets(some, size, together)
                some, weight = [], 0
            some.append(t)
            weight += len(t)
        return out + shingle_sets(some, size, together + weight)
    words, offsets = word_hashes(texts)
    n = len(words)
    joined = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        joined += words[k : k + len(joined)] * _FORM[k]
    joined = finalised(joined)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            whole = np.append(words[a:b] * _FORM[: b - a], _FORM[-(b - a)]).sum(dtype=np.uint64)
            out.append(finalised(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one = finalised(tokens ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    two = finalised(tokens ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))
