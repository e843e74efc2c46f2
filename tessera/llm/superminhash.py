"""SuperMinHash signatures of shingle sets.

Every element draws a random permutation of the signature's slots.  At its
j-th rank it offers the slot of that rank the value ``j + r`` with ``r``
uniform in [0, 1); a slot keeps the least value offered.  The ranks of one
element are thus correlated: no two of its offers fall into one slot, which
lowers the variance of the similarity estimate.

An offer of rank j beats every offer of a higher rank, so whole ranks can be
made at once for all elements, and the work stops with the first rank after
which every slot is filled.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest

SHINGLE = 5
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(SHINGLE)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``; bytes.split() and
    bytes.lower() know exactly those six blanks and A-Z."""
    raw = text.encode()
    found = (raw.lower() if lower else raw).split()
    return np.fromiter(map(xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; with fewer words one hash
    of the whole sequence; empty without words."""
    w = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    n = len(w)
    if n < SHINGLE:
        return mix((w * _POWERS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else w
    h = w[: n - SHINGLE + 1] * _POWERS[0]
    for i in range(1, SHINGLE):
        h = h + w[i : n - SHINGLE + 1 + i] * _POWERS[i]
    return np.unique(mix(h))


def signature(elements: np.ndarray, slots: int) -> np.ndarray:
    """The SuperMinHash signature: for each slot the winning offer as an integer.

    ``elements``: distinct 64-bit hashes, not empty.  An offer is kept as rank
    (upper 16 bits) and 48 random bits, compared as one integer.
    """
    best = np.full(slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    n = len(elements)
    perm = None
    rows = np.arange(n)
    for rank in range(slots):
        draw = mix(elements + np.uint64((0x9E3779B97F4A7C15 * (rank + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = rank + ((draw >> np.uint64(40)).astype(np.int64) * (slots - rank) >> 24)
        if rank == 0:
            slot = pick
        else:
            if perm is None:  # the swaps of rank 0, which most sets never need
                perm = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
                perm[rows, slot] = 0
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, rank]
        offer = (np.uint64(rank) << np.uint64(48)) | (mix(draw) >> np.uint64(16))
        np.minimum.at(best, slot, offer)
        if (best >> np.uint64(48)).max() <= rank:
            break
    return best


def band_keys(sig: np.ndarray, bands: int) -> list[int]:
    """One signed 64-bit key for each band, different for different bands."""
    rows = sig.reshape(bands, -1)
    return [xxh3_64_intdigest(rows[i].tobytes(), seed=i + 1) - (1 << 63) for i in range(bands)]


def set_key(elements: np.ndarray) -> bytes:
    return xxh3_128_digest(elements.tobytes())


def jaccard_links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
