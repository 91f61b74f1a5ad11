"""Word shingles of texts as hashes."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_hashes(text: bytes | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles; fewer words are one shingle."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if words else [], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist())), dtype="<u8", count=len(starts))


def text_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))
