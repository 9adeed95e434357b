"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit (uint64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of the words of a shingle.
_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def byte_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hash of each token."""
    return byte_hashes([t.encode("utf-8", "surrogatepass") for t in tokens])


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text: of
    ``width`` words each, or of all words if there are fewer; none without words."""
    h = byte_hashes(text.encode("utf-8", "surrogatepass").lower().split()) if text else np.empty(0, np.uint64)
    n = len(h)
    if not n:
        return h
    if n < width:
        parts = np.append(h, np.uint64(n)) * np.append(_FACTORS[:n], _FACTORS[63:])
        return mixed(parts.sum(dtype=np.uint64, keepdims=True))
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += h[i : n - width + 1 + i] * _FACTORS[i]
    total = np.sort(mixed(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]
