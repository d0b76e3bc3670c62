"""Counts of hashed byte trigrams, for small linear text models."""

from __future__ import annotations

import numpy as np


def trigram_counts(text: str | None, bits: int) -> np.ndarray:
    """Counts of a text's byte trigrams (A-Z lower-cased) in ``2**bits`` places."""
    a = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.uint32)
    total = np.zeros(1 << bits, np.int64)
    for i in range(0, max(0, len(a) - 2), 1 << 20):
        b = a[i : i + (1 << 20) + 2]
        h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        h = (h * np.uint32(2654435769)) >> np.uint32(32 - bits)
        total += np.bincount(h, minlength=1 << bits)
    return total
