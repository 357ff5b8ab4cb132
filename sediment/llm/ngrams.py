"""Character n-grams of whole texts as hash buckets, for the linear models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: What an ASCII character counts as: letters as they are, all others as a blank, so that n-grams see word ends alike.
_PLAIN = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def joined(texts: list[str | None], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased characters (code points) of all texts, each after one blank and before ``gap`` blanks, and where
    each begins."""
    parts = [" " + (t or "").lower() + " " * gap for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    data = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(data < 128, _PLAIN[data & 127], data).astype(np.uint64), starts


def buckets(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram of ``order`` characters that begins at each character but the last ones."""
    n = max(0, len(data) - order + 1)
    key = np.zeros(n, np.uint64)
    for k in range(order):
        key = key * np.uint64(0x100000001B3) + data[k : k + n]
    key = (key + np.uint64(order)) * _MIX
    return ((key ^ (key >> np.uint64(29))) * _MIX >> np.uint64(64 - bits)).astype(np.int32)


def chunks(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each (one text at least)."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
