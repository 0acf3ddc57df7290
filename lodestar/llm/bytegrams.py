"""Hashed byte n-grams of whole texts, a block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GRAM = 4
BLOCK_BYTES = 1 << 19


def blocks(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about BLOCK_BYTES, so that the arrays of a block stay small; a longer text is its own block."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_BYTES:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def grams(data: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the 4 bytes at every place of the joined texts, and each text's first and end place of grams."""
    lens = np.fromiter(map(len, data), np.int64, len(data))
    buf = np.frombuffer(b"".join(data) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = len(buf) - 3
    value = buf[:n] | buf[1 : n + 1] << np.uint32(8) | buf[2 : n + 2] << np.uint32(16) | buf[3 : n + 3] << np.uint32(24)
    bucket = (value * np.uint32(2654435761)) >> np.uint32(32 - bits)
    ends = np.cumsum(lens)
    starts = ends - lens
    return bucket, starts, np.maximum(starts, ends - (GRAM - 1))


def counts(texts: list[bytes], bits: int) -> np.ndarray:
    """How often each bucket occurs in the texts."""
    bucket, starts, ends = grams(texts, bits)
    keep = np.zeros(len(bucket) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    return np.bincount(bucket[np.cumsum(keep[:-1]) > 0], minlength=1 << bits)


def sums(texts: list[bytes], bits: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of every row of weights (rows x buckets) over its grams, and its number of grams."""
    bucket, starts, ends = grams(texts, bits)
    out = np.empty((len(texts), len(weights)))
    for k, row in enumerate(weights):
        total = np.concatenate([[0.0], np.cumsum(row[bucket])])
        out[:, k] = total[ends] - total[starts]
    return out, ends - starts


def log_probabilities(count: np.ndarray, alpha: float = 0.5, even: float = 0.0) -> np.ndarray:
    """Smoothed log probabilities of a multinomial, mixed with a part `even` of the even distribution."""
    return np.log((1 - even) * (count + alpha) / (count.sum() + alpha * len(count)) + even / len(count))
