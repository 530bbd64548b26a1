"""Vectorised hashing of words over whole batches of texts (numpy only, no loop over words)."""

from __future__ import annotations

import numpy as np

from lodestone.llm.common import ship

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x100000001B3
POWERS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs on every machine."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x ^= x >> np.uint64(33)
    x *= MIX2
    x ^= x >> np.uint64(33)
    return x


def powers() -> np.ndarray:
    out = np.empty(POWERS, np.uint64)
    x = 1
    for i in range(POWERS):
        out[i] = x
        x = x * BASE & (1 << 64) - 1
    return out


def blank_table() -> np.ndarray:
    """True for the bytes of a word `[^\\x20\\x09-\\x0D]+`."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def letter_table() -> np.ndarray:
    """True for lower-case ASCII letters and all bytes of non-ASCII characters."""
    t = np.zeros(256, bool)
    t[ord("a") : ord("z") + 1] = True
    t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def segments(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray, pows: np.ndarray, prefix: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, or of its first `prefix` bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    length = ends - starts
    if prefix is not None:
        length = np.minimum(length, prefix)
    position = np.arange(len(data)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
    value = (data.astype(np.uint64) + np.uint64(1)) * pows[position & (POWERS - 1)]
    long = np.flatnonzero(position >= POWERS)  # beyond the table of powers each block of a word gets its own factor
    if len(long):
        value[long] = mix(value[long] + (position[long] // POWERS).astype(np.uint64) * ODD)
    value *= inside
    if prefix is not None:
        value *= position < prefix
    total = np.add.reduceat(value, starts)
    return mix(total + length.astype(np.uint64) * ODD)


def chunks(texts: list, limit: int):
    """Runs of texts of about `limit` bytes; a longer text stands alone. Yields first index and the texts."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


ship(__name__)
