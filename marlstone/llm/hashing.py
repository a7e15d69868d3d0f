"""Hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two rounds of multiply and shift)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=8)
def constants(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 8, dtype=_U) | _U(1)


def word_hashes(low: np.ndarray, starts: np.ndarray, lens: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A hash of each word: its blocks of eight bytes, mixed one after the other. ``low`` ends with eight bytes to spare."""
    blocks = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    h = mix(lens.astype(_U) * c[5] + c[6])
    todo = np.arange(len(starts)) if lens.max() <= LONG_WORD else np.flatnonzero(lens <= LONG_WORD)
    k = 0
    while len(todo):
        rest = lens[todo] - k
        cut = _U(8) * np.maximum(8 - rest, 0).astype(_U)
        h[todo] = mix(h[todo] * c[7] + (blocks[starts[todo] + k] & (~_U(0) >> cut)))
        k += 8
        todo = todo[rest > 8]
    for i in np.flatnonzero(lens > LONG_WORD):
        word = low[starts[i] : starts[i] + lens[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=c[4:8].tobytes()).digest(), "little")
    return h


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of the texts joined by newlines (with eight to spare), starts and lengths of their words, and of each
    text the number of words before it (and the number of all)."""
    low = LOWER[np.frombuffer(b"\n".join(texts) + b"\n" * 9, np.uint8)]
    inside = ~SPACE[low]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return low, starts, ends - starts, at
