"""Word shingles of texts as sets of 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import ASCII_LOWER, ASCII_UPPER

#: Bytes of text that are hashed together; one longer text is hashed alone.
TOGETHER = 4 << 20
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(41).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)


def _powers(count: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < count:
        steps = np.full(2 * count, _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    data = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    space = _IS_SPACE[data]
    inside = np.flatnonzero(~space)
    first = np.flatnonzero(space[inside - 1] | (inside == 0)) if len(inside) else inside
    starts = inside[first]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = np.diff(first, append=len(inside))
    offset = inside - np.repeat(starts, sizes)
    values = _BYTE[data[inside]] * _powers(int(offset.max()) + 1)[offset]
    return mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64)), counts


def shingle_sets(texts: list[bytes | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A-Z are lower-cased; words part at the six ASCII white-space bytes. A text of fewer words
    has its whole sequence as one; null and texts without a word have none.
    """
    at = 0
    while at < len(texts):
        part, held = [], 0
        while at < len(texts) and (not part or held + len(texts[at] or b"") <= TOGETHER):
            part.append(texts[at] or b"")
            held += len(part[-1])
            at += 1
        words, counts = _word_hashes(part)
        chain = words
        for j in range(1, width):
            chain = mixed(chain[: len(words) - j] * np.uint64(_BASE) + words[j:]) if len(words) > j else chain[:0]
        stop = 0
        for n in counts.tolist():
            start, stop = stop, stop + n
            if n >= width:
                yield np.unique(chain[start : stop - width + 1])
            elif n:
                whole = words[start : start + 1]
                for j in range(1, n):
                    whole = mixed(whole * np.uint64(_BASE) + words[start + j : start + j + 1])
                yield whole + np.uint64(n)
            else:
                yield words[:0]


def min_hashes(sets: list[np.ndarray], count: int, seed: int = 43) -> np.ndarray:
    """Minwise tokens: for each set and each of ``count`` hash functions the least 32-bit value."""
    rng = np.random.default_rng(seed)
    salt = rng.integers(0, 1 << 32, count).astype(np.uint32)
    factor = (rng.integers(0, 1 << 31, count) * 2 + 1).astype(np.uint32)
    out = np.full((len(sets), count), 0xFFFFFFFF, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    for at in range(0, len(some), 512):
        rows = some[at : at + 512]
        starts = np.cumsum([0, *[len(sets[i]) for i in rows[:-1]]])
        x = (np.concatenate([sets[i] for i in rows]) >> np.uint64(32)).astype(np.uint32)
        for j in range(count):
            v = (x ^ salt[j]) * factor[j]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x85EBCA6B)
            out[rows, j] = np.minimum.reduceat(v, starts)
    return out


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed 64-bit numbers."""
    a, b = mixed(hashes), mixed(~hashes)
    pair = np.array([np.add.reduce(a, dtype=np.uint64), np.bitwise_xor.reduce(b) if len(b) else 0], np.uint64)
    return tuple(pair.view(np.int64).tolist())
