"""MinHash signatures in numpy, and tensored bands of them.

Tensored banding keeps two collections of M band halves, each of HALF hashes. A table of the search is a pair, one half of each
collection, so 2 * M * HALF hash functions serve M * M tables of 2 * HALF hashes. Two sets of similarity s meet in a table with
probability (1 - (1 - s ** HALF) ** M) ** 2.
"""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def functions(count: int, seed: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of `count` hash functions."""
    rng = np.random.default_rng(seed)
    kind = np.uint64 if bits == 64 else np.uint32
    draw = lambda: rng.integers(0, 1 << 32, count, dtype=np.uint64)
    factors, offsets = draw() << np.uint64(32) | draw(), draw() << np.uint64(32) | draw()
    return (factors | np.uint64(1)).astype(kind), offsets.astype(kind)


def minima(hashes: np.ndarray, starts: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes that begins at starts (none empty), and each function, the least value: runs x functions."""
    out = np.empty((len(starts), len(factors)), hashes.dtype)
    room = np.empty_like(hashes)
    for k, (a, b) in enumerate(zip(factors, offsets, strict=True)):
        np.multiply(hashes, a, out=room)
        np.add(room, b, out=room)
        out[:, k] = np.minimum.reduceat(room, starts)
    return out


def extremes(hashes: np.ndarray, starts: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes that begins at starts (none empty), and each function, the least value, and after those of all functions the greatest ones: runs x 2 * functions.

    Of two sets of similarity s, either is the same with probability s, and both with s * s at most: a shared item that is first leaves one less to be last.
    So bands of least and bands of greatest values find a pair at least as often as bands of as many separate functions."""
    count = len(factors)
    out = np.empty((2 * count, len(starts)), hashes.dtype)
    room = np.empty_like(hashes)
    for k, (a, b) in enumerate(zip(factors, offsets, strict=True)):
        np.multiply(hashes, a, out=room)
        np.add(room, b, out=room)
        np.minimum.reduceat(room, starts, out=out[k])
        np.maximum.reduceat(room, starts, out=out[count + k])
    return out.T


def halves(minima_: np.ndarray, half: int) -> np.ndarray:
    """Joins each `half` neighbouring columns to one signed 64-bit key that also tells its place."""
    n, count = minima_.shape
    parts = minima_.astype(np.uint64).reshape(n, count // half, half)
    key = np.broadcast_to(np.arange(1, count // half + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, count // half)).copy()
    for k in range(half):
        key = mixed(key ^ parts[:, :, k])
    return key.view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all (the splitmix finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_shingles(words: list[bytes], of_word: dict[bytes, int], size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of `size` words; of fewer words, of all of them as one; of none, none."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(of_word.__getitem__, words), np.uint64, len(words))
    run = min(size, len(words))
    h = np.full(len(words) - run + 1, run, np.uint64)
    for k in range(run):
        h = (h ^ each[k : len(each) - run + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit id of a set, from its sorted hashes."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), len(hashes)) - (1 << 63)
