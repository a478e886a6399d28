"""Words and shingles of many texts at once, as keyed 64-bit hashes, in numpy.

A word is read in lanes of eight bytes; each lane goes through a non-linear step that
depends on a key. Words of the same number of lanes step together, so the cost is a few
passes over the words; words of more than LONG bytes are hashed one by one. Operators
draw a fresh key for each run and hand it to their tasks, so no text can be made to
collide beforehand; two words of a run then share a hash with probability 2**-64.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 5)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte values that end a word of kind "space": [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Byte values that end a word of kind "alnum": [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


#: Words of more bytes are hashed by a digest each.
LONG = 512
#: Words that step together, so that what a step makes stays small.
PIECE = 1 << 15
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """Powers of a base modulo 2**64, for hashes that roll over bytes."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 18), base, np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= 1 << 20:  # a longer table serves one long text and goes
            _powers[name] = have
    return have


def fresh_key() -> int:
    """A key for the hashes of one run."""
    return secrets.randbits(64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def split(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows of UTF-8 bytes: (hash, first byte, end byte, first word of each row).

    ends says which lower-cased byte values separate words. Rows never share a word.
    """
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(rows + 1, np.int64)
    low = LOWER[data]
    inside = ~ends[low]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    joined = np.unique(cuts[inside[cuts] & inside[cuts - 1]])  # a word would run on into the next row
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    first, end = at[0::2], at[1::2]
    return hashes(low, first, end, key), first, end, np.searchsorted(first, offsets).astype(np.int64)


def hashes(low: np.ndarray, first: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """Hashes of the words low[first:end]."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(low) + 1, "<u8", padded, 0, (1,))  # eight bytes from each place on
    keys = mix(np.uint64(key) + np.arange(2, dtype=np.uint64) * _M1)
    left = end - first
    out = mix(left.astype(np.uint64) ^ keys[0])
    for i in np.flatnonzero(left > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(low[first[i] : end[i]].tobytes(), digest_size=8, key=keys.tobytes()).digest(), "little")
    for lo in range(0, len(first), PIECE):
        rows = np.flatnonzero(left[lo : lo + PIECE] <= LONG) + lo
        at, size = first[rows], left[rows]
        while len(rows):
            lane = lanes[at]
            tail = size < 8
            lane[tail] &= (np.uint64(1) << (size[tail] * 8).astype(np.uint64)) - np.uint64(1)
            out[rows] = mix((out[rows] ^ lane) * _M2 + keys[1])
            more = size > 8
            rows, at, size = rows[more], at[more] + 8, size[more] - 8
    return out


def same(low: np.ndarray, first: np.ndarray, end: np.ndarray, other: np.ndarray, other_first: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether the words low[first:end] equal the words other[other_first:other_end], byte by byte."""
    a, b = (np.ndarray(len(x) + 1, "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), 0, (1,)) for x in (low, other))
    left = end - first
    out = left == other_end - other_first
    for i in np.flatnonzero(out & (left > LONG)):
        out[i] = np.array_equal(low[first[i] : end[i]], other[other_first[i] : other_end[i]])
    for lo in range(0, len(first), PIECE):
        rows = np.flatnonzero(out[lo : lo + PIECE] & (left[lo : lo + PIECE] <= LONG)) + lo
        step = 0
        while len(rows):
            diff = a[first[rows] + step] ^ b[other_first[rows] + step]
            tail = left[rows] - step < 8
            diff[tail] &= (np.uint64(1) << ((left[rows[tail]] - step) * 8).astype(np.uint64)) - np.uint64(1)
            out[rows[diff != 0]] = False
            step += 8
            rows = rows[(diff == 0) & (left[rows] > step)]
    return out


def grams(hashed: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row, and where each row's begin.

    A row of fewer words, but not none, has its whole sequence as one.
    """
    counts = np.diff(starts)
    n = len(hashed)
    each = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(each)])
    if not n:
        return np.zeros(0, np.uint64), out_at
    lengths = np.minimum(counts, k)
    row = np.repeat(np.arange(len(counts)), each)
    at = starts[:-1][row] + (np.arange(out_at[-1]) - out_at[row])
    seed = np.random.default_rng(20240131).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = lengths[row]
    total = mix(size.astype(np.uint64) + seed[63])
    add = seed[(np.arange(k) + 17) % 63] * np.arange(1, k + 1, dtype=np.uint64)
    for j in range(k):
        piece = hashed[np.minimum(at + j, n - 1)] * seed[j % 63] + add[j]
        if (counts[counts > 0] < k).any():
            piece[size <= j] = 0
        total += mix(piece)
    return mix(total), out_at
