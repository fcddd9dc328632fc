"""Repeated windows over byte buffers, in numpy: polynomial hashes, sliding minima, exact window groups.

Hashes are sums of random byte values times powers of an odd base, modulo 2**64, so that any substring's
hash follows from two prefix sums. They only group candidates; equality is checked on the bytes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
TABLE = np.random.RandomState(7).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U) * U(2) + U(1)


_powers: list[np.ndarray] = []


def powers(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, grown on demand and kept by the worker."""
    if not _powers or len(_powers[0]) < size:
        n = 1 << max(16, (size - 1).bit_length())
        for base in (BASE, pow(BASE, -1, 2**64)):
            out = np.full(n, base, U)
            out[0] = 1
            _powers.append(np.cumprod(out, dtype=U))
        del _powers[:-2]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Hashes:
    """Hashes of substrings [start, end) of one buffer."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, U)
        np.cumsum(TABLE[data] * power[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(U))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, joined by one space: the new buffer, each word's start and end in it, and its row."""
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = ~space[inner]
    last = ~space
    last[:-1] &= space[1:] | first[1:]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    place = np.cumsum(keep) - 1
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(offsets, starts, "right") - 1
    packed = data[keep]
    packed[SPACE[packed]] = 0x20
    return packed, place[starts], place[ends] + 1, row


def runs_of(value: np.ndarray, row: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the maximal runs of valid neighbours with one value and row."""
    cut = np.ones(len(value), bool)
    cut[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    cut |= ~valid
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(value)) - 1
    good = valid[starts]
    return starts[good], ends[good]


def groups_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: Hashes | None = None) -> np.ndarray:
    """For each window the index of the first window with the same bytes."""
    h = (hashes or Hashes(data)).of(start, end)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    leader = np.empty(len(s), np.int64)
    leader[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    check = np.flatnonzero(leader != np.arange(len(leader)))
    if not len(check):
        return leader
    # Neighbouring windows whose leaders are neighbours too are compared at one go.
    cut = np.ones(len(check), bool)
    own, its = start[check], start[leader[check]]
    cut[1:] = (np.diff(check) != 1) | (np.diff(leader[check]) != 1) | (np.diff(own) != np.diff(its)) | (own[1:] > end[check[:-1]])
    a = check[cut]
    z = check[np.append(np.flatnonzero(cut)[1:], len(check)) - 1]
    raw = data.tobytes()
    wrong = [(x, y) for x, y, p, q, r, t in zip(a.tolist(), z.tolist(), start[a].tolist(), end[z].tolist(), start[leader[a]].tolist(), end[leader[z]].tolist(), strict=True) if raw[p:q] != raw[r:t]]
    if wrong:  # two texts with one hash: these groups are told apart by their bytes
        bad = np.isin(h, h[np.concatenate([np.arange(x, y + 1) for x, y in wrong])])
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(bad):
            leader[i] = seen.setdefault(raw[start[i] : end[i]], i)
    return leader
