"""Suffix order of a byte buffer by a difference cover, and the suffixes whose first bytes occur twice.

The sample of a buffer are the positions whose residue modulo v is in a difference cover D: for any two positions i and
j some d < v puts both i + d and j + d into it. The sample is ranked first, by its first v * 2**k bytes, doubling from blocks
of v bytes; it has |D| / v of the positions, so ranks of long prefixes take little memory. Then the suffixes are sorted one
bucket at a time: a bucket shares the first v bytes, and inside it two suffixes are compared by the ranks at their common d,
all buckets at once, each around a pivot of its own. Neighbours in that order have the longest common prefixes.

All names and ranks come from sorted bytes; nothing here is a hash.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np

U = np.uint64


@lru_cache
def difference_set(q: int) -> tuple[int, ...]:
    """A perfect difference set modulo q*q + q + 1 for a prime q: the zeros of a linear recurrence of order three
    over the integers modulo q (Singer's construction), found by trying its coefficients."""
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        s = [0, 0, 1]
        while len(s) < v:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % q)
        zeros = [i for i, x in enumerate(s) if x == 0]
        if len(zeros) == q + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
            return tuple(zeros)
    raise ValueError(f"{q} is not a prime")


def cover_of(most: int, primes=(17, 13, 11, 7, 5, 3, 2)) -> tuple[int, np.ndarray]:
    """The period and the set of the largest difference cover with a period of at most ``most`` (at least 7)."""
    q = next((q for q in primes if q * q + q + 1 <= most), 2)
    return q * q + q + 1, np.array(difference_set(q))


@lru_cache
def _common(q: int) -> np.ndarray:
    """By two residues, the least d that puts both into the cover."""
    d, v = np.array(difference_set(q)), q * q + q + 1
    out = np.full((v, v), v, np.int64)
    for x, y in product(d.tolist(), d.tolist()):
        for t in range(v):  # residues i and j with i + t = x and j + t = y
            i, j = (x - t) % v, (y - t) % v
            out[i, j] = min(out[i, j], t)
    return out


def _sorted_keys(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of at most ``most``, stable, and the keys in it. Keys that leave room for their places are sorted with
    them as one number, several times as fast."""
    low = max(1, (len(key) - 1).bit_length())
    if most.bit_length() + low > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key.astype(U) << U(low) | np.arange(len(key), dtype=U))
    return (both & U((1 << low) - 1)).astype(np.int64), both >> U(low)


def _names(key: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Dense ranks of the keys, from 1, and the largest."""
    order, s = _sorted_keys(key, most)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    out = np.empty(len(s), np.uint32)
    out[order] = rank = np.cumsum(new, dtype=np.uint32)
    return out, int(rank[-1]) if len(s) else 0


def _doubled(name: np.ndarray, top: int, step: int) -> tuple[np.ndarray, int]:
    """Names of pairs: a name and the one ``step`` places on (0 past the end)."""
    key = name.astype(U) * U(top + 1)
    if step < len(name):
        key[: len(name) - step] += name[step:]
    return _names(key, (top + 1) ** 2)


def block_names(data: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """For each position the rank of its first ``width`` bytes (fewer at the end), and the largest rank."""
    used = np.bincount(data, minlength=256) > 0
    code = np.cumsum(used).astype(U)[data]  # from 1, in the order of the bytes
    bits = int(used.sum()).bit_length()
    have = max(1, min(width, (64 - max(1, (len(data) - 1).bit_length())) // bits))
    key = np.zeros(len(data), U)
    for i in range(have):
        key <<= U(bits)
        key[: max(0, len(data) - i)] |= code[i:]
    name, top = _names(key, 1 << (bits * have))
    while have < width:
        step = min(have, width - have)
        name, top = _doubled(name, top, step)
        have += step
    return name, top


class SuffixOrder:
    """``order``: the suffixes at ``start``, sorted by their first ``length`` bytes; ``common``: by neighbours in it, whether
    these agree in all of them. Each suffix has at least ``length`` bytes; what follows these may take part in the order."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: int, seed: int = 1):
        self.v, cover = cover_of(min(length, 31))
        self.q, self.size, self.length = len(cover) - 1, len(cover), length
        self.block, self.most = block_names(data, min(self.v, length))
        # The cover sample in text order: the position v further on is |D| entries further on.
        self.place = (np.arange(0, len(data) + self.v, self.v)[:, None] + cover[None, :]).ravel()
        self.place = self.place[self.place < len(data)]
        self.entry = np.zeros(self.v, np.int64)
        self.entry[cover] = np.arange(self.size)
        self.levels, top = [self.block[self.place]], self.most  # ranks by v * 2**k bytes
        while self.v << (len(self.levels) - 1) < length:
            name, top = _doubled(self.levels[-1], top, self.size << (len(self.levels) - 1))
            self.levels.append(name)
        self.order = self._sorted(start, np.random.RandomState(seed))
        self.common = self._common(self.order[:-1], self.order[1:])

    def _sample(self, position: np.ndarray) -> np.ndarray:
        return position // self.v * self.size + self.entry[position % self.v]

    def _rank(self, level: int, position: np.ndarray) -> np.ndarray:
        """Of sample positions; past the end: 0."""
        at = self._sample(position)
        ranks = self.levels[level]
        return np.where(at < len(ranks), ranks[np.minimum(at, len(ranks) - 1)], 0)

    def _sorted(self, start: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
        order, name = _sorted_keys(self.block[start], self.most)
        order = start[order]
        if len(order) < 2:
            return order
        new = np.append(True, name[1:] != name[:-1])
        group = np.cumsum(new) - 1
        live = np.flatnonzero(np.bincount(group)[group] > 1)  # places in order that are still to be sorted
        group, table, top = group[live], _common(self.q), len(self.levels) - 1
        while len(live):
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(first, len(group)))
            own = np.repeat(np.arange(len(first)), size)
            pivot = order[live[first + rng.randint(0, 1 << 62, len(first)) % size]][own]
            here = order[live]
            d = table[here % self.v, pivot % self.v]
            mine, its = self._rank(top, here + d), self._rank(top, pivot + d)
            side = own * 3 + (mine > its) + (mine >= its)
            moved, side = _sorted_keys(side, 3 * len(first))
            order[live], side = here[moved], side.astype(np.int64)
            count = np.bincount(side, minlength=3 * len(first))
            more = (side % 3 != 1) & (count[side] > 1)
            live, group = live[more], side[more]
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the first ``length`` bytes at a and b are the same: the first and the last v bytes by their names, those between by
        two blocks of sample ranks."""
        same = self.block[a] == self.block[b]
        i = np.flatnonzero(same)
        x, y = a[i], b[i]
        good = self.block[x + self.length - min(self.v, self.length)] == self.block[y + self.length - min(self.v, self.length)]
        d = _common(self.q)[x % self.v, y % self.v]
        left = (self.length - d) // self.v  # whole blocks of v bytes from the common sample position on
        for k in range(len(self.levels)):
            some = np.flatnonzero((left >> k == 1) & good)
            if len(some):
                far = d[some] + (left[some] - (1 << k)) * self.v
                p, q = x[some], y[some]
                good[some] = (self._rank(k, p + d[some]) == self._rank(k, q + d[some])) & (self._rank(k, p + far) == self._rank(k, q + far))
        same[i] = good
        return same


def repeated(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Of the suffixes at ``start`` those whose first ``length`` bytes another one has too."""
    found = SuffixOrder(data, start, length)
    again = np.zeros(len(data), bool)
    again[found.order[:-1][found.common]] = True
    again[found.order[1:][found.common]] = True
    return again[start]
