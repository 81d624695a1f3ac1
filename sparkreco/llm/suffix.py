"""Blockwise suffix sorting with a difference cover.

The ranks of the suffixes at the places of a difference cover modulo v are worked out once. Any two suffixes that agree on v
bytes then compare by the ranks of two cover places at the same distance from both. So suffixes can be sorted one bucket of
first bytes at a time, with memory for one bucket and for the cover ranks, however long the repeats are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import numpy as np


@lru_cache(8)
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues whose differences meet every residue modulo v; each added one covers most that is missing."""
    chosen, covered = [0], {0}
    while len(covered) < v:
        gain = [(len({(c - x) % v for x in chosen} | {(x - c) % v for x in chosen} | covered), -c) for c in range(v)]
        c = -max(gain)[1]
        covered |= {(c - x) % v for x in chosen} | {(x - c) % v for x in chosen}
        chosen.append(c)
    return tuple(sorted(chosen))


class SuffixSorter:
    """Sorts suffixes of text (uint8). With depth, suffixes that agree on that many bytes may come in any order.

    used: which places belong to suffixes that are of interest; only these cover places are ranked (with depth).
    """

    def __init__(self, text: np.ndarray, v: int = 32, depth: int | None = None, used: np.ndarray | None = None):
        self.n, self.v, self.depth = len(text), v, depth
        cover = np.array(difference_cover(v))
        self.slot = np.full(v, -1, np.int64)
        self.slot[cover] = np.arange(len(cover))
        self.width = len(cover)
        #: From each residue the distance to the next cover place, and for two residues the distance to cover places of both.
        self.step = np.array([min(d for d in range(v) if self.slot[(r + d) % v] >= 0) for r in range(v)])
        self.common = np.array([[min(d for d in range(v) if self.slot[(a + d) % v] >= 0 and self.slot[(b + d) % v] >= 0) for b in range(v)] for a in range(v)])
        self.padded = np.concatenate([text, np.zeros(2 * v + 8, np.uint8)])
        self.view = np.ndarray((len(self.padded) - 7,), "<u8", self.padded, strides=(1,))
        self._rank_cover(cover, depth or self.n + v + 1, used)

    def key8(self, places: np.ndarray) -> np.ndarray:
        """The next eight bytes, as a number of the same order."""
        return self.view[np.minimum(places, len(self.view) - 1)].byteswap()

    def by_bytes(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by the first v bytes, and where in it other bytes begin. Only what is still tied is looked at again."""
        key = self.key8(places)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        for d in range(8, self.v, 8):
            slots = _tied(new)
            if not len(slots):
                break
            own = order[slots]
            key = self.key8(places[own] + d)
            again = np.lexsort((key, np.cumsum(new)[slots]))
            order[slots], key = own[again], key[again]
            new[slots[1:]] |= key[1:] != key[:-1]
        return order, new

    def _rank_cover(self, cover: np.ndarray, depth: int, used: np.ndarray | None) -> None:
        v = self.v
        rows = -(-(self.n + 1) // v)
        places = (np.arange(rows)[:, None] * v + cover[None, :]).ravel()
        inside = np.flatnonzero(places < self.n)
        if used is not None:
            inside = inside[used[places[inside]]]
        own = places[inside]
        order, new = self.by_bytes(own)
        self.rank, h = np.zeros(len(places), np.int64), v
        self.rank[inside[order]] = np.cumsum(new)
        while h < depth and len(slots := _tied(new)):
            found = order[slots]
            after = self.cover_rank(own[found] + h)
            after -= after.min()
            both = np.cumsum(new)[slots] << 32 | after
            again = np.argsort(both)
            order[slots], both = found[again], both[again]
            new[slots[1:]] |= both[1:] != both[:-1]
            self.rank[inside[order]] = np.cumsum(new)
            h *= 2

    def cover_rank(self, places: np.ndarray) -> np.ndarray:
        """Ranks of suffixes at cover places; beyond the end the farther place is the shorter, and so the smaller suffix."""
        beyond = places >= self.n
        at = np.where(beyond, 0, places)
        found = self.rank[at // self.v * self.width + np.maximum(self.slot[at % self.v], 0)]
        return np.where(beyond, self.n - places - 1, found)

    def buckets(self, places: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Places by their first two bytes, neighbouring pairs together up to most places."""
        first = self.padded[places].astype(np.int64) * 256 + self.padded[places + 1]
        total = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=65536))])
        lo = 0
        while lo < 65536:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
            if total[hi] > total[lo]:
                yield places[(first >= lo) & (first < hi)] if total[hi] - total[lo] < len(places) else places
            lo = hi

    def sort(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One bucket's places in the order of their suffixes, and which differ from the one before in their first v bytes."""
        places = places.astype(np.int64)
        order, new = self.by_bytes(places)
        places = places[order]
        slots = _tied(new)
        if len(slots):
            own, group = places[slots], np.cumsum(new)[slots]
            residue = own % self.v
            key = self.cover_rank(own + self.step[residue])
            own = own[np.argsort(group << 32 | key - key.min())]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            # groups of more than one residue: their ranks are not at the same distance
            mixed = np.minimum.reduceat(residue, starts) != np.maximum.reduceat(residue, starts)
            sizes = np.diff(np.concatenate([starts, [len(group)]]))
            if mixed.any() and self.depth:
                m = np.repeat(mixed, sizes)
                part = own[m]
                rest = [*range(self.v, self.depth - 8, 8), self.depth - 8]
                own[m] = part[np.lexsort([self.key8(part + d) for d in reversed(rest)] + [group[m]])]
            elif mixed.any():
                for s, e in zip(starts[mixed], (starts + sizes)[mixed], strict=True):
                    own[s:e] = sorted(own[s:e].tolist(), key=cmp_to_key(self.compare))
            places[slots] = own
        return places, new

    def compare(self, a: int, b: int) -> int:
        """Of two places that agree on v bytes."""
        d = int(self.common[a % self.v, b % self.v])
        x, y = self.cover_rank(np.array([a + d, b + d]))
        return int(x > y) - int(x < y)

    def array(self, most: int = 1 << 20) -> np.ndarray:
        """The whole suffix array, bucket by bucket."""
        parts = [self.sort(b)[0] for b in self.buckets(np.arange(self.n), most)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def runs(self, places: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Where in the sorted places runs begin that agree on depth bytes (v at least; all places must have them)."""
        new = new.copy()
        slots = np.flatnonzero(~new)
        a, b = places[slots - 1], places[slots]
        same = np.ones(len(slots), bool)
        for d in [*range(self.v, self.depth - 8, 8), self.depth - 8]:
            same &= self.key8(a + d) == self.key8(b + d)
        new[slots] = ~same
        return np.flatnonzero(new)


def _tied(new: np.ndarray) -> np.ndarray:
    """Which places share their group with a neighbour."""
    tied = ~new
    tied[:-1] |= ~new[1:]
    return np.flatnonzero(tied)
