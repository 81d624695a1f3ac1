"""Signature trees: which sets of a group reach a Jaccard similarity, up to connectivity.

A set's signature is a bitmap of its members' low hash bits. Sets lie in the order of their least members, so that like ones are neighbours. A
node holds the OR and the AND of its sets' bitmaps and the ranges of their sizes. Two trees (or one with itself) are walked
together; a pair of nodes is left when sizes or the largest overlap that the bitmaps allow rule out every pair of their sets, or
when all of their sets are already in one component. Sets that are left are compared exactly.
"""

from __future__ import annotations

import numpy as np

BITS, FANOUT = 1024, 8


class Tree:
    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, where: np.ndarray):
        """sizes: of the whole sets, of which sets hold the members that may be shared; where: numbers in the caller's group."""
        flags = np.zeros((len(sets), BITS), bool)
        for i, s in enumerate(sets):
            flags[i, (s & np.uint64(BITS - 1)).astype(np.int64)] = True
        bitmap = np.packbits(flags, axis=1).view(np.uint64)
        shared = np.array([len(s) for s in sets])
        self.sets, self.sizes, self.where = sets, sizes, where
        #: By level, from the sets up: OR, AND, least and largest size, most shared members.
        self.levels = [(bitmap, bitmap, sizes, sizes, shared)]
        while len(self.levels[-1][0]) > 1:
            some, every, low, high, most = self.levels[-1]
            at = np.arange(0, len(some), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(most, at)))

    def span(self, level: int, node: int) -> slice:
        """The sets below a node."""
        size = FANOUT**level
        return slice(node * size, min((node + 1) * size, len(self.sets)))

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))


def order_sets(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    return np.lexsort((sizes, [s[0] if len(s) else 0 for s in sets]))


class Linker:
    """Components of a group's sets; links are found by comparing sets of two trees."""

    def __init__(self, n: int, percent: int):
        self.root, self.percent = np.arange(n), percent

    def join(self, a: int, b: int) -> None:
        x, y = sorted((self.root[a], self.root[b]))
        self.root[self.root == y] = x

    def _possible(self, s: tuple, t: tuple, i, j) -> np.ndarray:
        """Whether sets below nodes i of s and j of t may be similar enough (i, j: arrays that fit together)."""
        p = self.percent
        low_i, high_i, low_j, high_j = s[2][i], s[3][i], t[2][j], t[3][j]
        sized = (high_j * 100 >= p * low_i) & (high_i * 100 >= p * low_j)
        # members whose bit no set on the other side has are shared with none of them
        i_only = np.bitwise_count(s[1][i] & ~t[0][j]).sum(-1, dtype=np.int64)
        j_only = np.bitwise_count(t[1][j] & ~s[0][i]).sum(-1, dtype=np.int64)
        most = np.minimum(s[4][i] - i_only, t[4][j] - j_only)
        return sized & (most * (100 + p) >= p * (low_i + low_j))

    def _compare(self, s: Tree, i: int, t: Tree, j: int) -> None:
        a, b = s.where[i], t.where[j]
        if self.root[a] != self.root[b]:
            x, y = s.sets[i], t.sets[j]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            if 100 * shared >= self.percent * (int(s.sizes[i]) + int(t.sizes[j]) - shared):
                self.join(a, b)

    def within(self, tree: Tree) -> None:
        for i in range(len(tree.sets) - 1):  # neighbours first: what they connect needs no walk
            self._compare(tree, i, tree, i + 1)
        self.between(tree, tree)

    def between(self, s: Tree, t: Tree) -> None:
        same = s is t
        todo = [(len(s.levels) - 1, 0, len(t.levels) - 1, 0)]
        while todo:
            ls, i, lt, j = todo.pop()
            if ls == 0 and lt == 0:
                if not same or i < j:
                    self._compare(s, i, t, j)
                continue
            a, b = self.root[s.where[s.span(ls, i)]], self.root[t.where[t.span(lt, j)]]
            if (a == a[0]).all() and (b == a[0]).all():
                continue
            cs = np.array(s.children(ls, i) if ls else [i])
            ct = np.array(t.children(lt, j) if lt else [j])
            ls, lt = max(ls - 1, 0), max(lt - 1, 0)
            x, y = np.repeat(cs, len(ct)), np.tile(ct, len(cs))
            if same:
                x, y = x[x <= y], y[x <= y]
            keep = self._possible(s.levels[ls], t.levels[lt], x, y)
            if same:
                keep |= x == y
            todo.extend((ls, int(u), lt, int(v)) for u, v in zip(x[keep][::-1], y[keep][::-1], strict=True))
