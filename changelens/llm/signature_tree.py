"""Signature trees over token sets: the in-memory part of the similarity join.

A tree's leaves are runs of sets in order of size; every node holds the OR of the
token bitmaps below it, the range of sizes and the largest number of tokens
that share a bit with others of their set.  A dual traversal visits pairs of nodes and drops a pair
when no two sets below can reach the similarity: the sizes are too far apart,
or the bits that both nodes have, and so the tokens that any two sets can
share, are too few.
"""

from __future__ import annotations

import numpy as np

FANOUT = 4
LEAF = 32                  # rows of a leaf, compared at once


def reaches(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def bits_of(tokens: np.ndarray, width: int) -> np.ndarray:
    """Bitmap of a token set, as 64-bit words (``width`` a power of two >= 64)."""
    out = np.zeros(width, np.uint8)
    out[(tokens >> np.uint64(24)) & np.uint64(width - 1)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def width_for(n: int, per_token: int) -> int:
    return 1 << max(6, (n * per_token - 1).bit_length())


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap of fewer words: OR of the parts."""
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


class Groups:
    """Disjoint groups of row numbers."""

    def __init__(self, labels):
        first: dict = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


class Tree:
    """Rows (in order of size) with bitmaps, sizes and what they can still share;
    ``levels[0]`` are leaves of up to ``LEAF`` rows."""

    def __init__(self, sizes: np.ndarray, left: np.ndarray, bits: np.ndarray):
        # tokens that share a bit with another token of their set
        slack = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.rows = (bits, sizes, sizes, slack, left)
        # one leaf needs no nodes: its rows are compared at once
        self.levels = [_above(self.rows, LEAF) if len(sizes) > LEAF else self.rows]
        while len(sizes) > LEAF and len(self.levels[-1][0]) > 1:
            self.levels.append(_above(self.levels[-1], FANOUT))

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))


def _above(nodes: tuple, width: int) -> tuple:
    b, lo, hi, s, left = nodes
    at = np.arange(0, len(b), width)
    return (np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
            np.maximum.reduceat(s, at), np.maximum.reduceat(left, at))


def may_reach(nodes: tuple, xs: slice, ys, percent: int) -> np.ndarray:
    """Whether nodes (or rows) ``xs`` and ``ys`` may hold similar sets, as a matrix."""
    b, lo, hi, s, left = nodes
    shared = np.bitwise_count(b[xs, None] & b[ys]).sum(axis=2, dtype=np.int64) + np.minimum(s[xs, None], s[ys])
    for bound in (hi, left):
        shared = np.minimum(shared, np.minimum(bound[xs, None], bound[ys]))
    least = np.maximum(lo[xs, None], lo[ys])         # of the larger set: at least this size
    return 100 * shared >= percent * np.maximum(lo[xs, None] + lo[ys] - shared, least)


def similar(sizes: np.ndarray, left: np.ndarray, bits: np.ndarray, percent: int, check, groups: Groups) -> None:
    """Dual traversal.  ``left`` bounds what a row can share with any other.
    ``check(i, j)`` is called for the pairs of rows that are not pruned and not in
    one group yet; it may join their groups."""
    n = len(sizes)
    tree = Tree(sizes, left, bits)
    find = groups.find

    def rows(level: int, node: int) -> slice:
        width = LEAF * FANOUT ** level
        return slice(node * width, min((node + 1) * width, n))

    whole: dict = {}

    def one_group(level: int, node: int):
        """The group of all rows below a node, or None; groups only grow."""
        known = whole.get((level, node))
        if known is None:
            r = rows(level, node)
            first = find(r.start)
            if any(find(i) != first for i in range(r.start + 1, r.stop)):
                return None
            known = whole[(level, node)] = r.start
        return find(known)

    def leaves(x: int, y: int) -> None:
        xs, ys = rows(0, x), rows(0, y)
        allowed = may_reach(tree.rows, xs, ys, percent)
        if x == y:
            allowed = np.triu(allowed, 1)
        i, j = np.nonzero(allowed)
        for i, j in zip((i + xs.start).tolist(), (j + ys.start).tolist()):
            if find(i) != find(j):
                check(i, j)

    def cross(level: int, x: int, ys: list[int]) -> None:
        """All rows below x against all rows below the nodes ys."""
        own = one_group(level, x)
        ys = [y for y in ys if own is None or one_group(level, y) != own]
        if ys:
            ys = np.array(ys)[may_reach(tree.levels[level], slice(x, x + 1), ys, percent)[0]].tolist()
        for y in ys:
            if level == 0:
                leaves(x, y)
            else:
                for c in tree.children(level, x):
                    cross(level - 1, c, list(tree.children(level, y)))

    def inside(level: int, x: int) -> None:
        if level == 0:
            leaves(x, x)
            return
        if one_group(level, x) is not None:
            return
        kids = list(tree.children(level, x))
        for c in kids:
            inside(level - 1, c)
        for k, c in enumerate(kids):
            if kids[k + 1:]:
                cross(level - 1, c, kids[k + 1:])

    inside(len(tree.levels) - 1, 0)
