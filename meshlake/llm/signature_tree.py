"""Exact Jaccard links within one block of token sets, by dual traversal of a signature tree.

Each node holds the OR of its sets' token bitmaps, their range of sizes and the most tokens that any of
them hides behind bits shared within the set. From two nodes the traversal computes the most tokens that
two of their sets can share, and drops the pair if that is too few, or if all sets of both are connected
already."""

from __future__ import annotations

import numpy as np

#: Bits of a bitmap, children of a node, leaders that are compared with all sets before the traversal.
BITS, FAN, LEADERS = 2048, 8, 6


class Sets:
    """Sets of 64-bit tokens, each sorted and distinct."""

    def __init__(self, tokens: list[np.ndarray]):
        self.tokens = tokens
        self.n = np.array([len(t) for t in tokens], np.int64)
        self.up = np.arange(len(tokens))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def labels(self) -> np.ndarray:
        """The smallest index of each set's component."""
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up.copy()
        return up

    def link(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a


def linked(overlap, a, b, num: int, den: int):
    return den * overlap >= num * (a + b - overlap)


def _bitmaps(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    maps = np.zeros((len(sets.n), BITS // 64), np.uint64)
    for i, t in enumerate(sets.tokens):
        bit = (t >> np.uint64(20)) % np.uint64(BITS)
        np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return maps, sets.n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)


class Level:
    def __init__(self, maps, hidden, low, high):
        self.maps, self.hidden, self.low, self.high = maps, hidden, low, high

    def parent(self) -> Level:
        cut = np.arange(0, len(self.low), FAN)
        return Level(np.bitwise_or.reduceat(self.maps, cut), np.maximum.reduceat(self.hidden, cut), np.minimum.reduceat(self.low, cut), np.maximum.reduceat(self.high, cut))

    def possible(self, a, b, num, den) -> np.ndarray:
        """Whether some set of node a may link to some set of node b: links need
        overlap >= num/(num+den) of the sizes' sum, and num/den of the larger size."""
        shared = np.bitwise_count(self.maps[a] & self.maps[b]).sum(axis=1).astype(np.int64)
        most = np.minimum(shared + np.minimum(self.hidden[a], self.hidden[b]), np.minimum(self.high[a], self.high[b]))
        least = np.maximum(self.low[a], self.low[b])
        return ((num + den) * most >= num * (self.low[a] + self.low[b])) & (den * most >= num * least)


def links(tokens: list[np.ndarray], num: int = 3, den: int = 4, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs whose similarity is num/den or more and which connect the sets: a spanning forest of all links.
    ``known``: labels of components found before, within which no pair is sought."""
    sets = Sets(tokens)
    if known is not None:
        first: dict[int, int] = {}
        for i, k in enumerate(known.tolist()):
            sets.link(i, first.setdefault(k, i))
    out: list[tuple[int, int]] = []
    if len(tokens) < 2:
        return out
    # sets that share their least tokens stand together
    order = sorted(range(len(tokens)), key=lambda i: (tokens[i][:2].tolist(), len(tokens[i])))
    place = np.array(order)
    if len(tokens) > 2 * LEADERS:
        _leaders(sets, order, num, den, out)
    maps, hidden = _bitmaps(sets)
    levels = [Level(maps[place], hidden[place], sets.n[place], sets.n[place])]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].parent())
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        if depth < len(levels) - 1:
            a, b = _children(a, b, len(level.low))
        comp = sets.labels()[place]
        size = FAN**depth
        cut = np.arange(0, len(place), size)
        low, high = np.minimum.reduceat(comp, cut), np.maximum.reduceat(comp, cut)
        live = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[live], b[live]
        keep = np.concatenate([level.possible(a[k : k + 65536], b[k : k + 65536], num, den) for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
        a, b = a[keep], b[keep]
    for i, j in zip(place[a].tolist(), place[b].tolist()):
        if i != j and sets.root(i) != sets.root(j) and _exact(sets, i, j, num, den):
            sets.link(i, j)
            out.append((i, j))
    return out


def _exact(sets: Sets, i: int, j: int, num: int, den: int) -> bool:
    x, y = sets.tokens[i], sets.tokens[j]
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    overlap = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return bool(linked(overlap, len(x), len(y), num, den))


def _leaders(sets: Sets, order: list[int], num: int, den: int, out: list[tuple[int, int]]) -> None:
    """Compares a few sets with all others at once, so that one group of near copies is one component."""
    flat, first = np.concatenate(sets.tokens), np.concatenate([[0], np.cumsum(sets.n)])[:-1]
    step = max(1, len(order) // LEADERS)
    for lead in order[::step][:LEADERS]:
        own = sets.tokens[lead]
        at = np.searchsorted(own, flat)
        same = (own[np.minimum(at, len(own) - 1)] == flat).astype(np.int64)
        overlap = np.add.reduceat(same, first)
        for i in np.flatnonzero(linked(overlap, sets.n, len(own), num, den)).tolist():
            if sets.root(i) != sets.root(lead):
                sets.link(i, lead)
                out.append((i, lead))


def _children(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij")
    x = (a[:, None] * FAN + i.ravel()).ravel()
    y = (b[:, None] * FAN + j.ravel()).ravel()
    ok = (x < n) & (y < n) & (x <= y)
    return x[ok], y[ok]
