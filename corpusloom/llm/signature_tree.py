"""Signature trees over token sets: nodes hold OR-ed token bitmaps and size ranges.

`linked` walks two trees together and leaves a pair of nodes as soon as no pair of sets
below them can overlap enough, or all of them are already in one group.
"""

from __future__ import annotations

import numpy as np

BITS, FANOUT = 2048, 8


class Groups:
    """Union-find over positions; the root of a group is its least position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class Node:
    """least, most: sizes below; extra: most tokens that a set below loses to shared bits."""

    __slots__ = ("bits", "extra", "kids", "least", "members", "most", "one")

    def __init__(self, members, kids, bits, least, most, extra):
        self.members, self.kids, self.bits, self.least, self.most, self.extra = members, kids, bits, least, most, extra
        self.one = len(members) == 1

    def root(self, groups: Groups) -> int:
        """The one group of all members, or -1."""
        r = groups.find(self.members[0])
        if not self.one:
            if any(groups.find(m) != r for m in self.members):
                return -1
            self.one = True  # groups only grow
        return r


def build(sets: list[np.ndarray], members: list[int]) -> Node:
    """Bulk load: leaves in order of size, FANOUT to a node."""
    level = []
    for m in sorted(members, key=lambda i: (len(sets[i]), i)):
        at = (sets[m] >> np.uint64(20)).astype(np.int64) & (BITS - 1)
        flags = np.zeros(BITS, bool)
        flags[at] = True
        bits = int.from_bytes(np.packbits(flags).tobytes(), "big")
        n = len(sets[m])
        level.append(Node([m], None, bits, n, n, n - bits.bit_count()))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), FANOUT):
            kids = level[i : i + FANOUT]
            bits = 0
            for k in kids:
                bits |= k.bits
            up.append(Node([m for k in kids for m in k.members], kids, bits, min(k.least for k in kids), max(k.most for k in kids), max(k.extra for k in kids)))
        level = up
    return level[0]


def similar(x: frozenset, y: frozenset, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def linked(a: Node, b: Node, sets: list[frozenset], groups: Groups, percent: int) -> None:
    """Join the groups of all pairs, one set below a and one below b, that are similar enough."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x is not y:
            if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least:
                continue
            most = min((x.bits & y.bits).bit_count() + min(x.extra, y.extra), x.most, y.most)
            if (100 + percent) * most < percent * (x.least + y.least):
                continue
        r = x.root(groups)
        if r >= 0 and r == (r if x is y else y.root(groups)):
            continue
        if x is y:
            kids = x.kids or []
            stack.extend((kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids)))
        elif x.kids is None and y.kids is None:
            if similar(sets[x.members[0]], sets[y.members[0]], percent):
                groups.join(x.members[0], y.members[0])
        elif y.kids is None or (x.kids is not None and len(x.members) >= len(y.members)):
            stack.extend((k, y) for k in x.kids)
        else:
            stack.extend((x, k) for k in y.kids)
