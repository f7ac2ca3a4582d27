"""Deep-shallow sorting of fixed-width suffixes.

Shallow: multikey quicksort over eight-byte characters, all open groups at once; each
round sorts every group by its next character, and only rows that are equal so far go on
to the one after.  Deep: groups that still share the shallow prefix are ordered by blind
tries of their distinct suffixes (one branch byte a node, one full comparison an
insertion).  Equal suffixes meet in one leaf.
"""

from __future__ import annotations

import numpy as np


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(group, prepend=group[:1] - 1))


def multikey(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order rows of big-endian words by their first `depth` words; (order, group number of each sorted row)."""
    n = len(words)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for char in range(depth):
        size = np.bincount(group)
        open_rows = np.flatnonzero(size[group] > 1) if n else order  # rows of a group of one are done
        if not len(open_rows):
            break
        o, g = order[open_rows], group[open_rows]
        key = words[o, char]
        by = np.argsort(key)
        rank = np.empty(len(o), np.int64)
        rank[by] = np.cumsum(np.diff(key[by], prepend=key[by[:1]]) != 0)
        both = g * len(o) + rank
        by = np.argsort(both) if char else by  # groups stay in place
        order[open_rows] = o[by]
        part = np.zeros(n, np.int64)
        part[open_rows] = rank[by]
        head = np.diff(group, prepend=group[:1]) != 0
        head[1:] |= part[1:] != part[:-1]
        group = np.cumsum(head)
    return order, group


class _Node:
    __slots__ = ("depth", "kids", "number", "rows", "text")

    def __init__(self, depth, kids=None, rows=None, text=None, number=0):
        self.depth, self.kids, self.rows, self.text, self.number = depth, kids, rows, text, number


def blind_trie(texts: list[bytes], rows: list[int]) -> list[int]:
    """Rows ordered by their texts, which are of one length."""
    equal: dict[bytes, list[int]] = {}
    for text, row in zip(texts, rows, strict=True):
        equal.setdefault(text, []).append(row)
    root = None
    for text, mine in equal.items():
        leaf = _Node(len(text), rows=mine, text=text, number=int.from_bytes(text))
        if root is None:
            root = leaf
            continue
        node = root
        while node.kids:  # blind: only branch bytes are looked at
            node = node.kids.get(text[node.depth]) or next(iter(node.kids.values()))
        at = len(text) - ((leaf.number ^ node.number).bit_length() + 7 >> 3)  # the first byte that differs
        parent, node = None, root
        while node.depth < at:
            parent, node = node, node.kids[text[node.depth]]
        if node.depth == at and node.kids:
            node.kids[text[at]] = leaf
            continue
        other = node
        while other.kids:
            other = next(iter(other.kids.values()))
        branch = _Node(at, kids={other.text[at]: node, text[at]: leaf})
        if parent is None:
            root = branch
        else:
            parent.kids[text[parent.depth]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.kids:
            stack.extend(node.kids[b] for b in sorted(node.kids, reverse=True))
        else:
            out.extend(node.rows)
    return out


def as_words(rows: np.ndarray) -> np.ndarray:
    """Bytes (n, width) as big-endian eight-byte characters (n, ceil(width / 8))."""
    pad = -rows.shape[1] % 8
    rows = np.concatenate([rows, np.zeros((len(rows), pad), np.uint8)], axis=1) if pad else rows
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64).reshape(len(rows), rows.shape[1] // 8)


def deep_shallow(rows: np.ndarray, shallow: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes (n, width), and the common prefix of each sorted row with the one before it."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = as_words(rows)
    order, group = multikey(words, min(shallow, words.shape[1]))
    if words.shape[1] > shallow:
        rest = words[order, shallow:]
        differs = np.zeros(n, bool)
        differs[1:] = (group[1:] == group[:-1]) & (rest[1:] != rest[:-1]).any(axis=1)
        first = _starts(group)
        last = np.append(first[1:], n)
        mixed = np.flatnonzero(np.logical_or.reduceat(differs, first))
        raw, at = np.ascontiguousarray(rows[:, 8 * shallow :]).tobytes(), width - 8 * shallow
        for f, e in zip(first[mixed].tolist(), last[mixed].tolist(), strict=True):
            mine = order[f:e].tolist()
            order[f:e] = blind_trie([raw[i * at : (i + 1) * at] for i in mine], mine)
    return order, _prefixes(words[order], width)


def _prefixes(words: np.ndarray, width: int) -> np.ndarray:
    """The common prefix, in bytes, of each row of big-endian words with the row before it."""
    lcp = np.zeros(len(words), np.int64)
    differ = words[1:] ^ words[:-1]
    at = np.argmax(differ != 0, axis=1)
    x = differ[np.arange(len(at)), at]
    same = sum((x < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))  # leading bytes that are equal
    lcp[1:] = np.where(x == 0, width, 8 * at + same)
    return lcp
