"""Vectorised byte and word kernels shared by the operators of this subpackage.

Everything here works on one *block* of documents (a bounded number of bytes)
held as a single byte buffer with document offsets, so the cost per byte is a
handful of numpy passes and no Python loop touches single words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_K = U64(0x9E3779B97F4A7C15)
_MASK8 = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 9)], dtype=np.uint64)

#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Place of null ids in every "smaller id" comparison: before all others.
NULL_ID = np.iinfo(np.int64).min


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def mix_into(x: np.ndarray, spare: np.ndarray) -> None:
    """`mix` in place, with another array of the size of x to work in."""
    for shift, by in ((30, _M1), (27, _M2), (31, None)):
        np.right_shift(x, U64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if by is not None:
            np.multiply(x, by, out=x)


def odd(seed: int, n: int) -> np.ndarray:
    """n odd multipliers from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _K + U64(seed)) | U64(1)


class Block:
    """Documents of one block in id order: ids, a byte buffer and offsets."""

    def __init__(self, ids: np.ndarray, buf: np.ndarray, off: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.buf, self.off, self.order = ids, buf, off, order

    @property
    def n(self) -> int:
        return len(self.ids)

    def pieces(self, step: int, overlap: int = 0):
        """Yield (first doc, last doc, start byte, end byte) of whole documents of about `step` bytes.

        A longer document comes alone, in steps that overlap by `overlap` bytes."""
        d = 0
        while d < self.n:
            e = int(np.searchsorted(self.off, self.off[d] + step, "right")) - 1
            if e > d:
                yield d, e, int(self.off[d]), int(self.off[e])
                d = e
                continue
            a, end = int(self.off[d]), int(self.off[d + 1])
            if not overlap:
                yield d, d + 1, a, end
            else:
                while True:
                    b = min(end, a + step + overlap)
                    yield d, d + 1, a, b
                    if b == end:
                        break
                    a = b - overlap
            d += 1


def to_block(table: pa.Table, id_col: str = "doc_id", text_col: str = "text") -> Block:
    """Order a block by (id, text); nulls in text count as empty, null ids come first."""
    text = table.column(text_col).cast(pa.large_binary()).combine_chunks()
    text = text.fill_null(b"") if text.null_count else text
    ids = table.column(id_col).cast(pa.int64()).combine_chunks()
    ids = (ids.fill_null(NULL_ID) if ids.null_count else ids).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():  # repeated ids: by text, so that order never depends on arrival
        raw = text.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], raw[i])))
    text, ids = text.take(pa.array(order)), ids[order]
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(ids) + 1]
    data = text.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return Block(ids, buf, off - off[0], order)


def words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (maximal runs of non-separators inside a document), and each document's first word index."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    is_word = ~sep[buf]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = is_word[edge]
    edge = off[1:][off[:-1] < off[1:]] - 1
    last[edge] = is_word[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as a little-endian integer (zero padded)."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,)).copy()


def eights_into(buf: np.ndarray, out: np.ndarray) -> None:
    """The eight bytes from each place of which all eight exist, as little-endian integers, to the start of out."""
    n = len(buf) - 7
    if n > 0:
        out[:n] = np.ndarray((n,), dtype="<u8", buffer=buf, strides=(1,))


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20, salt: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another odd salt gives an independent one."""
    by = U64(salt)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, a + step)))
        b = int(ends[j - 1])
        x8 = _eights(buf[a:b])
        s, ln = starts[i:j] - a, ends[i:j] - starts[i:j]
        h = mix((x8[s] & _MASK8[np.minimum(ln, 8)]) * by + ln.astype(np.uint64) * _K)
        rest = np.flatnonzero(ln > 8)
        at = 8
        while len(rest):
            x = x8[s[rest] + at] & _MASK8[np.minimum(ln[rest] - at, 8)]
            h[rest] = mix(h[rest] * _M1 + x * by + _K)
            at += 8
            rest = rest[ln[rest] > at]
        out[i:j] = h
        i = j
    return out


def hash_windows(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive word hashes (document edges are the caller's)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    c = odd(seed, n)
    acc = h[:m] * c[0]
    for j in range(1, n):
        acc += h[j : j + m] * c[j]
    return mix(acc)


def window_starts(first_word: np.ndarray, n: int) -> np.ndarray:
    """Word indices at which a window of n words lies inside one document."""
    total = int(first_word[-1])
    a, b = first_word[:-1], first_word[1:] - n + 1
    has = b > a
    return np.flatnonzero(covered(total, a[has], b[has]))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + size[i] - 1 of all i, one run after the other."""
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(size) else 0)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    return np.cumsum(np.bincount(starts, minlength=n + 1)[:n] - np.bincount(ends, minlength=n + 1)[:n]) > 0


def member(values: np.ndarray, query: np.ndarray, bits: int = 22) -> np.ndarray:
    """For each query its place in the sorted distinct `values`, or -1.

    A small presence table settles most absent queries before the binary search."""
    out = np.full(len(query), -1, np.int64)
    if not len(values) or not len(query):
        return out
    mask = U64((1 << bits) - 1)
    table = np.zeros(1 << bits, bool)
    table[(values & mask).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(query & mask).astype(np.int64)])
    at = np.minimum(np.searchsorted(values, query[maybe]), len(values) - 1)
    hit = values[at] == query[maybe]
    out[maybe[hit]] = at[hit]
    return out


def release() -> None:
    """Give freed memory back to the machine: workers live on between stages, and executors are small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f):
    """A group or cogroup function that releases memory at its end."""
    if f.__code__.co_argcount == 1:

        def run(rows):
            try:
                return f(rows)
            finally:
                release()
    else:

        def run(rows, others):
            try:
                return f(rows, others)
            finally:
                release()

    return run


def cut(buf: np.ndarray, keep: np.ndarray, off: np.ndarray) -> pa.Array:
    """The kept bytes of each document as a binary array."""
    upto = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    at = upto[off]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(buf[keep].tobytes())])
