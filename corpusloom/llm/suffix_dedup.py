"""Operator 1: removal of repeated byte strings with a distributed suffix array.

A byte goes if a string of `length` bytes over it also starts in a document with a
smaller id.  Sorting every suffix of a corpus would move many times its size, so the
array is sparse: of each run of k-grams that a string of `length` bytes spans, the one
with the least hash is its *anchor*.  Equal strings have equal anchors at equal offsets,
so suffixes need sorting at anchors only, about one byte in fourteen.

Pass 1: anchors' hashes go through a count-min sketch; those in one document only are out.
Pass 2: each block sends, for each remaining anchor, the bytes around it that its strings
cover (equal ones of a block once, with their smallest id).  The task of an anchor's hash
sorts the right-hand suffixes and the reversed left-hand ones by deep-shallow sorting
(`suffix_sort.py`).  A string is then a pair of classes (left prefix, right prefix) read
off the common prefix lengths; the smallest id of each pair decides.
Pass 3: blocks apply the verdicts.  An anchor that very many documents hold is dealt by
its whole strings instead, so its differing surroundings spread over all tasks.

Edge cases: null text counts as empty; null ids come first; rows with one id are one
document for "smaller id"; texts shorter than `length` lose nothing; very long texts are
worked on in overlapping steps; other columns are not read; empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.llm import kernel as K
from corpusloom.llm import sketch as S
from corpusloom.llm.substring_dedup import _split
from corpusloom.llm.suffix_sort import as_words, deep_shallow

#: Bytes of an anchor; an anchor that so many documents may hold is dealt by its strings.
GRAM, HOT = 24, 1024
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>"
#: Bytes of a step, whose dozen passes stay in the cache, and rows of a slice.
_STEP, _SLICE = 1 << 16, 1 << 14


class _Anchors:
    """Anchors of a block: hash, byte place, first and last string start, and document."""

    def __init__(self, rows: pa.Table, length: int):
        self.texts = S.Texts(rows["body"].to_pylist())
        self.block = b = self.texts.block()
        w, c, low = length - GRAM + 1, K.odd(5, 3), np.uint64(0xFFFFFF)
        place = np.arange(_STEP + length, dtype=np.uint64)
        x8, hash_, spare, other = (np.empty_like(place) for _ in range(4))  # memory of all steps
        parts = []
        for d, e, x, y in b.pieces(_STEP, length - 1):
            buf = b.buf[x:y]
            if len(buf) < length:
                continue
            m = len(buf) - GRAM + 1
            K.eights_into(buf, x8)
            h, v, least = hash_[:m], spare[:m], other[:m]
            np.multiply(x8[8 : 8 + m], c[1], out=h)
            np.multiply(x8[16 : 16 + m], c[2], out=v)
            h += v
            K.mix_into(h, v)
            np.multiply(x8[:m], c[0], out=v)
            h += v
            K.mix_into(h, v)
            np.bitwise_and(h, ~low, out=least)
            least |= place[:m]
            span = 1
            while span < w:
                more = min(span, w - span)
                least, v = np.minimum(least[:-more], least[more:], out=v[: len(least) - more]), least
                span += more
            off = b.off[d : e + 1] - x if e - d > 1 else np.array([0, len(buf)])
            start, stop = off[:-1], off[1:] - length + 1
            has = stop > start
            start, stop = start[has], stop[has]
            if not len(start):
                continue
            edge = np.ones(len(least) + 1, bool)  # where the anchor of the strings, or the document, changes
            np.not_equal(least[1:], least[:-1], out=edge[1:-1])
            edge[start] = edge[stop] = True
            edge = np.flatnonzero(edge)
            doc = np.searchsorted(start, edge[:-1], "right") - 1
            in_doc = np.flatnonzero((doc >= 0) & (edge[:-1] < stop[doc]))
            lo, hi = edge[in_doc], edge[in_doc + 1] - 1
            p = (least[lo] & low).astype(np.int64)
            parts.append((h[p], p + x, lo + x, hi + x))
        none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        self.h, self.at, self.lo, self.hi = (np.concatenate(z) for z in zip(*parts, strict=True)) if parts else none
        self.doc = np.searchsorted(b.off, self.at, "right") - 1

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes and the number of documents that hold each."""
        ids = self.block.ids[self.doc]
        order = _by_key(self.h)  # places are in id order
        h, ids = self.h[order], ids[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
        head = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        return h[head], np.add.reduceat(new, head, dtype=np.int64) if len(head) else np.zeros(0, np.int64)


class _Segments:
    """Distinct segments of a block around repeated anchors, and their occurrences."""

    def __init__(self, a: _Anchors, sketch: S.Sketch, answers: pa.Table, length: int):
        self.left = left = length - GRAM
        count = sketch.estimate(a.h, sketch.answers(answers))
        i = np.flatnonzero((count > 1) & (count < HOT))
        h, at, lo, hi, doc = a.h[i], a.at[i], a.lo[i], a.hi[i], a.doc[i]
        hot = np.flatnonzero(count >= HOT)
        if len(hot):  # each string on its own, dealt by its content
            n = a.hi[hot] - a.lo[hot] + 1
            s = np.repeat(a.lo[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            whole = _windows(a.block.buf, length)[s + length]
            key = K.mix(_digest(whole) + np.uint64(9))
            h, doc = np.concatenate([h, key]), np.concatenate([doc, np.repeat(a.doc[hot], n)])
            at, lo, hi = np.concatenate([at, np.repeat(a.at[hot], n)]), np.concatenate([lo, s]), np.concatenate([hi, s])
        width = left + length
        view = _windows(a.block.buf, width)
        most, least = (at - lo).astype(np.uint8), (at - hi).astype(np.uint8)
        rows, key = np.empty((len(at), width + 2), np.uint8), np.empty(len(at), np.uint64)
        for x in range(0, len(at), _SLICE):  # slices, so that masks and copies stay small
            y = x + _SLICE
            r = view[at[x:y] - left + width]
            r *= _used(most[x:y], least[x:y], left, width)
            rows[x:y, :-2], rows[x:y, -2], rows[x:y, -1] = r, most[x:y], least[x:y]
            key[x:y] = K.mix(_digest(rows[x:y]) * np.uint64(3) + h[x:y])
        ids = a.block.ids[doc]
        order, head = _grouped(key)
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))][~head] if len(order) else order
        like = order[~head]
        if any((rows[like[x : x + _SLICE]] != rows[lead[x : x + _SLICE]]).any() for x in range(0, len(like), _SLICE)):  # two contents with one digest: group by content
            both = np.concatenate([rows, h.view(np.uint8).reshape(-1, 8)], axis=1)
            key = np.unique(both, axis=0, return_inverse=True)[1].ravel().astype(np.uint64)
            order, head = _grouped(key)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(head) - 1
        first = order[head]
        self.h, self.ids, self.rows = h[first], ids[first], rows[first]
        self.at, self.lo, self.hi, self.occ = at, lo, hi, ids

    def emit(self, block: int, parts: int) -> list[tuple]:
        to = ((self.h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(parts + 1))
        width = self.rows.shape[1] - 2
        h, planes, most, least = self.h[order], self.ids[order].astype("<i8").view(np.uint8).reshape(-1, 8), self.rows[order, -2], self.rows[order, -1]
        text = [np.zeros(0, np.uint8)]
        for x in range(0, len(order), _SLICE):
            y = x + _SLICE
            text.append(self.rows[order[x:y], :-2][_used(most[x:y], least[x:y], self.left, width)])
        text = np.concatenate(text)
        upto = np.concatenate([[0], np.cumsum(width - self.left + most.astype(np.int64) - least)])
        out = []
        for p in np.flatnonzero(np.diff(edges)).tolist():
            x, y = int(edges[p]), int(edges[p + 1])
            packed = pa.compress(text[upto[x] : upto[y]], codec="zstd", asbytes=True)
            out.append((p, block, b"".join([(y - x).to_bytes(8, "little"), h[x:y].tobytes(), planes[x:y].T.tobytes(), most[x:y].tobytes(), least[x:y].tobytes(), packed])))
        return out


def _used(most: np.ndarray, least: np.ndarray, left: int, width: int) -> np.ndarray:
    """Which bytes of each row of `width` bytes around an anchor its strings cover: from `most` before the anchor on, without the last `least`."""
    col = np.arange(width, dtype=np.int16)
    return (col >= (left - most.astype(np.int16))[:, None]) & (col < (width - least.astype(np.int16))[:, None])


def _windows(buf: np.ndarray, width: int) -> np.ndarray:
    """A view: row i holds the width bytes from place i - width on; places outside the buffer read as zero."""
    padded = np.concatenate([np.zeros(width, np.uint8), buf, np.zeros(width, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, id), and which sorted rows start a group; rows of one key come in id order."""
    order = _by_key(key)
    head = np.ones(len(key), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    return order, head


def _by_key(key: np.ndarray) -> np.ndarray:
    """Stable order of keys: a fast sort that is not stable, and then places inside each run of equal keys."""
    order = np.argsort(key)
    run = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
    return np.sort(run * len(key) + order) - run * len(key)


def _digest(rows: np.ndarray) -> np.ndarray:
    w = as_words(rows)
    acc = np.zeros(len(rows), np.uint64)
    for j in range(w.shape[1]):
        acc = K.mix(acc + w[:, j])
    return acc


def _sort_strings(length: int):
    left = length - GRAM
    width = left + length

    def run(table: pa.Table) -> pa.Table:
        ds, mosts, leasts, texts, n = [], [], [], [], []
        for body in table["body"].to_pylist():
            k = int.from_bytes(body[:8], "little")
            n.append(k)
            ds.append(np.frombuffer(body, np.uint8, 8 * k, 8 + 8 * k).reshape(8, k).T)
            mosts.append(np.frombuffer(body, np.uint8, k, 8 + 16 * k)), leasts.append(np.frombuffer(body, np.uint8, k, 8 + 17 * k))
            size = length * k + int(mosts[-1].sum(dtype=np.int64)) - int(leasts[-1].sum(dtype=np.int64))
            texts.append(pa.decompress(memoryview(body)[8 + 18 * k :], decompressed_size=size, codec="zstd", asbytes=True))
        doc, most, least, text = np.ascontiguousarray(np.concatenate(ds)).view("<i8").ravel(), np.concatenate(mosts), np.concatenate(leasts), np.frombuffer(b"".join(texts), np.uint8)
        rows = np.zeros((len(doc), width), np.uint8)
        rows[_used(most, least, left, width)] = text
        most, least = most.astype(np.int64), least.astype(np.int64)
        total = len(doc)
        order, lcp = deep_shallow(np.ascontiguousarray(rows[:, left:]))
        back, back_lcp = deep_shallow(np.ascontiguousarray(rows[:, :left][:, ::-1]))
        right_class, left_class = np.empty(total, np.int64), np.empty(total, np.int64)
        # the longest prefix that each suffix shares with any other one
        near, back_near = np.empty(total, np.int64), np.empty(total, np.int64)
        near[order], back_near[back] = np.maximum(lcp, np.append(lcp[1:], 0)), np.maximum(back_lcp, np.append(back_lcp[1:], 0))
        runs = []
        first, last = np.maximum(least, length - near), np.minimum(most, back_near)  # other strings equal none
        for a in range(int(first.min()), int(last.max()) + 1):
            i = np.flatnonzero((first <= a) & (a <= last))
            if not len(i):
                continue
            right_class[order] = np.cumsum(lcp < length - a)
            left_class[back] = np.cumsum(back_lcp < a)
            pair = right_class[i] * (total + 1) + left_class[i]
            by = np.argsort(pair)
            p, i = pair[by], i[by]
            head = np.ones(len(by), bool)
            head[1:] = p[1:] != p[:-1]
            own = doc[i]
            best = np.minimum.reduceat(own, np.flatnonzero(head))[np.cumsum(head) - 1]
            better = np.flatnonzero(best < own)
            runs.append((i[better], np.full(len(better), a)))
        if not runs:
            return S.table([])
        e, a = (np.concatenate(z) for z in zip(*runs, strict=True))
        if not len(e):
            return S.table([])
        by = np.argsort(e * 256 + a)
        e, a = e[by], a[by]
        head = np.ones(len(e), bool)
        head[1:] = (e[1:] != e[:-1]) | (a[1:] != a[:-1] + 1)
        f = np.flatnonzero(head)
        last = np.append(f[1:], len(e)) - 1
        e, lo, hi = e[f], a[f].astype(np.uint8), a[last].astype(np.uint8)
        out, base = [], 0
        for k, key, block in zip(n, table["key"].to_pylist(), table["block"].to_pylist(), strict=True):
            x, y = np.searchsorted(e, [base, base + k])
            if y > x:
                out.append((-1 - key, block, int(y - x).to_bytes(4, "little") + (e[x:y] - base).astype(np.uint32).tobytes() + lo[x:y].tobytes() + hi[x:y].tobytes()))
            base += k
        return S.table(out)

    return run


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes (28 to 250) that also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes) and spans
    (removed byte runs); with `keep` also row, a struct of these columns of the document."""
    if not GRAM + 4 <= length <= 250:
        raise ValueError("length must be 28 to 250 bytes")
    schema = StructType.fromDDL(OUT)
    if keep:
        schema = schema.add("row", docs.select(*keep).schema)
    out = to_arrow_schema(schema)
    total, n = S.sizes(docs, text_col, S.BLOCK_BYTES // 2)  # a task holds the strings around anchors beside its text
    sketch = S.Sketch(2 * total // (length - GRAM + 2), rows=2, per_key=8)
    dealt = S.packed_blocks(docs, id_col, text_col, n, keep)

    def emit(rows: pa.Table) -> pa.Table:
        h, count = _Anchors(rows, length).weights()
        return S.table(sketch.emit(rows["block"][0].as_py(), h, np.minimum(count, 65535)))

    def segments(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return S.table([])
        seg = _Segments(_Anchors(rows, length), sketch, answers, length)
        return S.table(seg.emit(rows["block"][0].as_py(), n))

    def remove(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        anchors = _Anchors(rows, length)
        answers, verdicts = _split(told)
        seg = _Segments(anchors, sketch, answers, length)
        to = ((seg.h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(n + 1))
        es, los, his = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
        for key, body in zip(verdicts["key"].to_pylist(), verdicts["body"].to_pylist(), strict=True):
            p, k = -1 - key, int.from_bytes(body[:4], "little")
            es.append(order[edges[p] : edges[p + 1]][np.frombuffer(body, np.uint32, k, 4)])
            los.append(np.frombuffer(body, np.uint8, k, 4 + 4 * k))
            his.append(np.frombuffer(body, np.uint8, k, 4 + 5 * k))
        e, lo, hi = np.concatenate(es), np.concatenate(los).astype(np.int64), np.concatenate(his).astype(np.int64)
        # an occurrence in a later document of the block goes whole; one in the block's first goes where a verdict says
        late = seg.occ > seg.ids[seg.entry]
        first = np.flatnonzero(~late)
        by = first[np.argsort(seg.entry[first])]
        upto = np.searchsorted(seg.entry[by], np.arange(len(seg.ids) + 1))
        n_of = np.diff(upto)[e]
        v = np.repeat(np.arange(len(e)), n_of)
        o = by[K.ranges(upto[:-1][e], n_of)]
        a, b = np.maximum(seg.lo[o], seg.at[o] - hi[v]), np.minimum(seg.hi[o], seg.at[o] - lo[v])
        some = a <= b
        s, t = np.concatenate([seg.lo[late], a[some]]), np.concatenate([seg.hi[late], b[some]])
        return _result(anchors, s, t + length).cast(out)

    answers = S.merged(dealt.groupBy("block").applyInArrow(K.lean(emit), S.WIRE), sketch)
    sent = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(K.lean(segments), S.WIRE)
    verdicts = sent.repartition(n, "key").groupBy("key").applyInArrow(K.lean(_sort_strings(length)), S.WIRE)
    told = answers.unionByName(verdicts)
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(K.lean(remove), schema)


def _result(a: _Anchors, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """Rows of the block's documents without the bytes of any [start, end), each inside one document."""
    b = a.block
    by = np.argsort(starts)
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    doc = np.searchsorted(b.off, starts, "right") - 1
    head = np.ones(len(by), bool)
    head[1:] = (starts[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    doc, s, e = doc[first], starts[first], reach[np.append(first[1:], len(by)) - 1] if len(by) else reach
    at, gone = np.searchsorted(doc, np.arange(b.n + 1)), np.concatenate([[0], np.cumsum(e - s)])
    n_removed = gone[at]
    edges = np.concatenate([[0], np.stack([s, e], axis=1).ravel(), [len(b.buf)]])
    keep = np.repeat(np.arange(len(edges) - 1) % 2 == 0, np.diff(edges))
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.n, [None, pa.py_buffer((b.off - n_removed).astype(np.int64).tobytes()), pa.py_buffer(b.buf[keep].tobytes())])
    runs = pa.StructArray.from_arrays([pa.array(s - b.off[doc], pa.int64()), pa.array(e - b.off[doc], pa.int64())], ["start", "end"])
    rest = {} if a.texts.rest is None else {"row": pa.StructArray.from_arrays([c.combine_chunks() for c in a.texts.rest.take(pa.array(b.order)).columns], fields=list(a.texts.rest.schema))}
    return pa.table(
        {
            "doc_id": pa.array(b.ids, pa.int64(), mask=b.ids == K.NULL_ID),
            "n_bytes": pa.array(np.diff(b.off), pa.int64()),
            "n_removed": pa.array(np.diff(n_removed), pa.int64()),
            "n_spans": pa.array(np.diff(at), pa.int64()),
            "kept": kept,
            "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs),
        }
        | rest
    )


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as two hexadecimal digits, so that strings are cut at bytes.
SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100),
h AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS s FROM p),
m AS (SELECT s, min(doc_id) AS least FROM h GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM h JOIN m USING (s) WHERE doc_id > least),
g AS (SELECT doc_id, i, sum(CASE WHEN before >= i - 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, k),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM spans GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes,
  coalesce(list_sum([b[j] - a[j] FOR j IN range(1, len(a) + 1)]), 0)::BIGINT AS n_removed,
  coalesce(len(a), 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string(list_concat(
    [substr(x, 1, 2 * a[1])],
    [substr(x, 2 * b[j] + 1, 2 * (coalesce(a[j + 1], length(x) // 2) - b[j])) FOR j IN range(1, len(a) + 1)]), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""
