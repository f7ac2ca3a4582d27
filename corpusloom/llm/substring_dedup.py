"""Operator 8: removal of repeated word windows with a count-min prefilter.

Pass 1: each block of documents adds the hashes of its windows to a sketch; sketches are
merged shard by shard (`sketch.py`).  Pass 2: windows whose merged estimate is 2 or more
are grouped exactly, by 128 bits from two independent hashes of each word's bytes, and the
group's earliest window stays.  The
estimate is never too low, so no repeated window is lost; a wrongly suspected one only
costs a row.  A block first folds its own copies of a window into the earliest, so a
window that a third of all documents hold is one row for each block, not for each copy.

Edge cases: null text counts as empty and has no words; a null id comes before all
others; rows that share an id are ordered by their text; a text of fewer than `window`
words loses nothing; white space between kept words becomes one space; other columns of
the input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm import sketch as S

OUT = "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start: long, end: long>>"


class _Windows:
    """Words and windows of one block; what all passes derive from the text in the same way."""

    def __init__(self, rows: pa.Table, window: int, again: bool = False):
        """again: also a second hash of every word, from other multiples of its bytes."""
        self.block = b = S.block_of(rows)
        starts, ends, first = [], [], [np.zeros(1, np.int64)]
        hashes, others = [], []
        total = 0
        for d, e, x, y in b.pieces(1 << 20):
            off = b.off[d : e + 1] - x
            s, t, f = K.words(b.buf[x:y], off)
            hashes.append(K.hash_words(b.buf[x:y], s, t))
            if again:
                others.append(K.hash_words(b.buf[x:y], s, t, salt=0x9FB21C651E98DF25))
            starts.append(s + x)
            ends.append(t + x)
            first.append(f[1:] + total)
            total += len(s)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.ends, self.first = cat(starts, np.int64), cat(ends, np.int64), np.concatenate(first)
        self.at = K.window_starts(self.first, window)
        h = cat(hashes, np.uint64)
        self.h = K.hash_windows(h, window)[self.at]
        self.others = cat(others, np.uint64)

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


def _repeated(w: _Windows, window: int, sketch: S.Sketch, answers: pa.Table):
    """Windows with an estimate over 1, sorted by fingerprint and place; which of them starts a group."""
    cand = np.flatnonzero(sketch.estimate(w.h, sketch.answers(answers)) > 1)
    second = np.zeros(len(cand), np.uint64)
    c = K.odd(77, window)
    for j in range(window):
        second += w.others[w.at[cand] + j] * c[j]
    second = K.mix(second)
    order = np.lexsort((second, w.h[cand]))  # stable: by place inside a group
    cand, second = cand[order], second[order]
    h = w.h[cand]
    head = np.ones(len(cand), bool)
    head[1:] = (h[1:] != h[:-1]) | (second[1:] != second[:-1])
    return cand, h, second, head


def _entries(block: int, h: np.ndarray, second: np.ndarray, doc: np.ndarray, parts: int) -> list[tuple]:
    to = (h >> np.uint64(40)) % np.uint64(parts)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(parts + 1, dtype=np.uint64))
    out = []
    for p in np.flatnonzero(np.diff(edges)):
        i = order[edges[p] : edges[p + 1]]
        planes = doc[i].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()  # byte planes compress
        out.append((int(p), block, len(i).to_bytes(4, "little") + h[i].tobytes() + second[i].tobytes() + planes))
    return out


def _earliest(rows: pa.Table) -> pa.Table:
    """For each fingerprint the smallest id among the blocks that hold it; a bit for each entry: not the earliest."""
    n = [int.from_bytes(b[:4], "little") for b in (x.as_py()[:4] for x in rows["body"])]
    hs, ss, ds = [], [], []
    for k, x in zip(n, rows["body"], strict=True):
        body = x.as_py()
        hs.append(np.frombuffer(body[4 : 4 + 8 * k], np.uint64))
        ss.append(np.frombuffer(body[4 + 8 * k : 4 + 16 * k], np.uint64))
        ds.append(np.frombuffer(body[4 + 16 * k :], np.uint8).reshape(8, k).T.copy().view("<i8").ravel())
    h, s, d = np.concatenate(hs), np.concatenate(ss), np.concatenate(ds)
    order = np.lexsort((np.repeat(rows["block"].to_numpy(), n), d, s, h))  # rows of one id come in order of their blocks
    head = np.ones(len(h), bool)
    ho, so = h[order], s[order]
    head[1:] = (ho[1:] != ho[:-1]) | (so[1:] != so[:-1])
    late = np.empty(len(h), bool)
    late[order] = ~head
    out, i = [], 0
    for k, key, block in zip(n, rows["key"].to_pylist(), rows["block"].to_pylist(), strict=True):
        out.append((-1 - key, block, k.to_bytes(4, "little") + np.packbits(late[i : i + k]).tobytes()))
        i += k
    return S.table(out)


def _split(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Sketch answers and verdicts of a block."""
    own = rows["key"].to_numpy() if rows.num_rows else np.zeros(0, np.int64)
    return rows.filter(pa.array(own >= 0)), rows.filter(pa.array(own < 0))


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts earlier in the corpus.

    Earlier: in a document with a smaller id, or sooner in the same document.  Windows are
    judged on the input.  Returns doc_id, n_words, n_removed, kept (binary; kept words
    joined by one space) and spans (removed runs of word indices)."""
    total, n = S.sizes(docs, text_col)
    sketch = S.Sketch(total // 6)
    parts = n
    dealt = S.packed_blocks(docs, id_col, text_col, n)

    def emit(rows: pa.Table) -> pa.Table:
        w = _Windows(rows, window)
        return S.table(sketch.emit(rows["block"][0].as_py(), w.h))

    def suspects(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return S.table([])
        w = _Windows(rows, window, again=True)
        cand, h, second, head = _repeated(w, window, sketch, answers)
        i = np.flatnonzero(head)
        doc = w.block.ids[w.doc_of(w.at[cand[i]])]
        return S.table(_entries(rows["block"][0].as_py(), h[i], second[i], doc, parts))

    def remove(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _result([], [], [], [], None)
        w = _Windows(rows, window, again=True)
        answers, verdicts = _split(told)
        cand, h, second, head = _repeated(w, window, sketch, answers)
        i = np.flatnonzero(head)
        late = np.zeros(len(i), bool)
        to = ((h[i] >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(parts + 1))
        for key, body in zip(verdicts["key"].to_pylist(), verdicts["body"].to_pylist(), strict=True):
            p = -1 - key
            late[order[edges[p] : edges[p + 1]]] = np.unpackbits(np.frombuffer(body, np.uint8, offset=4), count=int.from_bytes(body[:4], "little")).astype(bool)
        repeat = ~head
        repeat[i] = late
        gone = w.at[cand[repeat]]
        removed = K.covered(len(w.starts), gone, gone + window)
        return _finish(w, removed)

    answers = S.merged(dealt.groupBy("block").applyInArrow(K.lean(emit), S.WIRE), sketch)
    entries = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(K.lean(suspects), S.WIRE)
    verdicts = entries.repartition(n, "key").groupBy("key").applyInArrow(K.lean(_earliest), S.WIRE)
    told = answers.unionByName(verdicts)
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(K.lean(remove), OUT)


def _result(ids, n_words, n_removed, kept, spans) -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    ids = np.asarray(ids, np.int64)
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64(), mask=ids == K.NULL_ID),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()) if not isinstance(kept, pa.Array) else kept.cast(pa.binary()),
            "spans": spans if spans is not None else pa.array([], span),
        }
    )


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `flag` inside each [off[i], off[i+1]): starts, ends, and the first run of each document."""
    first, last = flag.copy(), flag.copy()
    if len(flag):
        first[1:] &= ~flag[:-1]
        last[:-1] &= ~flag[1:]
        full = off[:-1] < off[1:]
        a, b = off[:-1][full], off[1:][full] - 1
        first[a], last[b] = flag[a], flag[b]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, off)


def span_array(flag: np.ndarray, off: np.ndarray) -> pa.Array:
    s, e, at = runs(flag, off)
    doc = np.searchsorted(off, s, "right") - 1
    values = pa.StructArray.from_arrays([pa.array(s - off[doc], pa.int64()), pa.array(e - off[doc], pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def _finish(w: _Windows, removed: np.ndarray) -> pa.Table:
    b, keep = w.block, ~removed
    work, take = b.buf.copy(), K.covered(len(b.buf), w.starts[keep], w.ends[keep])
    kept = np.flatnonzero(keep)
    doc = w.doc_of(kept)
    more = np.zeros(len(kept), bool)
    more[:-1] = doc[1:] == doc[:-1]
    gap = w.ends[kept[more]]  # the separator after each kept word but a document's last
    work[gap], take[gap] = 0x20, True
    count = np.diff(w.first)
    upto = np.concatenate([[0], np.cumsum(removed)])
    return _result(b.ids, count, upto[w.first[1:]] - upto[w.first[:-1]], K.cut(work, take, b.off), span_array(removed, w.first))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Splitting on this class leaves the words; windows as lists, the first start of each by (doc_id, start).
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM h),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(range(20)) AS j) WHERE k > 1),
per AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[x] FOR x IN range(1, len(w) + 1) IF NOT list_contains(g, x)], ' ') END) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""
