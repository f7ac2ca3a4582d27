"""Count-min sketches that are merged shard by shard.

Each block of documents writes, for every sketch row, the cells it touches (sorted and
delta coded, about a byte a key).  One task per shard adds the cells of all blocks and
answers each block with the merged count of each of its own cells.  No task and no
driver ever holds the whole sketch, so its width follows the input: `shards` grows with
the number of keys and the share of overestimates stays the same at every size.
Counts are never too low: a key is never missed, at most looked at once too often.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernel import NULL_ID, U64, Block, lean, member, mix, release, to_block

CELL_BITS = 22
CELLS_PER_KEY = 4
WIRE = "key long, block long, body binary"
_WIRE = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])


def table(rows: Iterable[tuple], key: str = "key") -> pa.Table:
    rows = list(rows)
    out = pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_WIRE)], schema=_WIRE)
    return out if key == "key" else out.rename_columns([key, "block", "body"])


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _swell(body: bytes) -> bytes:
    size = int.from_bytes(body[:8], "little")
    return pa.decompress(body[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack_strings(values: pa.Array) -> bytes:
    """A large_string array without nulls as compressed bytes."""
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    text = values.buffers()[2]
    return _squeeze(len(values).to_bytes(4, "little") + np.diff(off).astype(np.uint32).tobytes() + (memoryview(text)[off[0] : off[-1]] if text is not None else b""))


def unpack_strings(body: bytes) -> pa.Array:
    raw = _swell(body)
    n = int.from_bytes(raw[:4], "little")
    off = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(off), pa.py_buffer(raw[4 + 4 * n :]))


def pack_lists(size: np.ndarray, flat: np.ndarray) -> bytes:
    """Lists of numbers below 2^32."""
    return _squeeze(len(size).to_bytes(4, "little") + size.astype(np.uint32).tobytes() + flat.astype(np.uint32).tobytes())


def unpack_lists(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _swell(body)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, np.uint32, n, 4).astype(np.int64), np.frombuffer(raw, np.uint32, -1, 4 + 4 * n)


def pack_sorted(cells: np.ndarray) -> bytes:
    """Sorted distinct integers as gaps of one byte, or two where gaps are wide; the largest gap value means "go on"."""
    gaps = np.diff(cells.astype(np.int64), prepend=-1) - 1
    kind, top = (np.uint8, 255) if not len(gaps) or gaps.mean() < 600 else (np.uint16, 65535)
    more = gaps // top
    out = np.full(int(more.sum()) + len(gaps), top, kind)
    out[np.cumsum(more + 1) - 1] = gaps % top
    return bytes([np.dtype(kind).itemsize]) + out.tobytes()


def unpack_sorted(body: bytes) -> np.ndarray:
    kind = np.uint8 if body[0] == 1 else np.uint16
    v = np.frombuffer(body, kind, offset=1)
    ends = np.flatnonzero(v != np.iinfo(kind).max)
    return np.cumsum(v.astype(np.int64))[ends] + np.arange(len(ends))


class Sketch:
    """Shape of a sketch for about `keys` keys."""

    def __init__(self, keys: int, rows: int = 2, per_key: int = CELLS_PER_KEY):
        self.rows, self.shards = rows, max(1, -(-int(keys) * per_key >> CELL_BITS))

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        """Cell of each key, the shard in its high bits."""
        g = mix(h + U64(0x51ED270B * (row + 1)))
        return ((g >> U64(32)) % U64(self.shards) << U64(CELL_BITS)) | (g & U64((1 << CELL_BITS) - 1))

    def emit(self, block: int, h: np.ndarray, weight: np.ndarray | None = None) -> list[tuple]:
        """What a block sends: one record for each shard it touches. h: its keys; weight: how often each counts, at most 65535."""
        out = []
        for row in range(self.rows):
            c = self.cells(h, row)
            if weight is None:
                c = np.sort(c)
                w = None
            else:
                order = np.argsort(c)
                c, w = c[order], weight[order].astype(np.int64)
            head = np.flatnonzero(np.diff(c, prepend=~c[:1]))
            count = np.diff(np.append(head, len(c))) if w is None else np.add.reduceat(w, head) if len(head) else w
            c, count = c[head], np.minimum(count, 65535)
            edges = np.searchsorted(c, np.arange(self.shards + 1, dtype=np.uint64) << U64(CELL_BITS))
            for s in np.flatnonzero(np.diff(edges)):
                part, n = c[edges[s] : edges[s + 1]] & U64((1 << CELL_BITS) - 1), count[edges[s] : edges[s + 1]]
                many = np.flatnonzero(n > 1)
                extra = many.astype(np.uint32).tobytes() + n[many].astype(np.uint16).tobytes()
                out.append((row * self.shards + int(s), block, len(many).to_bytes(4, "little") + extra + pack_sorted(part)))
        return out

    def answers(self, block_rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each sketch row, the block's cells that have a merged count over 1, sorted, and that count."""
        got: list[list] = [[] for _ in range(self.rows)]
        for key, body in zip(block_rows["key"].to_pylist(), block_rows["body"].to_pylist(), strict=True):
            row, shard = divmod(key, self.shards)
            n = int.from_bytes(body[:4], "little")
            raw = zlib.decompress(body[4:])
            got[row].append(((np.uint64(shard) << U64(CELL_BITS)) | unpack_sorted(raw[2 * n :]).astype(np.uint64), np.frombuffer(raw, np.uint16, n)))
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint16))
        out = []
        for parts in got:
            parts.sort(key=lambda p: p[0][0])
            out.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none)
        return out

    def estimate(self, h: np.ndarray, answers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Merged count of each key, never too low; 1 stands for "not repeated"."""
        best = np.ones(len(h), np.int64)
        rest = np.arange(len(h))
        for row, (cells, count) in enumerate(answers):
            at = member(cells, self.cells(h[rest], row))
            hit = at >= 0
            rest, found = rest[hit], count[at[hit]].astype(np.int64)
            if row:
                best[:], found = 1, np.minimum(found, kept[hit])
            best[rest] = kept = found
        return best


def merge_shard(rows: pa.Table) -> pa.Table:
    """Add the cells of all blocks for one shard; answer each block with its own cells that came to 2 or more."""
    total = np.zeros(1 << CELL_BITS, np.int32)
    seen = []
    key = rows["key"][0].as_py()
    for block, body in zip(rows["block"].to_pylist(), rows["body"].to_pylist(), strict=True):
        n = int.from_bytes(body[:4], "little")
        at, w = np.frombuffer(body, np.uint32, n, 4), np.frombuffer(body, np.uint16, n, 4 + 4 * n)
        cells = unpack_sorted(body[4 + 6 * n :])
        total[cells] += 1
        total[cells[at]] += w.astype(np.int32) - 1
        seen.append((block, body[4 + 6 * n :]))
    out = []
    for block, packed in seen:
        cells = unpack_sorted(packed)
        cells = cells[total[cells] > 1]
        if len(cells):
            count = np.minimum(total[cells], 65535).astype(np.uint16)
            out.append((key, block, len(cells).to_bytes(4, "little") + zlib.compress(count.tobytes() + pack_sorted(cells), 1)))
    return table(out)


def merged(emitted: DataFrame, sketch: Sketch) -> DataFrame:
    """Block records in, answers to blocks out; one task per shard, shards of fixed width."""
    return emitted.repartition(max(sketch.rows * sketch.shards, LEAST_BLOCKS), "key").groupBy("key").applyInArrow(lean(merge_shard), WIRE)


#: Bytes of text that one block holds on average, and the least number of blocks.
BLOCK_BYTES, LEAST_BLOCKS = 6 << 20, 48


def sizes(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """(bytes of text, blocks of about `block_bytes` to deal it into)."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    return total, max(LEAST_BLOCKS, -(-total // block_bytes))


def packed_blocks(docs: DataFrame, id_col: str, text_col: str, n: int, keep: list[str] | None = None) -> DataFrame:
    """Rows (block, body): documents dealt by a hash of id and text into n partitions, those of one task and block as one compressed packet.

    So neither null ids nor one id of many rows make a hot block.  `keep` names columns that travel along."""

    def pack(batches):
        for batch in batches:
            block = batch["__block"].to_numpy()
            order = np.argsort(block, kind="stable")
            text, ids = batch["__text"].cast(pa.large_binary()).take(pa.array(order)), batch["__id"].take(pa.array(order))
            null = text.is_null().to_numpy(zero_copy_only=False)
            text = text.fill_null(b"") if null.any() else text
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = memoryview(text.buffers()[2]) if text.buffers()[2] is not None else b""
            ids = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            rest = batch.select(keep).take(pa.array(order)) if keep else None
            edges = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                head = (b - a).to_bytes(4, "little") + ids[a:b].tobytes() + null[a:b].tobytes() + np.diff(off[a : b + 1]).tobytes()
                body = _squeeze(bytes(raw[off[a] : off[b]]))
                out.append((int(block[order[a]]), head + len(body).to_bytes(8, "little") + body + (_table_bytes(rest.slice(a, b - a)) if keep else b"")))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["block", "body"])
        release()

    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(F.pmod(F.xxhash64(key, text), F.lit(n)).alias("__block"), key.alias("__id"), text.alias("__text"), *(keep or []))
    return rows.mapInArrow(pack, "block long, body binary").repartition(n, "block")


def _table_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Texts:
    """The documents of a block's packets, in order of the packets' bytes: ids (NULL_ID for null), which texts are null, offsets, bytes, kept columns."""

    def __init__(self, bodies: list[bytes]):
        ids, null, size, raw, rest = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)], [], []
        for body in sorted(bodies):
            n = int.from_bytes(body[:4], "little")
            ids.append(np.frombuffer(body, np.int64, n, 4))
            null.append(np.frombuffer(body, bool, n, 4 + 8 * n))
            size.append(np.frombuffer(body, np.int64, n, 4 + 9 * n))
            at = 12 + 17 * n
            end = at + int.from_bytes(body[at - 8 : at], "little")
            raw.append(_swell(body[at:end]))
            if len(body) > end:
                rest.append(pa.ipc.open_stream(body[end:]).read_all())
        self.ids, self.null = np.concatenate(ids), np.concatenate(null)
        self.off = np.concatenate([[0], np.cumsum(np.concatenate(size))])
        self.buf = np.frombuffer(b"".join(raw), np.uint8)
        self.rest = pa.concat_tables(rest) if rest else None

    def block(self) -> Block:
        """Ordered by (id, text)."""
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.ids), [None, pa.py_buffer(self.off.astype(np.int64)), pa.py_buffer(self.buf)])
        return to_block(pa.table({"doc_id": pa.array(self.ids), "text": text}))


def block_of(rows: pa.Table) -> Block:
    """The block of rows (block, body)."""
    return Texts(rows["body"].to_pylist()).block()
