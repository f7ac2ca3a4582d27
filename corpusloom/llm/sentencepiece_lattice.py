"""Operator 5: SentencePiece encoding and decoding on a relational lattice.

1. Texts are cut into units where no piece can cross: between two characters that no piece
   holds side by side.  Documents are dealt into blocks as packed bytes; a block finds its
   distinct units by text and sends them, packed, to shards by a hash of the unit.  A shard
   merges the units of all blocks and numbers them.
2. Every substring of a unit of at most the longest piece's length is exploded and joined
   to the piece table (fixed size, broadcast); the edges are grouped by unit.  Units are
   dealt by their number before they are exploded, so edges are not shuffled.
3. A higher-order aggregate folds the edges.  For a unigram model that is Viterbi.  The
   public model here is a BPE model: its encoder merges the best adjacent pair until none
   is left, which Viterbi over scores does not reproduce.  Its fold goes once over the
   edges from the best score on, leftmost first, and applies each that fits over two
   adjacent symbols.  One turn is exact for pieces whose own merges come in falling order
   of score; in units that hold one of the others (`Pieces.late`: in the public model the
   runs of spaces, which all have one score) it looks for the best edge after each merge.
4. Each shard answers the blocks with the ids of their own units, and blocks put them
   together.  No dictionary is ever whole in one task or on the driver.

Units of over `SHORT` characters, and those with a character that only longer pieces hold,
are folded by `Fold`, which computes the same with a heap (BPE) or one pass (unigram): the
higher-order fold copies its state for each edge, which is quadratic in the unit.

Decoding maps ids to piece bytes, joins bytes of byte pieces and drops the first space.

Edge cases: null and empty texts have no tokens; characters without a piece become byte
pieces; the space mark in a text is read as a space, as the library does, so such a text
decodes to spaces; invalid or control ids decode to nothing; a text of one unbroken run is
one unit, folded in near-linear time; repeated rows are encoded each; an empty table gives
an empty table; other columns are not read, so clashing names cannot matter.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm import sketch as S

MARK = "▁"
#: Units of at most so many characters go through the lattice: their cuts are bits of one integer.
SHORT = 60


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


def model_kind(raw: bytes) -> str:
    """"bpe" or "unigram", from a model file's bytes; other models are refused, and unigram ones that change the text first."""
    parts = list(_fields(raw))
    last = lambda n: dict(_fields(b"".join(v for k, v in parts if k == n)))
    trainer, normal = last(2), last(3)
    kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))  # the format's default is unigram
    if kind is None:
        raise ValueError(f"model type {trainer.get(3)} is neither unigram nor BPE")
    if kind == "unigram":
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the unigram model normalises texts or treats spaces in another way than the fold")
        if not any(dict(_fields(v)).get(3, 1) == 6 for k, v in parts if k == 1):
            raise ValueError("a unigram model without byte pieces joins unknown characters, which the fold does not")
        if any(dict(_fields(v)).get(3, 1) == 4 for k, v in parts if k == 1):
            raise ValueError("user-defined pieces of a unigram model are not supported")
    return kind


@dataclass
class Pieces:
    """A piece table: texts (spaces for marks), scores, and the id of byte piece 0 (-1: none)."""

    texts: list[str]
    scores: list[float]
    plain: list[bool]
    byte_base: int
    kind: str = "bpe"
    unknown: int = 0

    @classmethod
    def load(cls, model: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.vocab_size()
        base = next((i for i in range(n) if m.is_byte(i)), -1)
        plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
        return cls([m.id_to_piece(i).replace(MARK, " ") for i in range(n)], [m.get_score(i) for i in range(n)], plain, base, model_kind(m.serialized_model_proto()), m.unk_id())

    @cached_property
    def ranks(self) -> dict[str, tuple[int, int]]:
        """(rank, id) of each plain piece; equal scores have one rank, the best is 0."""
        order = sorted({s for s, p in zip(self.scores, self.plain, strict=True) if p}, reverse=True)
        at = {s: r for r, s in enumerate(order)}
        out: dict[str, tuple[int, int]] = {}
        for i, (t, s, p) in enumerate(zip(self.texts, self.scores, self.plain, strict=True)):
            if p and (t not in out or at[s] < out[t][0]):
                out[t] = (at[s], i)
        return out

    @cached_property
    def late(self) -> frozenset[str]:
        """Pieces that one turn over the edges, best first and leftmost of equal ones, may come to too early.

        Until a piece forms, no merge crosses its ends, so what is between them evolves as it does alone.
        A piece that alone forms by merges of ever worse rank, its own the last, has formed when its turn ends."""
        out = set()
        for t, (rank, _) in self.ranks.items():
            symbols, last = list(t), (-1, "")
            while len(symbols) > 1:
                best, i = min((self.ranks.get(symbols[i] + symbols[i + 1], (1 << 40, 0))[0], i) for i in range(len(symbols) - 1))
                made = (best, symbols[i] + symbols[i + 1])
                if best > rank or best < last[0] or (best == last[0] and made != last):
                    out.add(t)
                    break
                symbols[i : i + 2] = [made[1]]
                last = made
        return frozenset(out)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters that some piece holds side by side: their touching bytes as a table, and both code points as sorted keys."""
        both = {(a, b) for t, p in zip(self.texts, self.plain, strict=True) if p for a, b in zip(t, t[1:], strict=False)}
        table = np.zeros((256, 256), bool)
        for a, b in both:
            table[a.encode()[-1], b.encode()[0]] = True
        return table, np.unique(np.array([ord(a) << 21 | ord(b) for a, b in both], np.uint64))

    def longest(self) -> int:
        return max(len(t) for t, p in zip(self.texts, self.plain, strict=True) if p)

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes and their offsets, as decoding writes them."""
        out = []
        for i, (t, p) in enumerate(zip(self.texts, self.plain, strict=True)):
            byte = i - self.byte_base if self.byte_base >= 0 else -1
            out.append(bytes([byte]) if 0 <= byte < 256 else t.encode() if p else b"")
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])


class Fold:
    """The ids of one unit, in Python: a heap of merges for BPE, one pass over the ends for unigram."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.ranks = pieces, pieces.ranks
        self.most = pieces.longest()
        self.least = min(s for s, p in zip(pieces.scores, pieces.plain, strict=True) if p) - 10.0

    def __call__(self, unit: str) -> list[int]:
        symbols = self._merged(unit) if self.pieces.kind == "bpe" else self._best(unit)
        out: list[int] = []
        for x in symbols:
            known = self.ranks.get(x)
            if known:
                out.append(known[1])
            else:
                out.extend(self.pieces.byte_base + b for b in x.encode()) if self.pieces.byte_base >= 0 else out.append(self.pieces.unknown)
        return out

    def _merged(self, unit: str) -> list[str]:
        n = len(unit)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i):
            j = after[i]
            if j < n and end[j] - i <= self.most and (known := self.ranks.get(unit[i : end[j]])):
                heapq.heappush(heap, (known[0], i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if end[i] >= e or end[i] == 0 or after[i] >= n or end[after[i]] != e:
                continue  # one of both symbols is gone
            j = after[i]
            end[i], after[i], end[j] = e, after[j], 0
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(unit[i : end[i]])
            i = after[i]
        return out

    def _best(self, unit: str) -> list[str]:
        n = len(unit)
        score, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.most), j):
                known = self.ranks.get(unit[i:j])
                s = self.pieces.scores[known[1]] if known else self.least if i == j - 1 else -np.inf
                if score[i] + s > score[j]:
                    score[j], back[j] = score[i] + s, i
        out, j = [], n
        while j:
            out.append(unit[back[j] : j])
            j = back[j]
        return out[::-1]


def _prefixed(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks read as spaces, and a space before each text that is not empty."""
    raw = buf.tobytes()
    if MARK.encode() in raw:
        parts = [raw[x:y].replace(MARK.encode(), b" ") for x, y in zip(off[:-1], off[1:], strict=True)]
        buf, off = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    full = off[1:] > off[:-1]
    return np.insert(buf, off[:-1][full], 0x20), off + np.concatenate([[0], np.cumsum(full)])


def _units(buf: np.ndarray, off: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Starts of units; they tile the texts."""
    if not len(buf):
        return np.zeros(0, np.int64)
    table, points = pairs
    new = np.ones(len(buf), bool)
    inner = (buf[1:] & 0xC0) == 0x80
    new[1:] = ~table[buf[:-1], buf[1:]] & ~inner
    wide = np.flatnonzero(~new[1:] & ~inner & ((buf[1:] >= 128) | (buf[:-1] >= 128))) + 1
    if len(wide):  # the bytes may touch in a piece: do the characters?
        first = np.flatnonzero(np.concatenate([[True], ~inner]))
        chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
        if len(chars) == len(first):  # else not UTF-8, and the bytes decide
            i = np.searchsorted(first, wide)
            new[wide] = K.member(points, chars[i - 1] << np.uint64(21) | chars[i]) < 0
    new[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(new)


class _Units:
    """The texts of one block, their units as places in `units`, which are the distinct ones in order of (shard, text)."""

    def __init__(self, bodies: list[bytes], pairs, shards: int):
        own = S.Texts(bodies)
        self.ids, self.null, self.off, self.buf = own.ids, own.null, own.off, own.buf
        buf, self.at = _prefixed(self.buf, self.off)
        self.starts = _units(buf, self.at, pairs)
        edges = np.append(self.starts, len(buf)).astype(np.int64)
        every = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(edges), pa.py_buffer(buf)).dictionary_encode()
        found = every.dictionary
        size = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
        raw = np.frombuffer(found.buffers()[2], np.uint8) if len(found) else np.zeros(0, np.uint8)
        shard = (K.mix(K.hash_words(raw, size[:-1], size[1:])) % np.uint64(shards)).astype(np.int64)
        order = pc.sort_indices(pa.table({"s": pa.array(shard), "u": found}), [("s", "ascending"), ("u", "ascending")])
        self.units = found.take(order)
        self.edges = np.searchsorted(shard[order.to_numpy()], np.arange(shards + 1))
        place = np.empty(len(found), np.int64)
        place[order.to_numpy()] = np.arange(len(found))
        self.which = place[every.indices.to_numpy()]

    def requests(self, block: int) -> list[tuple]:
        return [(int(s), block, S.pack_strings(self.units.slice(self.edges[s], self.edges[s + 1] - self.edges[s]))) for s in np.flatnonzero(np.diff(self.edges))]


def _merged_units(bodies: list[bytes]) -> pa.Array:
    """Distinct units of all requests to a shard, in order of their text."""
    both = pa.concat_arrays([S.unpack_strings(b) for b in bodies]).unique()
    return both.take(pc.sort_indices(both))


def _first(of: Column, keep) -> Column:
    return F.get(F.filter(of, keep), F.lit(0))


def _merge_fold(n: Column, merges: Column) -> Column:
    """Cuts between symbols after all merges; merges are sorted best first."""

    def step(cuts, _):
        fits = lambda m: (F.array_position(cuts, m["s"]) > 0) & (F.array_position(cuts, m["e"]) == F.array_position(cuts, m["s"]) + 2)
        best = F.array(_first(merges, fits))
        return F.get(F.transform(best, lambda b: F.when(b.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= b["s"]) | (c >= b["e"])))), F.lit(0))

    turns = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, F.sequence(F.lit(0), n), step)


def _viterbi_fold(n: Column, edges: Column, least: float) -> Column:
    """Cuts of the best path, of equal ones that with the longer last piece; a character without an edge of its own scores 10 below the least piece, as in the library."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def step(best, j):
        reach = F.transform(F.filter(edges, lambda x: x["e"] == j), lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("back")))
        bare = F.struct((F.get(best, j - 1)["score"] + F.lit(least - 10.0)).alias("score"), (1 - j).alias("back"))
        known = F.exists(edges, lambda x: (x["e"] == j) & (x["s"] == j - 1))
        return F.concat(best, F.array(F.array_max(F.concat(reach, F.array(F.when(~known, bare))))))

    best = F.aggregate(F.sequence(F.lit(1), n), first, step)

    def back(cuts, _):
        head = F.get(cuts, F.lit(0))
        return F.when(head > 0, F.concat(F.array(-F.get(best, head)["back"]), cuts)).otherwise(cuts)

    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)


def _edges(units: DataFrame, table: DataFrame, longest: int, *more: Column) -> DataFrame:
    """Rows (key, n, s, len, and the table's columns): the pieces that units (key, unit) of at most `SHORT` characters hold.

    The table has a piece "" for the row that keeps each unit."""
    n = F.char_length("unit")
    starts = units.where(n <= SHORT).select("key", "unit", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    span = F.sequence(F.when(F.col("s") == 0, 0).otherwise(1), F.least(F.lit(longest), F.col("n") - F.col("s")))
    spans = starts.select("key", "unit", "n", "s", F.explode(span).alias("len"))
    return spans.select("key", "unit", "n", "s", "len", F.expr("substring(unit, s + 1, len)").alias("piece")).join(F.broadcast(table), "piece")


def _char_bytes(char: Column, pieces: Pieces) -> Column:
    """Byte pieces of a character, or the unknown piece."""
    if pieces.byte_base < 0:
        return F.array(F.lit(pieces.unknown))
    spelled = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(char)), lambda k: F.conv(F.substr(spelled, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + pieces.byte_base)


def _bits(x: Column, by: int, width: int) -> Column:
    return F.shiftright(x, by).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _bpe_lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, ids) of units for a BPE model; ids are null where a character is in longer pieces only.

    An edge travels as one integer (rank, start, length, id).  Cuts between symbols are bits: an
    edge fits if both its ends are cuts and one cut lies inside; applying it clears that cut.
    Symbols are the edges with cuts at their ends only."""
    spark = units.sparkSession
    late = 1 << 25  # a flag beside the id
    rows = [(t, rank, i | late * (t in pieces.late)) for t, (rank, i) in pieces.ranks.items()]
    table = spark.createDataFrame([*rows, ("", 1 << 22, 0)], "piece string, rank long, id long")
    code = F.shiftleft("rank", 40).bitwiseOR(F.shiftleft(F.col("s").cast("long"), 32)).bitwiseOR(F.shiftleft(F.col("len").cast("long"), 26)).bitwiseOR(F.col("id"))
    edges = _edges(units, table, pieces.longest()).select("key", "n", F.when((F.col("len") == 0) & (F.col("n") == 1), F.col("unit")).alias("unit"), code.alias("code"))
    grouped = edges.groupBy("key").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("code")).alias("codes"), F.max("unit").alias("unit"))
    one = F.lit(1).cast("long")

    def opened(x):
        s, size = _bits(x, 32, 8), _bits(x, 26, 6)
        low, top = F.call_function("shiftleft", one, s), F.call_function("shiftleft", one, s + size)
        # the inner bits of a run from s to e are s + 1 to e - 1: 2^e - 2^(s + 1)
        return F.struct(top.bitwiseOR(low).alias("ends"), (top - low - low).alias("inner"), s.alias("s"), size.alias("size"), _bits(x, 0, 25).alias("id"), (_bits(x, 25, 1) > 0).alias("late"))

    grouped = grouped.withColumn("edges", F.transform(F.filter("codes", lambda x: _bits(x, 26, 6) > 0), opened))

    def fits(cuts, m):
        return (cuts.bitwiseAND(m["ends"]) == m["ends"]) & (F.bit_count(cuts.bitwiseAND(m["inner"])) == 1)

    every = F.call_function("shiftleft", one, F.col("n") + 1) - 1
    wide = F.filter("edges", lambda m: m["size"] > 1)
    once = F.aggregate(wide, every, lambda c, m: F.when(fits(c, m), c.bitwiseAND(F.bitwise_not(m["inner"]))).otherwise(c))
    anew = lambda c, _: c.bitwiseAND(F.bitwise_not(F.coalesce(_first(wide, lambda m: fits(c, m))["inner"], F.lit(0).cast("long"))))
    often = F.aggregate(F.sequence(F.lit(1), F.col("n")), every, anew)
    cuts = F.when(F.exists("edges", lambda m: m["late"]), often).otherwise(once) if pieces.late else once
    cut = grouped.withColumn("cuts", cuts)
    cuts = F.col("cuts")
    symbols = F.filter("edges", lambda m: (cuts.bitwiseAND(m["ends"]) == m["ends"]) & (cuts.bitwiseAND(m["inner"]) == 0))
    done = cut.select("key", "n", "unit", F.sort_array(F.transform(symbols, lambda m: F.struct(m["s"].alias("s"), m["size"].alias("size"), m["id"].alias("id")))).alias("y"))
    whole = F.aggregate("y", F.lit(0), lambda a, x: a + x["size"]) == F.col("n")
    bare = F.when((F.col("n") == 1) & (F.size("y") == 0), _char_bytes(F.col("unit"), pieces))
    return done.select("key", F.when(whole, F.transform("y", lambda x: x["id"])).otherwise(bare).alias("ids"))


def _unigram_lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, ids) of units for a unigram model, by Viterbi."""
    spark = units.sparkSession
    rows = [(t, i, float(pieces.scores[i])) for t, (_, i) in pieces.ranks.items()]
    edges = _edges(units, spark.createDataFrame([*rows, ("", -1, 0.0)], "piece string, id int, score double"), pieces.longest())
    edge = F.when(F.col("len") > 0, F.struct("s", (F.col("s") + F.col("len")).alias("e"), "id", "score"))
    lattice = edges.groupBy("key").agg(F.first("unit").alias("unit"), F.max("n").alias("n"), F.sort_array(F.collect_list(edge)).alias("edges"))
    least = min(s for s, p in zip(pieces.scores, pieces.plain, strict=True) if p)
    lattice = lattice.withColumn("cuts", _viterbi_fold(F.col("n"), F.col("edges"), least))

    def symbol(i):
        a, b = F.get("cuts", i - 1), F.get("cuts", i)
        whole = _first(F.col("edges"), lambda m: (m["s"] == a) & (m["e"] == b))["id"]
        return F.coalesce(F.when(whole.isNotNull(), F.array(whole)), _char_bytes(F.substr(F.col("unit"), a + 1, F.lit(1)), pieces))

    return lattice.select("key", F.flatten(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), symbol)).alias("ids"))


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, ids) of units (key, unit) of at most `SHORT` characters through the lattice; null ids are left to `Fold`."""
    return (_bpe_lattice if pieces.kind == "bpe" else _unigram_lattice)(units, pieces)


_SENT = "shard long, block long, body binary"


def _texts(flat: np.ndarray, edge: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """The texts of lists of ids, list i being flat[edge[i]:edge[i + 1]]; ids outside the table give nothing."""
    data, off = table
    known = (flat >= 0) & (flat < len(off) - 1)
    at = np.where(known, flat, 0)
    size = np.where(known, off[at + 1] - off[at], 0)
    raw = data[K.ranges(off[at], size)]
    cut = np.concatenate([[0], np.cumsum(size)])[edge]
    full = np.flatnonzero(cut[1:] > cut[:-1])
    lead = full[raw[cut[:-1][full]] == 0x20]  # the space that encoding put first
    raw = np.delete(raw, cut[:-1][lead])
    less = np.zeros(len(edge), np.int64)
    less[lead + 1] = 1
    cut = cut - np.cumsum(less)
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)])
    try:
        return made.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # byte pieces that make no character
        return pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.string())


def encode(docs: DataFrame, model: str | Pieces, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: doc_id, text (as given), ids (array<int>) and n_tokens; on request also decoded, the text of the ids."""
    pieces = model if isinstance(model, Pieces) else Pieces.load(model)
    pairs, table = pieces.pairs, pieces.bytes_of()
    _, n = S.sizes(docs, text_col)
    dealt = S.packed_blocks(docs, id_col, text_col, n)

    def request(rows: pa.Table) -> pa.Table:
        block = rows["block"][0].as_py()
        return S.table(_Units(rows["body"].to_pylist(), pairs, n).requests(block), "shard")

    def merge(rows: pa.Table) -> pa.Table:
        units = _merged_units(rows["body"].to_pylist())
        key = (rows["shard"][0].as_py() << 32) + np.arange(len(units))
        return pa.table({"key": pa.array(key, pa.int64()), "unit": units.cast(pa.string())})

    def answer(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return S.table([])
        bodies = rows["body"].to_pylist()
        units, fold = _merged_units(bodies), Fold(pieces)
        ids: list = [None] * len(units)
        for k, v in zip(known["key"].to_numpy() & 0xFFFFFFFF, known["ids"].to_pylist(), strict=True):
            ids[k] = v
        ids = [fold(units[i].as_py()) if v is None else v for i, v in enumerate(ids)]
        size = np.array([len(v) for v in ids], np.int64)
        flat = np.fromiter((x for v in ids for x in v), np.uint32, int(size.sum()))
        first = np.cumsum(size) - size
        out = []
        for block, body in zip(rows["block"].to_pylist(), bodies, strict=True):
            at = pc.index_in(S.unpack_strings(body), units).to_numpy()
            out.append((rows["shard"][0].as_py(), block, S.pack_lists(size[at], flat[K.ranges(first[at], size[at])])))
        return S.table(out)

    def put(rows: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Units(rows["body"].to_pylist(), pairs, n)
        told = sorted(zip(answers["key"].to_pylist(), answers["body"].to_pylist(), strict=True))  # units are in order of their shard
        lists = [S.unpack_lists(body) for _, body in told]
        size = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in lists)])
        flat = np.concatenate([np.zeros(0, np.uint32), *(y for _, y in lists)])
        first = np.cumsum(size) - size
        count = size[b.which]
        upto = np.concatenate([[0], np.cumsum(count)])
        edge = upto[np.searchsorted(b.starts, b.at)]
        tokens = flat[K.ranges(first[b.which], count)].astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(tokens))
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b.ids), [None, pa.py_buffer(b.off.astype(np.int64)), pa.py_buffer(b.buf)]).cast(pa.large_string()).cast(pa.string())
        text = pc.if_else(pa.array(b.null), pa.scalar(None, pa.string()), text)
        out = {"doc_id": pa.array(b.ids, pa.int64(), mask=b.ids == K.NULL_ID), "text": text, "ids": values, "n_tokens": pa.array(np.diff(edge), pa.int64())}
        return pa.table(out | ({"decoded": _texts(tokens, edge, table)} if decoded else {}))

    sent = dealt.groupBy("block").applyInArrow(K.lean(request), _SENT).repartition(n, "shard")
    units = sent.groupBy("shard").applyInArrow(K.lean(merge), "key long, unit string").repartition(n, "key")
    known = encode_units(units, pieces).withColumn("shard", F.shiftright("key", 32))
    answers = sent.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(K.lean(answer), S.WIRE)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(K.lean(put), "doc_id long, text string, ids array<int>, n_tokens long" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str | Pieces, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in `out_col`; null ids give null."""
    pieces = model if isinstance(model, Pieces) else Pieces.load(model)
    shared = rows.sparkSession.sparkContext.broadcast(pieces.bytes_of())
    names = rows.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                col = part[ids_col]
                lists = col.fill_null([]) if col.null_count else col
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                edge = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                made = pc.if_else(col.is_null(), pa.scalar(None, pa.string()), _texts(flat, edge, shared.value))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{out_col}` string")


def default_model() -> str:
    """The public BPE model of the machine; a parameter everywhere else."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Pieces.load(default_model())
    made = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces, decoded=True)
    return made.select("doc_id", "n_tokens", "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))
