"""Operator 3: exact n-gram Jaccard join with signature trees.

1. Blocks of documents send their distinct shingles to a count-min sketch.  A document
   whose possibly shared shingles are fewer than the threshold needs has no partner.
2. Of the others, equal sets become one class (blocks fold their own first).  Classes
   that link share one of the rarest shingles of either (prefix filter, rarest by merged
   count).  For each such shingle its least class is the *hub*; two classes with a common
   prefix shingle meet in that hub's group.
3. A hub's classes are dealt by size range into chunks of about `CHUNK`, the hub in each.  A
   chunk builds a signature tree and joins it with itself.  Classes that no chunk could tie
   to the hub are dealt into chunks as well, and each of these meets the trees of the chunks
   of its own and the neighbouring size ranges (others cannot link).  Two classes tied to the
   hub need no comparison.  So a task gets two chunks at most, and no pairs are listed; how
   many chunks meet grows with the square of a hub's classes that are unlike the hub.
4. The links form components by least labels.

Edge cases: null text counts as empty; documents without words are alone; rows that share
an id are one node, so their links are pooled; null ids come first and give a null id;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm import signature_tree as T
from corpusloom.llm import sketch as S
from corpusloom.llm.components import connected_components
from corpusloom.llm.skew import skew_join
from corpusloom.llm.store import save

#: Classes of one hub that one task compares.
CHUNK = 96
_SETS = "doc_id long, n_shingles long, digest binary, prefix array<long>, tokens binary"


class _Shingles:
    """Sorted distinct shingle hashes of each document of a block."""

    def __init__(self, rows: pa.Table, n: int):
        self.block = b = S.block_of(rows)
        parts, self.off = [], np.zeros(b.n + 1, np.int64)
        for d, e, x, y in b.pieces(1 << 20):
            buf, off = K.LOWER[b.buf[x:y]], b.off[d : e + 1] - x
            s, t, first = K.words(buf, off)
            h = K.hash_words(buf, s, t)
            grams = K.hash_windows(h, n)
            for i in range(e - d):
                w, z = int(first[i]), int(first[i + 1])
                if z - w >= n:
                    own = np.unique(grams[w : z - n + 1])
                else:
                    own = K.hash_windows(h[w:z], z - w, 100 + z - w) if z > w else h[:0]
                parts.append(own)
                self.off[d + i + 1] = len(own)
        np.cumsum(self.off, out=self.off)
        self.h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _sets(percent: int, n: int, sketch: S.Sketch):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sets_table([], [], [], [], [])
        sh = _Shingles(rows, n)
        count = sketch.estimate(sh.h, sketch.answers(answers))
        size = np.diff(sh.off)
        need = -(-percent * size // 100)
        shared = np.concatenate([[0], np.cumsum(count > 1)])
        shared = shared[sh.off[1:]] - shared[sh.off[:-1]]
        digests, prefixes, tokens, seen = [None] * len(size), [None] * len(size), [None] * len(size), set()
        for i in np.flatnonzero((shared >= need) & (size > 0)):
            own, c = sh.h[sh.off[i] : sh.off[i + 1]], count[sh.off[i] : sh.off[i + 1]]
            digests[i] = digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            if digest in seen:
                continue
            seen.add(digest)
            rare = np.flatnonzero(c > 1)
            rare = rare[np.lexsort((own[rare], c[rare]))][: int(shared[i] - need[i] + 1)]
            prefixes[i], tokens[i] = own[rare].view(np.int64), own.tobytes()
        return _sets_table(sh.block.ids, size, digests, prefixes, tokens)

    return run


def _sets_table(ids, size, digests, prefixes, tokens) -> pa.Table:
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_shingles": pa.array(size, pa.int64()),
            "digest": pa.array(digests, pa.binary()),
            "prefix": pa.array(prefixes, pa.list_(pa.int64())),
            "tokens": pa.array(tokens, pa.binary()),
        }
    )


_LINKS = "hub long, chunk long, rep long, root long, tied boolean"


def size_range(size: Column, percent: int) -> Column:
    """Sets of neighbouring or equal ranges only can be similar enough: their sizes differ by a factor of 100 / percent at most."""
    return F.floor(F.log(size) / (math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9)).cast("long")


def _join_chunk(percent: int):
    """Signature-tree self join of a chunk; rows with query = true are only matched with the others."""

    def run(rows: pa.Table) -> pa.Table:
        hub, chunk = rows["hub"][0].as_py(), rows["chunk"][0].as_py()
        reps, query = rows["rep"].to_numpy(), rows["query"].to_numpy(zero_copy_only=False)
        order = np.lexsort((query, reps))
        arrays = [np.frombuffer(rows["tokens"][int(i)].as_py(), np.uint64) for i in order]
        reps, query = reps[order], query[order]
        sets = [frozenset(a.tolist()) for a in arrays]
        groups = T.Groups(len(reps))
        for i in range(1, len(reps)):  # rows of one id are one node
            if reps[i] == reps[i - 1]:
                groups.join(i, i - 1)
        own, asked = np.flatnonzero(~query).tolist(), np.flatnonzero(query).tolist()
        if asked:
            T.linked(T.build(arrays, own), T.build(arrays, asked), sets, groups, percent)
        else:
            at_hub = int(np.searchsorted(reps, hub))
            for i in range(len(reps)):
                if groups.find(i) != groups.find(at_hub) and T.similar(sets[at_hub], sets[i], percent):
                    groups.join(i, at_hub)
            tree = T.build(arrays, own)
            T.linked(tree, tree, sets, groups, percent)
        root = np.array([groups.find(i) for i in range(len(reps))])
        at = int(np.searchsorted(reps, hub))
        tied = root == root[at] if at < len(reps) and reps[at] == hub else np.zeros(len(reps), bool)
        n = len(reps)
        return pa.table({"hub": pa.array([hub] * n, pa.int64()), "chunk": pa.array([chunk] * n, pa.int64()), "rep": pa.array(reps, pa.int64()), "root": pa.array(reps[root], pa.int64()), "tied": pa.array(tied, pa.bool_())})

    return run


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id reachable by links of Jaccard >= percent / 100."""
    total, blocks = S.sizes(docs, text_col, 10 << 20)  # larger blocks send fewer cells and bodies
    sketch = S.Sketch(total // 6, rows=1)
    dealt = S.packed_blocks(docs, id_col, text_col, blocks)

    def emit(rows: pa.Table) -> pa.Table:
        return S.table(sketch.emit(rows["block"][0].as_py(), _Shingles(rows, n).h))

    answers = S.merged(dealt.groupBy("block").applyInArrow(K.lean(emit), S.WIRE), sketch)
    sets = save(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(K.lean(_sets(percent, n, sketch)), _SETS))

    classes = save(sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    heads = sets.where("tokens IS NOT NULL").join(classes, "digest").where("doc_id = rep")
    heads = save(heads.dropDuplicates(["digest"]).select("rep", "prefix", "tokens", size_range(F.octet_length("tokens") / 8, percent).alias("range")))
    terms = heads.select("rep", "range", F.explode("prefix").alias("term"))
    hubs = terms.groupBy("term").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("term", "hub")
    members = save(terms.join(hubs, "term").select("hub", "rep", "range").distinct())

    def chunked(rows: DataFrame, name: str) -> DataFrame:
        """Rows (hub, rep, range) with the chunk of their size range: range * 2^32 and a number below the chunks of the range."""
        size = rows.groupBy("hub", "range").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
        return rows.join(size, ["hub", "range"]).withColumn(name, F.shiftleft("range", 32) + F.pmod(F.xxhash64("rep"), F.col("chunks"))).drop("chunks")

    others = chunked(members.where("rep <> hub"), "chunk").select("hub", "chunk", "rep")
    hub_rows = others.select("hub", "chunk").distinct().select("hub", "chunk", F.col("hub").alias("rep"))
    bodies = heads.select("rep", "tokens")
    plan = save(others.unionByName(hub_rows))
    first = plan.join(bodies, "rep").select("hub", "chunk", "rep", F.lit(False).alias("query"), "tokens")
    links = save(first.groupBy("hub", "chunk").applyInArrow(K.lean(_join_chunk(percent)), _LINKS))

    # classes not tied to their hub, against the hub's chunks of similar sizes
    many = plan.groupBy("hub").agg(F.count_distinct("chunk").alias("k")).where("k > 1").select("hub")
    loose = links.where("NOT tied").join(many, "hub").select("hub", "rep").distinct().join(members, ["hub", "rep"])
    loose = save(chunked(loose, "asked").select("hub", "rep", "asked"))
    trees = plan.select("hub", "chunk").distinct().withColumn("near", F.shiftright("chunk", 32))
    asking = loose.select("hub", "asked").distinct().withColumn("near", F.explode(F.array(*[F.shiftright("asked", 32) + i for i in (-1, 0, 1)])))
    meet = save(trees.join(asking, ["hub", "near"]).select("hub", "chunk", "asked"))
    own = meet.join(plan, ["hub", "chunk"]).select("hub", "chunk", "asked", "rep", F.lit(False).alias("query"))
    queries = meet.join(loose, ["hub", "asked"]).select("hub", "chunk", "asked", "rep", F.lit(True).alias("query"))
    # written first: a union of differently dealt sides must not pass for one that is dealt by group
    second = save(own.unionByName(queries)).join(bodies, "rep").select("hub", "chunk", "asked", "rep", "query", "tokens")
    more = second.groupBy("hub", "chunk", "asked").applyInArrow(K.lean(_join_chunk(percent)), _LINKS)

    edges = links.unionByName(more).select(F.col("rep").alias("a"), F.col("root").alias("b"))
    label = connected_components(edges)
    named = save(classes.join(label, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("component")))
    out = skew_join(sets.select("doc_id", "n_shingles", "digest"), named, "digest")
    known = lambda c: F.when(c != K.NULL_ID, c)
    return out.select(known(F.col("doc_id")).alias("doc_id"), "n_shingles", known(F.coalesce("component", "doc_id")).alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
