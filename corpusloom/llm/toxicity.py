"""Operator 9: toxicity by class-conditional Kneser-Ney models over word prefixes.

Each class (toxic, ordinary) has a Kneser-Ney model of words as paths in a prefix tree:
root, first 4 bytes, first 5, first 6, whole word.  The count of a node is over contexts,
here documents.  A child's probability in a class is (count - 1 + (types + MASS) * shared)
/ (parent count + MASS), where `types` is the number of children that the class has seen
there, `shared` is the child's share of its parent in ALL documents and MASS (100) steadies
small classes.  So a rare or unseen word falls back
on its prefix, and both classes fall back on the same corpus-wide counts.

The score compares the length-normalised log-likelihoods of a document's distinct words
under an ordinary model and under a mixture in which a share `SHARE` of the words is toxic:
the mean over all words of log(1 + SHARE * (exp(r) - 1)), r being the word's log ratio of
both classes.  So a few toxic words tell in a long text, every word counts, and words of
the ordinary class count against.  Few toxic rows of a language tilt every ratio in that
language; r is therefore taken above the median over all words of ALL documents of the
language, or of the corpus for languages of under `LEAST_DOCS` documents and for tables
without languages.  A logistic curve, fitted on a fifth of the labelled rows by a
model that did not see them, turns it into a number from 0 to 1.  Class counts come from at most
`max_labelled` labelled rows, the ones with the least hashes of their ids; this bounds the
model, which is broadcast.  Backoff counts and scores cover every word of every document.

Edge cases: null or empty text has no words and scores as a difference of 0; null ids are
scored but never learned from; repeated labels of one id count as their largest value;
null labels are not used; with no toxic or no ordinary training row every score is 0;
columns other than the id, the text and the language are not read, so clashing names
cannot matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm.store import save

#: Labelled rows that class counts are taken from, at most.
MAX_LABELLED = 20_000
#: Prefix lengths in bytes above the whole word.
PREFIXES = (4, 5, 6)
#: Weight of the shared counts beside the discounts, and the share of toxic words in a toxic document.
MASS, SHARE = 100.0, 0.02
#: A language of fewer documents is centred on the whole corpus; medians are taken over bins of this width.
LEAST_DOCS, BIN = 100, 0.01
#: Words are runs of ASCII letters and digits and of non-ASCII bytes.
_SEP = np.ones(256, bool)
_SEP[128:] = _SEP[48:58] = _SEP[65:91] = _SEP[97:123] = False
_LEVEL = K.odd(31, len(PREFIXES) + 1)
_NONE = np.iinfo(np.int64).min


def _paths(buf: np.ndarray, off: np.ndarray):
    """For each document its distinct words as rows of node keys, root side first (0: the word is no longer than that prefix); offsets."""
    s, t, first = K.words(buf, off, _SEP)
    h = K.hash_words(buf, s, t)
    pick, at = [], np.zeros(len(off), np.int64)
    for d in range(len(off) - 1):
        a, b = int(first[d]), int(first[d + 1])
        own = np.unique(h[a:b], return_index=True)[1] + a if b > a else np.zeros(0, np.int64)
        pick.append(own)
        at[d + 1] = len(own)
    pick = np.concatenate(pick) if pick else np.zeros(0, np.int64)
    s, t, h = s[pick], t[pick], h[pick]
    keys = np.zeros((len(pick), len(PREFIXES) + 1), np.uint64)
    for j, n in enumerate(PREFIXES):
        longer = np.flatnonzero(t - s > n)
        if len(longer):
            by = np.argsort(s[longer], kind="stable")
            keys[longer[by], j] = K.mix(K.hash_words(buf, s[longer][by], s[longer][by] + n) + _LEVEL[j])
    keys[:, -1] = K.mix(h + _LEVEL[-1])
    return keys, np.cumsum(at)


def _batches(batches, id_col: str, text_col: str):
    """(ids, distinct word paths, offsets, rows of the batch) in steps of bounded size."""
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            b = K.to_block(pa.Table.from_batches([batch.slice(first, 500)]), id_col, text_col)
            for d, e, x, y in b.pieces(1 << 20):
                keys, at = _paths(K.LOWER[b.buf[x:y]], b.off[d : e + 1] - x)
                yield b.ids[d:e], keys, at, batch.slice(first + d, e - d)
    K.release()


@dataclass
class Model:
    """Sorted node keys; step: log ratio of a node given its parent; stop: of an unseen child below it; root_stop likewise."""

    keys: np.ndarray
    step: np.ndarray
    stop: np.ndarray
    root_stop: float | np.ndarray

    def ratios(self, paths: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio, toxic to ordinary, of each word; a row of them for a pair of models."""
        total = np.zeros((len(paths), *self.step.shape[1:]))
        rest = np.broadcast_to(self.root_stop, total.shape).copy()
        live = np.ones(len(paths), bool)
        leaf = paths.shape[1] - 1
        for j in range(leaf + 1):
            i = np.flatnonzero(live & (paths[:, j] != 0))
            at = K.member(self.keys, paths[i, j])
            hit = at >= 0
            total[i[hit]] += self.step[at[hit]]
            rest[i[hit]] = self.stop[at[hit]] if j < leaf else 0.0
            live[i[~hit]] = False
        return total + rest


def _count_nodes(docs: DataFrame):
    """Kept nodes (node, parent, leaf, t0, o0, t1, o1 and numbers of children n_*) and the same of the root.

    Counts are documents by class and part; docs has doc_id, text, toxic, half.  Both tables are bounded by the sample."""

    def run(batches):
        for batch in batches:
            kind = dict(zip(batch["doc_id"].to_pylist(), (2 * h + 1 - t for t, h in zip(batch["toxic"].to_pylist(), batch["half"].to_pylist(), strict=True)), strict=True))
            for ids, keys, at, _ in _batches([batch], "doc_id", "text"):
                which = np.repeat([kind[i] for i in ids.tolist()], np.diff(at)).astype(np.int64)
                parent = np.full(len(keys), 0, np.uint64)
                for j in range(keys.shape[1]):
                    i = np.flatnonzero(keys[:, j] != 0)
                    node, index = np.unique(keys[i, j], return_inverse=True)
                    counts = [np.bincount(index, weights=which[i] == c, minlength=len(node)).astype(np.int64) for c in range(4)]
                    up = np.zeros(len(node), np.uint64)
                    up[index] = parent[i]
                    parent[i] = keys[i, j]
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(up.view(np.int64)), pa.array(np.full(len(node), j == keys.shape[1] - 1)), *(pa.array(c) for c in counts)], ["node", "parent", "leaf", "t0", "o0", "t1", "o1"])

    raw = docs.mapInArrow(run, "node long, parent long, leaf boolean, t0 long, o0 long, t1 long, o1 long")
    counts = ("t0", "o0", "t1", "o1")
    nodes = save(raw.groupBy("node").agg(F.first("parent").alias("parent"), F.first("leaf").alias("leaf"), *(F.sum(c).alias(c) for c in counts)))
    # children that each class has seen below a node, by half and in all; and the counts below the root
    seen = {c: F.col(c) > 0 for c in counts} | {"t": F.col("t0") + F.col("t1") > 0, "o": F.col("o0") + F.col("o1") > 0}
    below = nodes.groupBy(F.col("parent").alias("p")).agg(*(F.count_if(x).alias(f"n_{c}") for c, x in seen.items()), *(F.sum(c).alias(f"sum_{c}") for c in counts))
    below = save(below)
    # a word of one document has no mass beyond the shared one, so only its parent's counts need it
    keep = nodes.where(~F.col("leaf") | (F.col("t0") + F.col("t1") > 1) | (F.col("o0") + F.col("o1") > 1))
    kept = keep.join(below.drop(*(f"sum_{c}" for c in counts)), F.col("node") == F.col("p"), "left").drop("p").fillna(0)
    return kept.toArrow().to_pandas(), below.where("p = 0").toArrow().to_pandas()


def _shared_counts(docs: DataFrame, nodes: np.ndarray, id_col: str, text_col: str) -> np.ndarray:
    """In how many documents each node occurs with each of its words, over all documents; the last number is the root's."""
    known = docs.sparkSession.sparkContext.broadcast(nodes)

    def run(batches):
        total = np.zeros(len(known.value) + 1, np.int64)
        for _, keys, _, _ in _batches(batches, id_col, text_col):
            total[-1] += len(keys)
            for j in range(keys.shape[1]):
                at = K.member(known.value, keys[:, j])
                total += np.bincount(at[at >= 0], minlength=len(total))
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(total[i])], ["i", "n"])

    got = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(len(nodes) + 1, np.int64)
    out[got["i"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _model(nodes, root, half: str, shared: np.ndarray, root_shared: int) -> Model:
    """Kneser-Ney log ratios of nodes sorted by key; half: "0" for the first part of the sample, "" for all of it."""
    count = lambda d, c, pre="": (d[f"{pre}{c}{half}"] if half else d[f"{pre}{c}0"] + d[f"{pre}{c}1"]).to_numpy(float)
    node, parent = nodes["node"].to_numpy(np.int64).view(np.uint64), nodes["parent"].to_numpy(np.int64).view(np.uint64)
    up = np.where(parent == 0, len(node), np.searchsorted(node, parent))
    share = shared / np.maximum(np.append(shared, root_shared)[up], 1)
    log_ratio = []
    for c in "to":
        own, every = count(nodes, c), np.append(count(nodes, c), count(root, c, "sum_"))
        types = np.append(nodes[f"n_{c}{half}"].to_numpy(float), root[f"n_{c}{half}"].to_numpy(float))
        given = (np.maximum(own - 1, 0) + (types[up] + MASS) * share) / (every[up] + MASS)
        log_ratio.append((np.log(given), np.log((types + MASS) / (every + MASS))))
    (step_t, stop_t), (step_o, stop_o) = log_ratio
    stop = stop_t - stop_o
    return Model(node, step_t - step_o, stop[:-1], float(stop[-1]))


def _columns(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))


def _usual(docs: DataFrame, half: Model, full: Model) -> list[dict]:
    """For both models, which have the same nodes, the median log ratio over all words of all documents, by language; None: of the corpus."""
    pair = Model(full.keys, np.stack([half.step, full.step], axis=1), np.stack([half.stop, full.stop], axis=1), np.array([half.root_stop, full.root_stop]))
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    far = 3000  # bins to each side; a ratio beyond them is on its side of any median

    def run(batches):
        names: dict = {}
        counts: dict = {}
        for _, keys, at, rows in _batches(batches, "doc_id", "text"):
            own = np.array([names.setdefault(x, len(names)) for x in rows["lang"].to_pylist()], np.int64)
            here, local = np.unique(own, return_inverse=True)
            word = np.repeat(local, np.diff(at)) * (2 * far + 1) + far
            cells = np.clip(np.round(shared.value.ratios(keys) / BIN), -far, far).astype(np.int64)
            for m in range(2):
                n = np.bincount(word + cells[:, m], minlength=len(here) * (2 * far + 1)).reshape(len(here), -1)
                for k, row in zip(here.tolist(), n, strict=True):
                    counts[k, m] = counts.get((k, m), 0) + row
            for k, c in zip(here.tolist(), np.bincount(local).tolist(), strict=True):
                counts[k, -1] = counts.get((k, -1), 0) + np.array([c])
        lang = list(names)
        for (k, m), row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang[k]] * len(at), pa.string()), pa.array([m] * len(at), pa.int64()), pa.array(at - far), pa.array(row[at])], ["lang", "model", "bin", "n"])

    cells = save(docs.mapInArrow(run, "lang string, model long, bin long, n long").groupBy("lang", "model", "bin").agg(F.sum("n").alias("n")))
    words, middle = cells.where("model >= 0"), F.percentile("bin", F.lit(0.5), F.col("n")).alias("bin")
    common = cells.where(f"model = -1 AND lang IS NOT NULL AND n >= {LEAST_DOCS}").select("lang")
    by_lang = words.join(F.broadcast(common), "lang").groupBy("lang", "model").agg(middle)
    every = words.groupBy("model", "bin").agg(F.sum("n").alias("n")).groupBy("model").agg(middle)
    out: list[dict] = [{None: 0.0}, {None: 0.0}]
    for r in every.select(F.lit(None).cast("string").alias("lang"), "model", "bin").unionByName(by_lang).collect():
        out[r.model][r.lang] = r.bin * BIN
    return out


def _score(docs: DataFrame, model: Model, usual: dict) -> DataFrame:
    """Rows (doc_id, n_types, llr): the mean log-likelihood ratio of the document's distinct words, a toxic mixture to ordinary."""
    shared = docs.sparkSession.sparkContext.broadcast((model, usual))

    def run(batches):
        model, usual = shared.value
        for ids, keys, at, rows in _batches(batches, "doc_id", "text"):
            n = np.diff(at)
            base = np.array([usual.get(x, usual[None]) for x in rows["lang"].to_pylist()], float)
            above = np.minimum(model.ratios(keys) - np.repeat(base, n), 50.0)
            upto = np.concatenate([[0.0], np.cumsum(np.log1p(SHARE * np.expm1(above)))])
            mean = (upto[at[1:]] - upto[at[:-1]]) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == _NONE), pa.array(n), pa.array(mean)], ["doc_id", "n_types", "llr"])

    return docs.mapInArrow(run, "doc_id long, n_types long, llr double")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps with a small ridge."""
    mean, dev = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / dev, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + 0.01 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / dev), float(w[1] - w[0] * mean / dev)


def held_out(doc_id) -> object:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, lang_col: str | None = "lang") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, llr (mean log-likelihood ratio) and n_types."""
    docs = _columns(docs, id_col, text_col, lang_col)
    id_col, text_col = "doc_id", "text"
    key = F.col(id_col).cast("long")
    own = labels.where(F.col(label_col).isNotNull() & key.isNotNull()).groupBy(key.alias("doc_id")).agg((F.max(label_col).cast("int") > 0).cast("int").alias("toxic"))
    known = docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"), "lang").join(own, "doc_id").where(~held_out(F.col("doc_id")))
    if max_labelled:
        least = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_labelled).agg(F.max("h").alias("top"), F.count("*").alias("n")).first()
        if least["n"] == max_labelled:
            known = known.where(F.xxhash64("doc_id") <= least["top"])
    known = known.withColumn("half", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0).cast("int"))  # the curve is fitted on this fifth
    known = save(known)  # a bounded number of rows
    own = save(own.join(known.select("doc_id"), "doc_id", "left_semi"))
    nodes, root = _count_nodes(known)
    out = lambda s, d: d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), "llr", "n_types")
    if not len(root) or not (root["sum_t0"] + root["sum_t1"]).sum() or not (root["sum_o0"] + root["sum_o1"]).sum():
        none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0)
        return out(F.lit(0.0), _score(docs, none, {None: 0.0}))
    nodes = nodes.iloc[np.argsort(nodes["node"].to_numpy(np.int64).view(np.uint64))].reset_index(drop=True)
    counts = _shared_counts(docs, nodes["node"].to_numpy(np.int64).view(np.uint64), id_col, text_col)
    shared, total = np.maximum(counts[:-1], 1).astype(float), counts[-1]
    half, full = _model(nodes, root, "0", shared, total), _model(nodes, root, "", shared, total)
    usual = _usual(docs, half, full)
    unseen = _score(known.where("half = 1").select("doc_id", "text", "lang"), half, usual[0]).join(own, "doc_id").select("llr", "toxic").toArrow().to_pandas()
    if unseen["toxic"].nunique() == 2:
        slope, offset = _logistic(unseen["llr"].to_numpy(float), unseen["toxic"].to_numpy(float))
    else:
        slope, offset = 1.0, 0.0
    scored = _score(docs, full, usual[1])
    return out(1 / (1 + F.exp(-(F.lit(slope) * F.col("llr") + F.lit(offset)))), scored)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")
