"""Operators 1, 3 and 8 against brute force on small tables with every awkward case."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import jaccard_join, signature_tree, sketch, substring_dedup, suffix_dedup, suffix_sort

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, block long, key string, kept string"  # clashing extra columns


def corpus(seed: int, n: int = 120) -> list[tuple]:
    r = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "épée", "zu", "x"] + [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(vocab, k=r.randint(0, 90))) for _ in range(n // 3)]
    passage = " ".join(r.choices(vocab, k=70))
    rows = []
    for i in range(n):
        t = r.choice(base).split(" ")
        if i % 3 == 0:
            t = t[: r.randint(0, 40)] + passage.split(" ") + t[40:]
        if i % 4 == 0 and len(t) > 3:
            t[r.randrange(len(t))] = f"edit{i}"
        rows.append((i, r.choice([" ", "\n", "\t ", " "]).join(t)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "one two"), (n + 5, "ab " * 4000), (None, rows[0][1]), (7, rows[7][1])]
    return [(i, t, 1, "k", "c") for i, t in rows]


def brute_bytes(rows, length):
    order = sorted(((float("-inf") if i is None else i), i, (t or "").encode()) for i, t, *_ in rows)
    least = {}
    for k, _, b in order:
        for p in range(len(b) - length + 1):
            least.setdefault(b[p : p + length], k)
    out = []
    for k, i, b in order:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < k:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [30, 50])
def test_suffix_dedup_equals_brute_force(spark, length):
    rows = corpus(length)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA), length).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute_bytes(rows, length)


def test_suffix_dedup_of_a_passage_in_very_many_documents(spark):
    """More documents than `HOT` hold one anchor, each with its own surroundings."""
    r = random.Random(4)
    passage = "a passage of seventy bytes or so that is in every document of the table."
    rows = [(i, f"{r.random()}{passage}{r.random()}" if i % 5 else passage[: r.randint(50, 72)]) for i in range(1_400)]
    assert len(rows) > suffix_dedup.HOT
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute_bytes(rows, 50)


@pytest.mark.parametrize("op", ["suffix", "substring"])
def test_texts_beyond_one_step_of_a_block(spark, op, monkeypatch):
    """Long texts are worked on in steps; repeats across the steps' borders count."""
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(700_000)]  # over 4 MiB in one text
    cut = " ".join(words[520_000:540_000])
    rows = [(1, " ".join(words)), (2, "own start " + cut + " own end"), (3, "nothing of that " * 3)]
    assert len(rows[0][1]) > 1 << 22
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if op == "suffix":
        got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df).collect()}
        assert got[1].n_removed == 0 and got[2].kept == b"own startown end" and got[2].n_removed == len(cut) + 2
    else:
        got = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
        assert got[1].n_removed == 0 and got[2].kept == b"own start own end" and got[2].n_removed == 20_000


def test_kept_columns_travel_with_their_rows(spark):
    rows = [(7, "x" * 60 + "a", {"k": [1]}, 1.5), (7, "x" * 60 + "b", None, None), (None, None, {"z": []}, 2.0), (9, "x" * 60, {}, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept map<string,array<int>>, n_removed double")
    got = suffix_dedup.suffix_dedup(df, keep=["doc_id", "kept", "n_removed"]).collect()
    assert sorted(((r.row.doc_id, r.row.kept, r.row.n_removed, r.n_bytes) for r in got), key=str) == sorted(((i, k, n, len(t or "")) for i, t, k, n in rows), key=str)


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("width", [8, 50])
def test_deep_shallow_sorts(width):
    r = np.random.RandomState(width)
    rows = r.randint(97, 99, (400, width)).astype(np.uint8)
    rows[100:200] = rows[:100]
    rows[200:300, : min(width, 40)] = rows[0, : min(width, 40)]
    order, lcp = suffix_sort.deep_shallow(rows)
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(x.tobytes() for x in rows) and sorted(order) == list(range(400))
    for a, b, n in zip(texts, texts[1:], lcp[1:]):
        assert a[:n] == b[:n] and (n == width or a[n] != b[n])


def test_deep_shallow_takes_few_rounds(monkeypatch):
    """A round sorts whole groups by a character, so their number follows the characters, not the rows; copies enter a trie once."""
    r = np.random.RandomState(5)
    rows = r.randint(0, 256, (20_000, 50)).astype(np.uint8)
    rows[:300, :40] = rows[0, :40]  # one trie
    rows[10_000:] = rows[:10_000]
    sorts, leaves = [], []
    argsort, node = np.argsort, suffix_sort._Node
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or argsort(*a, **b))
    monkeypatch.setattr(suffix_sort, "_Node", lambda *a, **b: leaves.append("rows" in b) or node(*a, **b))
    order, _ = suffix_sort.deep_shallow(rows)
    assert [rows[i].tobytes() for i in order] == sorted(x.tobytes() for x in rows)
    assert len(sorts) <= 8 and sum(leaves) == 300


def test_anchors_of_a_block_work_in_small_steps():
    """Passes over a block's bytes reuse the memory of one step."""
    r = np.random.RandomState(6)
    texts = [r.randint(97, 123, n).astype(np.uint8).tobytes() for n in [3_000] * 500 + [0, 20, 49, 50, 51] + [700_000]]
    ids = np.arange(len(texts))
    raw = sketch._squeeze(b"".join(texts))
    body = len(ids).to_bytes(4, "little") + ids.tobytes() + np.zeros(len(ids), bool).tobytes() + np.array([len(x) for x in texts]).tobytes() + len(raw).to_bytes(8, "little") + raw
    rows = pa.table({"block": [0], "body": pa.array([body], pa.binary())})
    tracemalloc.start()
    try:
        a = suffix_dedup._Anchors(rows, 50)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (a.hi - a.lo + 1).sum() == sum(max(0, len(x) - 49) for x in texts)  # every string has one anchor
    assert ((a.lo <= a.at) & (a.at <= a.lo + 26) & (a.hi <= a.at)).all() and (a.block.off[a.doc + 1] >= a.hi + 50).all()
    assert peak < 12 * len(a.block.buf)


def brute_windows(rows, n):
    order = sorted(((float("-inf") if i is None else i), t or "", i) for i, t, *_ in rows)
    seen, out = set(), []
    for _, t, i in order:
        w = SPACE.findall(t)
        gone = set()
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            if key in seen:
                gone.update(range(p, p + n))
            seen.add(key)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus(8)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept.decode()) for r in got), key=str) == brute_windows(rows, 20)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_dedup_of_an_empty_table(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_never_underestimates():
    r = np.random.RandomState(0)
    keys = r.randint(0, 2**63, 3000).astype(np.uint64)
    s = sketch.Sketch(5000, 2, 4)
    blocks = [np.concatenate([keys[: 1000 + 500 * b], keys[:50]]) for b in range(3)]
    wire = sketch.table([row for b, h in enumerate(blocks) for row in s.emit(b, h)])
    import pyarrow as pa
    import pyarrow.compute as pc

    answers = pa.concat_tables([sketch.merge_shard(wire.filter(pc.equal(wire["key"], k))) for k in set(wire["key"].to_pylist())])
    for b, h in enumerate(blocks):
        true = np.array([sum((x == k).sum() for x in blocks) for k in h])
        assert (s.estimate(h, s.answers(answers.filter(pc.equal(answers["block"], b)))) >= true).all()


@pytest.mark.parametrize("gaps", [[0], [1, 5, 300, 255, 254, 70000], []])
def test_gap_code_round_trip(gaps):
    cells = np.cumsum(np.array(gaps, np.int64) + 1)
    assert (sketch.unpack_sorted(sketch.pack_sorted(cells)) == cells).all()


def brute_components(rows, percent=75):
    sets = {}
    for i, t, *_ in rows:
        w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault((float("-inf") if i is None else i), []).append(grams)
    ids = list(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if any(100 * len(a & b) >= percent * len(a | b) and a and b for a in sets[ids[x]] for b in sets[ids[y]]):
                a, b = find(ids[x]), find(ids[y])
                up[max(a, b)] = min(a, b)
    real = lambda i: None if i == float("-inf") else i
    return sorted(((real(i), len(s), real(find(i))) for i in ids for s in sets[i]), key=str)


@pytest.mark.parametrize("chunk", [256, 3])
def test_jaccard_components_equal_brute_force(spark, chunk):
    rows = [r for r in corpus(5) if r[0] is not None]
    r = random.Random(1)
    words = [f"v{i}" for i in range(60)]
    for k in range(40):  # a large group of near copies in chains
        own = list(words)
        for j in range(k // 4):
            own[(7 * j) % 60] = f"e{k // 8}-{j}"
        rows.append((1000 + k, " ".join(own), 1, "k", "c"))
    r.shuffle(rows)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), chunk=chunk).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute_components(rows)


def test_jaccard_components_of_nulls_and_nothing(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    got = jaccard_join.jaccard_components(spark.createDataFrame([(None, "a b c d e f", 1, "", ""), (3, "A b c d e f", 1, "", ""), (4, None, 1, "", "")], SCHEMA)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(None, 2, None), (3, 2, None), (4, 0, 4)}


def test_signature_tree_bound_loses_no_pair():
    r = np.random.RandomState(2)
    sets = [np.unique(r.randint(0, 400, r.randint(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)]
    sets += [s[: max(1, int(len(s) * 0.9))] for s in sets[:20]]
    frozen = [frozenset(s.tolist()) for s in sets]
    groups = signature_tree.Groups(len(sets))
    tree = signature_tree.build(sets, list(range(len(sets))))
    signature_tree.linked(tree, tree, frozen, groups, 75)
    for i in range(len(sets)):
        for j in range(i):
            if signature_tree.similar(frozen[i], frozen[j], 75):
                assert groups.find(i) == groups.find(j)


def test_near_duplicate_groups_equal_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from corpusloom.llm.near_groups import near_duplicate_groups

    r = random.Random(5)
    base = [[f"w{k}_{i}" for i in range(20)] for k in range(4)]
    data = [(i, b) for i, b in enumerate(base)] + [(10, base[0][::-1]), (11, base[0] + base[0][:3]), (12, base[0]), (13, base[1][1:]), (14, base[1][2:]), (15, base[1][3:]), (16, base[1][3:][::-1]), (17, []), (18, None), (19, ["lone"])]
    data += [(30 + i, r.sample(base[2], 18) + ["z"] * (i % 2)) for i in range(12)]
    got = {x.id: x for x in near_duplicate_groups(spark.createDataFrame(data, "id long, s array<string>"), "id", F.col("s")).collect()}
    sets = {i: frozenset(s or ()) for i, s in data}
    near = {i: {j for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])} for i in sets}
    assert set(got) == set(sets)
    for i in sets:
        reach, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - reach)
            reach |= new
        assert got[i].links == len(near[i])
        assert got[i].class_id == (min(j for j in sets if sets[j] == sets[i]) if sets[i] else None)
        assert got[i].component_id == (min(reach) if sets[i] else None)
    assert got[12].class_id == 0 and got[12].links == 3 and got[16].component_id == 1
