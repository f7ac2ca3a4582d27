"""Operators 2, 6, 7, 9 and 10 and the pipeline on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from corpusloom.llm import decontaminate, language_id, quality, sharding, toxicity

WORD6 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, w string, key string, n long, start string"


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_decontaminate(docs, items, window=10):
    grams = {}
    for item, t in items:
        w = WORD6.findall(ascii_lower(t))
        n = min(len(w), window)
        for p in range(len(w) - n + 1) if n and item is not None else ():
            grams.setdefault(tuple(w[p : p + n]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w = WORD6.findall(ascii_lower(t))
        hit, ids = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    ids |= own
        out.append((i, len(w), len(hit), sorted(map(str, ids)), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate_equals_brute_force(spark):
    r = random.Random(4)
    words = [f"t{i}" for i in range(60)] + ["Ünder", "É", "née"]
    items = [(i, " ".join(r.choices(words, k=k))) for i, k in enumerate([14, 10, 9, 6, 5, 2, 1, 25, 0])] + [(8, None), (None, "a b"), (3, "t1, t2"), (20, "t1 T2")]
    docs = [(i, ". ".join(r.choices(words, k=r.randint(0, 60)))) for i in range(60)]
    for i in range(0, 60, 3):
        part = (items[i % 8][1] or "").split(" ")
        docs[i] = (i, docs[i][1] + " " * (i % 2) + "\n" + " ".join(part[: r.randint(1, len(part))]).upper().replace("Ü", "Ü") + " tail " + docs[i][1])
    docs += [(70, None), (71, ""), (5, docs[5][1]), (None, docs[0][1])]
    df = spark.createDataFrame([(i, t, "w", "k", 1, "s") for i, t in docs], SCHEMA)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, it).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.item_ids, x.contaminated) for x in got), key=str) == brute_decontaminate(docs, items)
    for x in got:
        assert sum(s["end"] - s["start"] for s in x.hit_spans) == x.n_hit
    kept = decontaminate.remove_contaminated(df, it)
    bad = {x.doc_id for x in got if x.contaminated}
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - bad


def test_decontaminate_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b", "", "", 1, "")], SCHEMA)
    assert [(r.n_words, r.contaminated) for r in decontaminate.decontaminate(df, none).collect()] == [(2, False)]
    assert decontaminate.decontaminate(df.limit(0), none).collect() == []


@pytest.mark.parametrize("n", [0, 5, 16, 333])
def test_shards_differ_by_one_row_and_slots_have_no_gaps(spark, n):
    rows = [(i if i % 50 else None, None if i % 7 == 0 else f"é{i % 9}", "", "", 1, "") for i in range(n)] + [(3, "same", "", "", 1, "")] * (2 if n else 0)
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = Counter(r.shard for r in got)
    assert not got or max(by.values()) - min([*by.values(), *([0] * (16 - len(by)))]) <= 1
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    assert all(0 <= r.shard < 16 and r.law == "rows" and r.grown_shard is None for r in got)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_a_new_shard_moves_few_rows(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    a = {r.doc_id: r.shard for r in sharding.shard_documents(df, 16).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_documents(df, 17).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.6 * len(a)  # dealing anew would move 94 %


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
    again = {q for p in range(len(w) - 4) if grams[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again)


def test_quality_counts_equal_brute_force(spark):
    r = random.Random(9)
    texts = [None, "", " \n\t", "é ü 漢字 a|b <x>", "a b c d e a b c d e", "x\nx\n x\nx \n\nx"] + ["\n".join(" ".join(r.choices(["ab", "c#", "né", "d"], k=r.randint(0, 9))) for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = [(i, t, None if i % 5 == 0 else "en", f"s{i % 2}" if i % 3 else None, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bucket long")
    got = {x.doc_id: x for x in quality.quality_rules(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x, want = got[i], brute_quality(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, t
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (x.base_failed and x.kept)
    assert quality.quality_rules(df.limit(0)).collect() == []


def test_sketches_merge_like_one(spark):
    df = spark.range(2000).selectExpr("'en' AS lang", "'s' AS source", "id % 50 + 10 AS n_words", "(id % 50 + 10) * (3 + id % 4) AS word_chars", "0 AS n_symbols", "0 AS n_dup_lines", "1 AS n_lines", "0 AS n_repeat_words")
    q = {r.metric: r for r in quality.quantiles(quality.sketch(df, ["lang", "source"]), ["lang", "source"]).collect()}["word_chars_mean"]
    assert q.total == 2000 and abs(q.mid - 4) < 0.15 and abs(q.low - 3) < 0.15 and abs(q.high - 6) < 0.25


def toxic_table(n):
    r = random.Random(6)
    common, bad = [f"word{i}" for i in range(200)], ["vileone", "viletwo", "grossly", "grosser"]
    docs, labels = [], []
    for i in range(n):
        t = r.choices(common, k=30) + [f"rare{r.randrange(9999)}"]
        toxic = i % 8 == 0
        if toxic:
            t[3] = t[17] = r.choice(bad) + r.choice(["", "s", "ish"])
        docs.append((i, " ".join(t), "w", "k", 1, "s"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_finds_held_out_rows_and_never_reads_labels_of_them(spark):
    docs, labels = toxic_table(1200)
    docs += [(5000, None, "", "", 1, ""), (5001, "", "", "", 1, ""), (None, "word1 vileone", "", "", 1, ""), (1, docs[1][1], "", "", 1, "")]
    df, ld = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, ld).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1200 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    right = sum((r.predicted == 1) == (r.doc_id % 8 == 0) for r in held) / len(held)
    assert right >= 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    flipped = spark.createDataFrame([(i, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(df, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in held)


def test_toxicity_finds_short_and_fully_toxic_texts(spark):
    docs, labels = toxic_table(1200)
    bad = ["vileone", "viletwo", "grossly", "grosser", "vileones"]
    full = {6000 + n: " ".join(bad[:n]) for n in range(1, 6)} | {6010 + n: f"word{n} " + " ".join(bad[:2]) for n in range(3)}
    clean = {6020 + n: " ".join(f"word{i}" for i in range(n)) for n in range(1, 6)}
    df = spark.createDataFrame([*docs, *((i, t, "", "", 1, "") for i, t in [*full.items(), *clean.items()])], SCHEMA)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [i for i in full if got[i].predicted != 1] == [] and [i for i in clean if got[i].predicted] == []
    # words of the ordinary class count against: the same toxic word among more of them scores less
    assert got[6010].llr < got[6002].llr and got[6001].llr > 0 > got[6021].llr - 0.05


def test_toxicity_centres_a_rare_language_on_the_corpus(spark):
    docs, labels = toxic_table(1200)
    rows = [(i, t, "en") for i, t, *_ in docs] + [(7000, "vileone viletwo grossly", "xx"), (7001, "word1 word2 word3", "xx"), (7002, "vileone viletwo", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert (got[7000], got[7001], got[7002]) == (1, 0, 1)


def test_toxicity_without_labels_scores_zero(spark):
    df = spark.createDataFrame([(1, "a b c", "", "", 1, "")], SCHEMA)
    assert [r.score for r in toxicity.score_toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()] == [0.0]


def test_language_evidence_and_priors(spark):
    r = random.Random(2)
    vocab = {"en": ["the", "thing", "with", "that", "other"], "fr": ["éleau", "les", "étreaux", "dans", "quoi"]}
    docs = spark.createDataFrame([(i, " ".join(r.choices(vocab[lang], k=30)), lang) for i, lang in enumerate(["en", "fr"] * 60)], "doc_id long, text string, lang string")
    names, model = language_id.train(docs)
    assert names == ["en", "fr"]
    page = lambda lang, said: f'<html lang="{said}"><script>the the the</script><p>{" ".join(r.choices(vocab[lang], k=40))}</p></html>'
    rows = [(i, f"http://www.host{i % 3}.example.{'fr' if i % 2 else 'com'}/x/{i}", page("fr" if i % 2 else "en", "fr" if i % 2 else "en"), 1) for i in range(60)]
    rows += [(100, "http://host1.example.fr/fr/9", "", 1), (101, None, None, 1), (102, "not a url", page("fr", "en"), 1), (103, "http://h.fr", '<html lang=fr></html>', 1)]
    got = {x.page_id: x for x in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string, domain long"), names, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == ("fr" if i % 2 else "en") for i in range(60))
    assert got[100].lang == "fr" and got[103].lang == "fr" and got[102].lang == "fr" and got[101].lang in names
    assert all(0 < x.posterior <= 1 for x in got.values())


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    docs, labels = toxic_table(300)
    clean = [(i, t) for i, t, *_ in docs]
    bench = " ".join(f"bench{i}" for i in range(12))
    clean += [(900, clean[1][1] + " tail"), (901, clean[3][1] + " " + bench), (902, None), (903, "")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in clean], "doc_id long, text string, lang string, source string, n_chars long, label string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, "81")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = spark.read.parquet(f"{d}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        columns = rows.columns
        from corpusloom.llm.store import save

        rows = save(stage(spark, rows, d))
        ids.append({r.doc_id for r in rows.select("doc_id").collect()})
        assert name == "sentencepiece" or rows.columns == columns
    toxic = {i for i, t in labels if t}
    assert not toxic & ids[0] and len(ids[0]) >= 0.98 * (len(clean) - len(toxic))
    assert 900 not in ids[1] and 1 in ids[1] and 901 not in ids[3] and {902, 903} <= ids[4]
    assert rows.columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline_judges_short_items_but_not_bare_numbers_and_words(spark, tmp_path):
    import corpus_pipeline

    items = [(1, "Which river crosses Quito twice?"), (2, "81"), (3, "3.14"), (4, "word"), (5, "two words"), (6, " ".join(map(str, range(10))))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["So: which river crosses Quito, twice a day", "which river crosses Quito", "81 and 3.14 and a word", "in two words", "x 0 1 2 3 4 5 6 7 8 9", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [1, 2, 5, 6]


def test_checksum_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
