"""Operators 4 and 5: archives and tokens."""

import hashlib
import itertools
import random
import struct
import time

import pytest

from corpusloom.llm import warc
from corpusloom.llm.sentencepiece_lattice import Fold, Pieces, decode, default_model, encode, encode_units

PAGES = "page_id long, url string, html string, digest string, d string"


def write(spark, rows, path, **options):
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), path, **options)


def test_archives_come_back_whole_and_false_records_do_not(spark, tmp_path):
    fake = "text\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n\r\n"
    big = "é" * 600
    rows = [(i, f"http://h/{i}", f"page {i}\n" + "x" * (i * 7) + (fake if i % 3 == 0 else "")) for i in range(40)]
    rows += [(50, None, None), (51, "http://a\r\nX: 1", ""), (60, "u", big), (61, "u", big), (62, "u", big), (None, "u", big), (63, "u", "short"), (64, "u", "short"), (70, "u", fake * 40), (71, "u", fake)]
    rows = [(*r, "clash", "clash") for r in rows]
    path = str(tmp_path / "w")
    write(spark, rows, path)
    got = warc.read_warc(spark, path, chunk_bytes=256, with_payload=True).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        body = html[r.page_id]
        assert r.payload_bytes == len(body)
        assert r.declared == "sha1:" + hashlib.sha1(body).hexdigest()
        same = [i for i, h in html.items() if h == body and i is not None]
        visit = len(body) >= 1000 and (r.page_id is None or r.page_id < max(same))
        assert r.record_type == ("revisit" if visit else "response")
        assert r.refers_to == (max(same) if visit else None)
        assert r.payload == (b"" if visit else body)
    assert warc.candidates(spark, path).where("page_id = 666").count() > 10
    assert warc.broken_files(warc.read_warc(spark, path)).count() == 0


def test_a_very_long_url_hides_no_records(spark, tmp_path):
    rows = [(i, "http://h/" + "u" * (70_000 if i in (3, 7) else 5), f"page {i}", "", "") for i in range(12)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(1), path)
    got = warc.read_whole(spark, path, chunk_bytes=4096).collect()
    assert sorted((r.page_id, r.url) for r in got) == [r[:2] for r in rows]


def test_a_chain_that_ends_early_fails(spark, tmp_path):
    path = str(tmp_path / "w")
    write(spark, [(i, "u", f"page {i}", "", "") for i in range(6)], path)
    assert warc.read_whole(spark, path).count() == 6
    (tmp_path / "w" / "cut.txt").write_bytes(b"no record at all\r\n\r\n")
    with pytest.raises(ValueError, match="cut.txt"):
        warc.read_whole(spark, path)


def test_empty_archives(spark, tmp_path):
    path = str(tmp_path / "w")
    write(spark, [], path)
    assert warc.read_warc(spark, path).collect() == []


def test_tokens_equal_the_library(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = [None, "", " ", "  a  b ", "Hello  wörld\nfoo ☃ x", "a<s>b <0x41>", "▁a", "ﬁ Å é", "a" * 40, "12 345\t\t6", "x" * 200 + " " + "日本語" * 20, "Hello  wörld\nfoo ☃ x"]
    texts += [("thing" * 12 + "xyzqxyzq")[:k] for k in range(56, 69)]  # around the length that fits into the bits of one integer
    df = spark.createDataFrame([(i if i else None, t, 1, "p") for i, t in enumerate(texts)], "doc_id long, text string, hash long, piece string")
    pieces = Pieces.load(default_model())
    got = decode(encode(df, pieces, decoded=True), pieces, out_col="again").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((i, t or "") for i, t in enumerate(texts))
    for r in got:
        want = m.encode(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == r.again == m.decode(want)
    assert encode(df.limit(0), pieces).collect() == []


def test_viterbi_fold_equals_brute_force(spark):
    table = {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -1.4, "aba": -3.0, "bb": -3.1, "abb": -2.2}
    pieces = Pieces(list(table), list(table.values()), [True] * len(table), -1, kind="unigram", unknown=99)
    units = ["".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)]
    df = spark.createDataFrame(list(enumerate(units)), "key long, unit string")
    got = {r.key: r.ids for r in encode_units(df, pieces).collect()}

    def best(u):
        if not u:
            return 0.0
        return max(s + best(u[len(p) :]) for p, s in table.items() if u.startswith(p))

    names = list(table)
    for i, u in enumerate(units):
        assert "".join(names[k] for k in got[i]) == u
        assert sum(table[names[k]] for k in got[i]) == pytest.approx(best(u))


def number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def field(key: int, value) -> bytes:
    if isinstance(value, float):
        return number(key << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return number(key << 3 | 2) + number(len(value)) + value
    return number(key << 3) + number(value)


def model_file(path, kind=1, byte_pieces=True, own=(), **normal) -> str:
    """A model file with stated pieces; kind 1 is unigram, 2 BPE, 4 characters."""
    scores = {"▁": -3.0, "a": -4.0, "b": -4.1, "c": -4.2, "d": -4.3, "é": -6.0, "ab": -4.9, "bc": -5.0, "abc": -6.5, "▁a": -4.6, "▁ab": -5.1, "cd": -5.3, "dd": -5.2, "da": -5.05, "abcd": -8.0, "éa": -7.5, "▁▁": -5.5}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_pieces]
    rows += [(t, s, 1) for t, s in scores.items()] + [(t, 0.0, 4) for t in own]
    body = b"".join(field(1, field(1, t.encode()) + field(2, s) + field(3, k)) for t, s, k in rows)
    body += field(2, field(3, kind) + field(4, len(rows)) + field(35, int(byte_pieces)))
    body += field(3, field(1, b"identity") + field(2, normal.get("charsmap", b"")) + field(3, 1) + field(4, normal.get("squeeze", 0)) + field(5, 1))
    path.write_bytes(body)
    return str(path)


def test_a_loaded_unigram_model_equals_the_library(spark, tmp_path):
    import sentencepiece

    path = model_file(tmp_path / "m")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    texts = ["".join(r.choices("aabbccdd é ", k=r.randint(1, 90))) for _ in range(60)]
    texts += [None, "", "  ab  cd ", "zq ☃a é", "abcd" * 300, "axbxc x", "éé☃é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Pieces.load(path).kind == "unigram" and Pieces.load(default_model()).kind == "bpe"
    got = {r.doc_id: r.ids for r in encode(df, path).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != m.encode(t or "")] == []


def test_the_lattice_and_the_fold_of_long_units_agree(spark, tmp_path):
    for pieces in (Pieces.load(model_file(tmp_path / "u")), Pieces.load(model_file(tmp_path / "b", kind=2)), Pieces.load(default_model())):
        r = random.Random(5)
        units = [" " * r.randint(0, 2) + "".join(r.choices("abcdé" if pieces.byte_base else "etaoins", k=r.randint(1, 30))) for _ in range(300)]
        got = {r.key: r.ids for r in encode_units(spark.createDataFrame(list(enumerate(units)), "key long, unit string"), pieces).collect()}
        fold = Fold(pieces)
        assert [u for i, u in enumerate(units) if got[i] is not None and got[i] != fold(u)] == []
        assert sum(v is not None for v in got.values()) > 250


def test_pieces_that_one_turn_comes_to_too_early(spark):
    assert {p.strip() for p in Pieces.load(default_model()).late} == {""}  # runs of spaces only
    # "abc" forms from "a" and "bc", which comes later than "abc" itself
    late = Pieces(["a", "b", "c", "d", "abc", "bc", "cd"], [0.0, -0.1, -0.2, -0.3, -1.0, -2.0, -1.5], [True] * 7, -1)
    assert late.late == {"abc"}
    units = ["abc", "abcabc", "bcd", "abcd", "aabc", "cdabc"]
    got = {r.key: r.ids for r in encode_units(spark.createDataFrame(list(enumerate(units)), "key long, unit string"), late).collect()}
    assert [got[i] for i in range(6)] == [[4], [4, 4], [1, 6], [0, 1, 6], [0, 4], [6, 4]] == [Fold(late)(u) for u in units]


def test_very_long_units_take_near_linear_time():
    import sentencepiece

    m, fold = sentencepiece.SentencePieceProcessor(model_file=default_model()), Fold(Pieces.load(default_model()))
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    began = time.monotonic()
    got = fold(" " + text)
    assert time.monotonic() - began < 20
    assert got == m.encode(text)
    assert fold(" " + "a" * 100_000) == m.encode("a" * 100_000)


def test_texts_with_long_units(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = ["x".join(["thequickbrownfox" * 400, "日本語" * 3000]), "a" * 20_000, "q" * 61]
    got = {r.doc_id: r for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), default_model()).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == m.encode(t)


def test_models_that_the_folds_do_not_fit_are_refused(tmp_path):
    for i, options in enumerate(({"kind": 4}, {"charsmap": b"x"}, {"squeeze": 1}, {"own": ("abc",)}, {"byte_pieces": False})):
        with pytest.raises((ValueError, RuntimeError)):
            Pieces.load(model_file(tmp_path / str(i), **options))
