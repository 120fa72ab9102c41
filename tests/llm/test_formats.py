"""Round trips, damaged files, held-out accuracy and the pipeline."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from startline.llm import op02_warc as op2
from startline.llm import op05_decontaminate as op5
from startline.llm import op09_token_ids as op9
from startline.llm import registry


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 7, 4096):
        for top in (1, 2, 50_257, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.integers(0, n, max(1, n // 50))] = (1 << 32) - 1
            assert (op9.decode_block(memoryview(op9.encode_block(ids))) == ids).all()


def test_files_round_trip_and_damage_is_seen():
    rng = np.random.default_rng(2)
    docs = [(n * 3 if n < 37 else None, rng.integers(0, 50_257, rng.integers(0, 9000)).astype("<u4")) for n in range(40)]
    out = io.BytesIO()
    assert op9.write_file(out, docs) == (40, sum(len(x) for _, x in docs), True)
    back = list(op9.read_file(out.getvalue()))
    assert all(a == c and (b == d).all() for (a, b), (c, d) in zip(docs, back, strict=True))
    broken = bytearray(out.getvalue())
    broken[100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(op9.read_file(bytes(broken)))
    with pytest.raises(ValueError, match="version"):
        list(op9.read_file(b"other" + bytes(40)))


def odd_texts(rnd, n):
    parts = ["a", "B", " ", "\n", "'s", ",", "1", "é", "\U0001f642", "\t", "  ", "日本", "word. ", "'", "'ll", "…", "½", "\r\n", "\u0301", "<|", "<|endoftext|>", "|>", "\xa0", "\x0b", "\x1f", "\u200b"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("as_text", [False, True])
def test_encoder_equals_the_library(as_text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(op9.default_tokenizer())
    plain.encode_special_tokens = as_text
    e = op9.Encoder(op9.default_tokenizer(), as_text, remembered=20_000)  # so little that most is forgotten
    texts = ["", " ", "  a", "a  b", "a\n b", "it's  'll", "　 x", "x\x1c y", " lead", "trail ", "a\x85 b", "Don't stop, now!", "\n\n\na", "x\n", "<|endoftext|>", "a<|endoftext|> b"]
    texts += odd_texts(random.Random(1), 3000)
    for at in (0, 0, 1000):  # again, remembered, and as a slice
        some = texts[at:]
        for ids, text in zip(e.encode(pa.array(texts).slice(at)), some, strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert plain.encode("<|endoftext|>", add_special_tokens=False).ids == [50256] or as_text


def test_long_texts_are_cut_in_segments(monkeypatch):
    monkeypatch.setattr(op9, "SEGMENT", 100)
    e = op9.Encoder(op9.default_tokenizer())
    texts = [" ".join(f"w{n % 77}," for n in range(400)), "x" * 1000, "", "a b"]
    for ids, text in zip(e.encode(pa.array(texts)), texts, strict=True):
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_query(spark, duck, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op9.default_tokenizer())
    got = {r["doc_id"]: tuple(r)[1:4] for r in registry.queries()["op9_token_ids"](spark, data).collect()}
    start = 0
    for d, text in duck.sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_roll_and_hold_every_row(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 5, 5, n]), t) for n, t in enumerate(odd_texts(rnd, 400))] + [(7, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"file://{tmp_path}/t"
    manifest = op9.write_token_files(docs, folder, op9.default_tokenizer(), files=2, file_bytes=2000)
    files = sorted((r["name"], r["docs"], r["ids"]) for r in manifest.collect())
    assert len(files) > 2 and sum(n for _, n, _ in files) == len(rows)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in op9.read_token_files(spark, folder, manifest).collect())
    ids = [r[1] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is None, x or 0))
    assert [r[0] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    plain = op9.Encoder(op9.default_tokenizer()).tokenizer
    want = sorted((str(d), np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t in rows)
    assert sorted((str(d), raw) for _, d, _, raw in got) == want


def archive(*records, words=b""):
    import struct

    import zstandard

    tool = zstandard.ZstdCompressor(write_checksum=True)
    return struct.pack("<II", op2.DICTIONARY_MAGIC, len(words)) + words + b"".join(tool.compress(r) for r in records)


def test_archives_are_validated():
    good = op2.page_record(7, b"https://a/b", b"<p>hi</p>", 7)
    data = archive(good, op2.page_record(5, None, b"<p>hi</p>", 7))
    pages = [op2.parse_page(*op2.parse_record(r)) for r in op2.frames(io.BytesIO(data))]
    assert [(p["page_id"], p["record_type"], p["refers_to"], p["payload_bytes"]) for p in pages] == [(7, "response", None, 9), (5, "revisit", 7, 9)]
    assert pages[0]["payload_digest"] == pages[1]["payload_digest"] == op2.digest_of(b"<p>hi</p>")
    for bad, why in ((data[4:], "not a Zstandard frame"), (data[:6], "cut short"), (data[:-9], "cut short"), (data[:8] + b"junk" + data[8:], "not a Zstandard frame"), (b"", "empty"), (data[:-3] + b"\0" + data[-2:], "decode")):
        with pytest.raises(op2.WarcError, match=why):
            list(op2.frames(io.BytesIO(bad)))
    for bad, why in ((good.replace(b"WARC/1.1", b"HTTP/1.1"), "version"), (good[:-1], "length"), (good.replace(b"hi", b"ho"), "digest"), (good.replace(b"WARC-Date", b"X"), "missing"), (good.replace(b"WARC-Date:", b"WARC-Date"), "header")):
        with pytest.raises(op2.WarcError, match=why):
            op2.parse_record(bad)


def foreign(kind, headers, block):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *headers, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def test_archives_of_others_are_read(spark, tmp_path):
    import struct

    import zstandard

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    records = [
        foreign("warcinfo", [], b"software: other\r\n"),
        foreign("request", ["WARC-Target-URI: https://a/"], b"GET / HTTP/1.1\r\n\r\n"),
        foreign("response", ["WARC-Target-URI: https://a/"], http + b"no length, no digest"),
        foreign("response", ["WARC-Payload-Digest: sha256:abc"], http + "é".encode() * 300_000),
        foreign("response", ["WARC-Payload-Digest: sha1:OTHER"], chunked),
        foreign("revisit", ["WARC-Profile: x", "WARC-Refers-To-Target-URI: https://a/"], http),
        foreign("response", [], b"a DNS answer"),
    ]
    words = zstandard.ZstdCompressor(write_content_size=False).compress(b"Server: WARC-Type: response " * 20)
    table = zstandard.ZstdCompressionDict(b"Server: WARC-Type: response " * 20)
    tool = zstandard.ZstdCompressor(dict_data=table, write_content_size=False)  # frames that do not state their size
    skipped = struct.pack("<II", 0x184D2A50, 5) + b"index"
    (tmp_path / "a.warc.zst").write_bytes(struct.pack("<II", op2.DICTIONARY_MAGIC, len(words)) + words + b"".join(tool.compress(r) for r in records) + skipped)
    plain = zstandard.ZstdCompressor(write_content_size=False)
    (tmp_path / "b.warc.zst").write_bytes(b"".join(plain.compress(r) for r in records))  # without a dictionary
    for files in (("a",), ("a", "b")):
        if len(files) == 1:
            got = [op2.parse_page(*op2.parse_record(r)) for r in op2.frames(io.BytesIO((tmp_path / "a.warc.zst").read_bytes()))]
            assert [bool(p) for p in got] == [False, False, True, True, True, True, False]
            assert got[2]["payload_digest"] == op2.digest_of(b"no length, no digest") and got[2]["page_id"] is None
            assert (got[5]["record_type"], got[5]["payload_bytes"], got[5]["payload_digest"], got[5]["refers_to"]) == ("revisit", None, None, None)
        else:
            rows = op2.read_warc(spark, f"file://{tmp_path}").collect()
            assert sorted(r["payload_bytes"] or -1 for r in rows) == [-1, -1, 13, 13, 20, 20, 600_000, 600_000]


def test_archives_roll(spark, tmp_path):
    pages = spark.createDataFrame([(n, None, f"<p>{n}</p>" * 200) for n in range(60)], "page_id long, url string, html string").coalesce(1)
    files = op2.write_warc(pages, f"file://{tmp_path}/w", file_bytes=2000).collect()
    assert len(files) > 4 and sum(r["records"] for r in files) == 60
    assert sorted(r["page_id"] for r in op2.read_warc(spark, f"file://{tmp_path}/w").collect()) == list(range(60))
    left = next((tmp_path / "w").glob("*.warc.zst"))  # as a lost attempt leaves one, whole or cut short
    (tmp_path / "w" / "pages-000000-999-000000.warc.zst").write_bytes(left.read_bytes())
    (tmp_path / "w" / "pages-000001-998-000000.warc.zst").write_bytes(left.read_bytes()[:-9])
    assert op2.read_warc(spark, f"file://{tmp_path}/w").count() == 60
    assert op2.write_warc(pages.limit(7), f"file://{tmp_path}/w").agg({"records": "sum"}).first()[0] == 7
    assert op2.read_warc(spark, f"file://{tmp_path}/w").count() == 7
    for name in (r["name"] for r in spark.read.parquet(f"file://{tmp_path}/w/_manifest").collect()):
        (tmp_path / "w" / name).unlink()
    with pytest.raises(Exception, match="missing"):
        op2.read_warc(spark, f"file://{tmp_path}/w").collect()


def test_spans_point_into_the_original():
    windows = op5.item_windows([("1", "One two THREE".encode()), ("2", b"x")], 10)
    ranges, items = op5.scan(op5.words_of("zero, ONE-two three! x".encode()), [op5.automaton(windows)])
    assert op5.merged(ranges) == [[1, 5]] and items == {"1", "2"}


def test_blocks_of_items_find_the_same(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, op5.decontaminate(docs, bench).collect()))
    assert whole == sorted(map(str, op5.decontaminate(docs.limit(10**6), bench, block_bytes=100_000).collect()))


def test_language_accuracy(spark, data):
    data = data.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    rows = registry.queries()["op8_language_id"](spark, data).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.96 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_accuracy(spark, data):
    data = data.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = registry.queries()["op7_toxicity"](spark, data).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert better > 0.75
