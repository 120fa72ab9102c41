"""Language ID against a plain version of the same decisions."""

import random
import unicodedata
import zlib
from collections import Counter

import zstandard

from startline.llm import op08_language_id as op


def letters(text):
    """Lower-case letters, all else as single spaces."""
    kept = "".join(c if unicodedata.category(c)[0] == "L" or c.isalnum() and not c.isdigit() and not c.isdecimal() and not c.isnumeric() else " " for c in (text or "").lower())
    return " ".join(kept.split())


def plain_dictionaries(docs):
    counts = {}
    for d, text, lang in docs:
        if text is not None and lang is not None and (d is None or zlib.crc32(str(d).encode()) % 4 != 2):
            counts.setdefault(lang, Counter()).update(letters(text).split())
    out = {}
    for lang, c in counts.items():
        kept, size = [], 0
        for word, n in sorted(c.items(), key=lambda x: (-x[1], x[0].encode())):
            size += len(word.encode()) + 1
            if size > 32768:
                break
            kept.append((n, word))
        out[lang] = (" " + " ".join(w for _, w in sorted(kept)) + " ").encode() if kept else None
    return {k: v for k, v in out.items() if v}


def plain_prediction(text, dictionaries):
    body = letters(text).encode()
    if not body or not dictionaries:
        return "und", 0.0
    sizes = []
    for lang, data in dictionaries.items():
        size = 0
        for at in range(0, len(body), 2048):
            tool = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
            size += len(tool.compress(body[at : at + 2048]))
        sizes.append((size, lang))
    sizes.sort()
    return sizes[0][1], 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def test_whole_query_against_a_plain_version(spark, duck, data):
    docs = duck.sql("SELECT doc_id, text, lang FROM documents").fetchall()
    dictionaries = plain_dictionaries(docs)
    got = {r["doc_id"]: r for r in op.op8_language_id(spark, data).collect()}
    assert len(got) == len(docs) == 200
    for d, text, _ in docs:
        lang, score = plain_prediction(text, dictionaries)
        r = got[d]
        assert (r["lang_pred"], r["held_out"]) == (lang, zlib.crc32(str(d).encode()) % 4 == 2)
        assert abs(r["score"] - score) < 1e-12 and r["rejected"] == (lang == "und" or score < op.MARGIN)


def test_any_number_of_labels_is_learned(spark):
    rnd = random.Random(5)
    words = {n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for n in range(300)}
    docs = [(n * 10 + k, " ".join(rnd.choices(words[n], k=30)), f"l{n:03d}") for n in words for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    got = op.language_id(df).collect()
    assert {r["lang_pred"] for r in got} == {f"l{n:03d}" for n in range(300)}
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.99 * len(docs)
