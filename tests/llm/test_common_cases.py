"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from startline.llm import op01_substring_dedup as op1
from startline.llm import op02_warc as op2
from startline.llm import op03_hmm as op3
from startline.llm import op04_exact_dedup as op4
from startline.llm import op05_decontaminate as op5
from startline.llm import op06_mixture as op6
from startline.llm import op07_toxicity as op7
from startline.llm import op08_language_id as op8
from startline.llm import op09_token_ids as op9
from startline.llm import op10_simhash as op10

LONG = " ".join(f"w{n % 977}" for n in range(120_000))
ROWS = [
    (1, "the cat sat on the mat", "en", "a"), (2, "the cat sat on the mat", "en", "a"), (2, "the cat sat on the mat", "en", "a"), (3, None, None, None), (4, "", "en", None),
    (5, " \t\n", None, "b"), (None, "no number here", "en", "b"), (6, LONG, "en", "a"), (7, LONG + " end", "fr", "c"), (8, "1234 !!", "fr", "c"), (9, "x", "fr", "c"), (7, "other text, same number", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ("size", "salt", "digest", "fp", "row", "uid", "held_out", "idx", "lang_pred", "lang_rejected", "n_words", "mark", "bin", "word", "n", "toxic", "score")
BENCH = [(1, "the cat sat"), (None, "no number"), (2, None), (3, "!!")]
LABELS = [(1, 1, 1), (2, 0, 0), (2, 1, 1), (9, 1, 0), (None, 1, 1), (6, 1, None), (8, None, 0)]


def operators(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    return {
        "op1": op1.substring_dedup,
        "op3": lambda d: op3.score_documents(d, rounds=1, states=2),
        "op4": op4.exact_dedup,
        "op5": lambda d: op5.decontaminate(d, bench),
        "op6": op6.mix_sources,
        "op7": lambda d: op7.toxicity(d, labels),
        "op8": op8.language_id,
        "op9": lambda d: op9.token_ids(d, op9.default_tokenizer()),
        "op10": op10.simhash_components,
    }


NAMES = ("op1", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10")


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_and_clashing_columns(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs = docs.withColumns({c: F.lit("clash") for c in CLASHES})
    found = operators(spark)[name](docs).collect()
    assert len(found) == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_nulls(spark, name):
    found = operators(spark)[name](spark.createDataFrame([(None, None, None, None)] * 3, SCHEMA)).collect()
    assert len(found) == 3


def test_warc_cases(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, None, "same"), (3, "bad\nurl", None), (None, "v", "x"), (4, "w", ""), (2, "again", "same"), (5, "l", LONG)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("digest", "size", "salt", "response_id")})
    folder = f"file://{tmp_path}/a"
    op2.write_warc(pages, folder)
    got = op2.read_warc(spark, folder).collect()
    assert len(got) == 7
    by = {(r["page_id"], r["url"]): r for r in got}
    assert by[(1, "u")]["refers_to"] == 2 and by[(1, "u")]["payload"] is None
    assert by[(2, None)]["record_type"] == by[(2, "again")]["record_type"] == "response"
    assert by[(3, "bad%0Aurl")]["payload_bytes"] == 0 and by[(3, "bad%0Aurl")]["refers_to"] == 4
    assert bytes(by[(5, "l")]["payload"]).decode() == LONG
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert op2.write_warc(empty, f"file://{tmp_path}/b").isEmpty()
