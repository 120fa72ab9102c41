"""The filter audit against plain counts and removals one document at a time."""

import itertools
import random
import re

import numpy as np
from conftest import same
from pyspark.sql import functions as F

from startline.llm import op13_filter_audit as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    "", None, " \t\n\x0b\f\r ", "one", "One one ONE oNe", "é É ü" * 30, "a b  c", "x" * 5000 + " " + "x" * 5000, "# $ % & * |", "same same", "words " * 250,
    " ".join(f"W{n % 83}" for n in range(700)), "\x1f\x1c not spaces", "A" * 40 + " b" * 400, "tail space ", " head space",
]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text)))


def plain_audit(docs, labels, rules):
    names = "".join(rules)
    good, toxic = {d for d, q, t in labels if q == 1 and d is not None}, {d for d, q, t in labels if t == 1 and d is not None}
    fails = []
    for d, text, lang in docs:
        copy = d is not None and any(e is not None and e < d and (u or "") == (text or "") for e, u, _ in docs)
        fails.append((lang or "", {x for x, rule in rules.items() if rule(*plain(text), copy)}, d in good, d in toxic))
    rows = []
    for part in {f[0] for f in fails}:
        shapley = dict.fromkeys(names, 0)
        mine, own = [f for f in fails if f[0] == part], []
        for order in itertools.permutations(names):
            left = mine
            for step, x in enumerate(order, 1):
                out = [f for f in left if x in f[1]]
                gone = sum(x in f[1] for f in mine) - len(out)
                left = [f for f in left if x not in f[1]]
                shapley[x] += len(out)
                own.append((part, "".join(order), step, len(left), len(out), gone, sum(f[1] == {x} for f in mine), sum(f[2] for f in out), sum(f[3] for f in out), x))
        rows += [(*r[:-1], shapley[r[-1]]) for r in own]
    return sorted(rows)


RULES = {"A": lambda w, d, c, n, s, e: w < 200, "B": lambda w, d, c, n, s, e: 100 * d < 50 * w, "C": lambda w, d, c, n, s, e: 100 * c > 3 * n, "D": lambda w, d, c, n, s, e: s > 0, "E": lambda w, d, c, n, s, e: e}
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, None, 1), (None, 1, 1), (6, 1, 1), (9999, 1, 1), (11, 1, None)]


def columns(found):
    return sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found)


def test_awkward_documents(spark):
    docs = [(n, t, ("en", None, "fr")[n % 3]) for n, t in enumerate(AWKWARD)] + [(n + 100, t, "en") for n, t in enumerate(AWKWARD[::2])]
    docs += [(None, "one", "en"), (None, None, None), (3, "one", "en"), (3, "one", "en"), (2, "another text", "fr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).withColumns({c: F.lit("clash") for c in ("part", "mask", "n", "copy", "least", "digest", "n_words", "good", "toxic", "step", "at")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert columns(op.filter_audit(df, labels).collect()) == plain_audit(docs, LABELS, RULES)


def test_other_filters_and_no_rows(spark):
    docs = [(n, t, None) for n, t in enumerate(AWKWARD)]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rules = {"X": "n_points > 10", "Y": "nullif(copy, copy)", "Z": "n_words = 0"}
    got = op.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels, rules)
    assert columns(got.collect()) == plain_audit(docs, LABELS, {"X": lambda w, d, c, n, s, e: n > 10, "Y": lambda *_: False, "Z": lambda w, *_: w == 0})
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op.filter_audit(none, labels).collect() == []
    assert len(op.filter_audit(spark.createDataFrame([(None, None, None)] * 3, none.schema), labels.limit(0)).collect()) == 600


def test_counts_of_random_texts_in_small_scans(spark, monkeypatch):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(" \t\n\x0baAbB#é一") for _ in range(rnd.randrange(400))) for _ in range(60)] + AWKWARD
    for size in (64, 2 << 20):  # most texts go in parts, or many texts at once
        monkeypatch.setattr(op, "SCAN_BYTES", size)
        df = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, lang string")
        got = {r["doc_id"]: tuple(r[c] for c in op.COUNTS) for r in op.document_counts(df).collect()}
        assert got == {n: plain(t) for n, t in enumerate(texts)}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With one bit of hash nearly all words collide, and are counted by their bytes."""
    monkeypatch.setattr(op, "HASH_BITS", 1)
    text = b"a b c a b long longer longest a " * 3
    counts = op.scan(np.frombuffer(text, np.uint8), np.array([0, 10, len(text)]), op.byte_classes(), op.powers(op.BASE, 200), op.powers(op.BASE_INVERSE, 200))
    assert counts[1].tolist() == [len(set(text[:10].split())), len(set(text[10:].split()))]


def test_whole_query(spark, duck, data):
    same(op.op13_filter_audit(spark, data).toPandas(), duck.sql(op.SQL).df())
