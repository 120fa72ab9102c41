"""The n-gram Jaccard join against all pairs of sets of words."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from startline.llm import op11_ngram_join as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, shingle=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < shingle:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1))


def plain_components(docs, shingle=3, percent=90):
    """doc_id, size and smallest linked identifier of each row, from all pairs of rows."""
    sets = [plain_set(t, shingle) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for n, (d, _) in enumerate(docs):
        if d is not None:
            least[find(n)] = min(least.get(find(n), d), d)
    return sorted(((d, len(sets[n]), least.get(find(n))) for n, (d, _) in enumerate(docs)), key=str)


def found(df, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op.ngram_components(df, **options).collect()), key=str)


def near_copies(rnd, groups, most):
    """Texts in groups of copies with up to some words changed, of all similarities."""
    texts = []
    for _ in range(groups):
        words = [f"{rnd.choice('abcdefgh')}{rnd.randrange(90)}" for _ in range(rnd.choice([1, 2, 3, 4, 8, 40, 120]))]
        for _ in range(rnd.randrange(1, most)):
            own = list(words)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(50)}"
            texts.append(" ".join(own))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("chunk", "frequent", "percent", "shingle"), [(1024, 256, 90, 3), (4, 256, 90, 3), (3, 2, 80, 2), (1024, 2, 70, 1)])
def test_against_all_pairs(spark, monkeypatch, chunk, frequent, percent, shingle):
    """Whole and chunked meetings; with no shingle frequent, and with most of them."""
    monkeypatch.setattr(op, "CHUNK", chunk)
    monkeypatch.setattr(op, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(op, "FREQUENT_IN_BATCH", min(op.FREQUENT_IN_BATCH, frequent))
    rnd = random.Random(chunk + percent)
    texts = near_copies(rnd, 30, 14)
    docs = list(zip(rnd.sample(range(-2000, 2000), len(texts)), texts, strict=True))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain_components(docs, shingle, percent)
    assert len({w[2] for w in want}) < len(docs) - 20
    assert found(df, shingle=shingle, percent=percent) == want


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Copies that link in chains, beside others of the same text that link with none."""
    monkeypatch.setattr(op, "CHUNK", 30)
    rnd = random.Random(2)
    words = [f"w{n}" for n in range(100)]
    docs = []
    for d in range(260):
        own = list(words)
        for at in rnd.sample(range(100), rnd.choice([0, 1, 1, 2, 6, 9])):
            own[at] = f"v{d}"
        docs.append((d, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(df) == plain_components(docs)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(op, "SCAN_BYTES", 40_000)  # the long texts go in parts
    long = " ".join(f"w{n % 9973}" for n in range(30_000))
    docs = [
        (1, "a b c d"), (2, "A B\tc  d "), (2, "a b c d"), (3, None), (4, ""), (5, " \n"), (None, "a b c d"), (None, "only this null"), (None, "only this null"), (None, None), (6, "a"), (7, "A"), (8, "a b"), (9, "b a"),
        (10, long), (11, long + " end"), (12, long + " " + long), (7, "another text, same number"), (13, "\x1f not \x1c space"), (14, "a a a a a"), (15, "a a a"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("key", "n", "hot", "hub", "id", "salt", "token", "root", "least")})
    assert found(df) == plain_components(docs)
    assert found(df.limit(0)) == []
    assert found(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")) == [(None, 0, None)] * 3


def test_sets_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(op, "SCAN_BYTES", 7)
    rnd = random.Random(1)
    for n in range(60):
        text = "".join(rnd.choice("ab \t") for _ in range(n)).encode()
        assert op.long_set(text).tolist() == op.shingle_sets([text])[0].tolist()


def test_prefixes_of_linked_sets_share_the_smaller_l():
    rnd = random.Random(7)
    universe = np.array(sorted(rnd.getrandbits(64) for _ in range(400)), np.uint64)
    number = {int(t): rnd.choice([1, 2, 2, 3, 50]) for t in universe}
    hot = universe[::17]
    hot_numbers = np.full(len(hot), 300)
    limit = (1 << 64) // op.COUNTED

    def prefix(s):
        shared = np.array([t for t in s if t < limit and number[int(t)] > 1 and t not in hot], np.uint64)
        return op.prefix_of(s, shared, np.array([number[int(t)] for t in shared], np.uint32), hot, hot_numbers, 90)

    pairs, chosen = 0, set()
    for _ in range(3000):
        base = np.array(sorted(rnd.sample(universe.tolist(), rnd.randrange(1, 120))), np.uint64)
        other = np.unique(np.concatenate((base[[rnd.random() > 0.04 for _ in base]], np.array(rnd.sample(universe.tolist(), rnd.randrange(3)), np.uint64))))
        both = len(np.intersect1d(base, other))
        if not len(other) or 100 * both < 90 * (len(base) + len(other) - both):
            continue
        # a shingle that two sets hold has a number of 2 at least
        number |= {int(t): max(2, number[int(t)]) for t in np.intersect1d(base, other)}
        (p, l_p, _), (q, l_q, _) = prefix(base), prefix(other)
        assert len(np.intersect1d(p, q)) >= min(l_p, l_q)
        pairs, chosen = pairs + 1, chosen | {l_p, l_q}
    assert pairs > 500 and len(chosen) > 3


def test_common_counts_by_blocks():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 20_000, rng.integers(0, 9000)).astype(np.uint64)) for _ in range(9)]
    got = op.common_counts(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_whole_query(spark, duck, data):
    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op.op11_ngram_join(spark, data).collect()), key=str)
    assert got == plain_components(docs)
