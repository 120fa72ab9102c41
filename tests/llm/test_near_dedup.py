"""The pipeline's near-dedup stage leaves no pair of five-word similarity 0.8."""

import random
from itertools import combinations

import corpus_pipeline as p
import pytest

from startline.llm import shingle_similarity


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return bool(a) and len(a & b) >= 0.8 * len(a | b)


def test_no_similar_pair_stays(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stage = dict(p.STAGES)["SimHash near-dedup"]
    kept = {r["doc_id"]: shingles(r["text"]) for r in stage(spark, docs, data).collect()}
    assert not [(a, b) for a, b in combinations(kept, 2) if similar(kept[a], kept[b])]
    every = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    simhash = {r["doc_id"]["doc_id"] for r in p.stay_by_simhash(docs.withColumn("key", p.row_key(docs)), "key").collect()}
    assert simhash - set(kept) == {177}  # similarity 0.83 to document 1, nine bits away
    assert similar(every[1], every[177])


def test_links_at_and_under_the_similarity(spark):
    words = [f"w{n}" for n in range(94)]  # 90 shingles
    at = words[:82] + [f"x{n}" for n in range(2)]  # 78 shared, 80 own, 92 in all: 0.848
    under = words[:60] + [f"y{n}" for n in range(34)]  # 56 of 124
    rows = [(1, " ".join(words)), (2, " ".join(at).upper()), (3, " ".join(under)), (4, ""), (5, None), (6, "one two"), (7, "One  two"), (8, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in shingle_similarity.similar_rows(docs).collect()} == {2, 7}
    among = docs.where("doc_id <> 1").select("doc_id")
    assert {r["doc_id"] for r in shingle_similarity.similar_rows(docs.union(docs.where("doc_id = 1")), among=among).collect()} == {7}


@pytest.mark.parametrize("chunk", [256, 3])
def test_components_equal_all_pairs(spark, chunk):
    """Chains, a large group and rows between 0.6 and 0.9 of each other, in chunks of any size."""
    rnd = random.Random(11)
    rows = []
    for n in range(60):
        base = [f"b{n % 6}-{k}" for k in range(60)]
        for _ in range(rnd.randrange(4)):  # a changed word breaks five of 56 shingles
            base[rnd.randrange(60)] = f"x{rnd.random()}"
        rows.append((n, " ".join(base)))
    chain = [f"c{k}" for k in range(80)]
    for n in range(100, 112):
        rows.append((n, " ".join(chain[3 * (n - 100) : 3 * (n - 100) + 44])))
    rows += [(200 + n, f"one two {n % 2}") for n in range(5)] + [(300, None), (301, ""), (302, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["node"]: r["root"] for r in shingle_similarity.similar_components(docs, chunk=chunk).collect()}
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if similar(sets[a], sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {d: got.get(d, d) for d in sets} == {d: find(d) for d in sets}
    assert len(set(root.values())) < len(root)
