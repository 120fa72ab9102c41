"""Operators against plain versions of what they promise."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from conftest import same
from pyspark.sql import functions as F

from startline.llm import op01_substring_dedup as op1
from startline.llm import op03_hmm as op3
from startline.llm import op06_mixture as op6
from startline.llm import op07_toxicity as op7
from startline.llm import op10_simhash as op10
from startline.llm import registry

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def documents(duck):
    return duck.sql("SELECT doc_id, text, lang, source FROM documents ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, duck, data, name):
    same(registry.queries()[name](spark, data).toPandas(), duck.sql(registry.oracle_sql()[name]).df())


def repeats(docs, window):
    first = {}
    for d, text in docs:
        w = SPACES.findall(text or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, text in docs:
        w = SPACES.findall(text or "")
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def test_substring_dedup_of_random_texts(spark, monkeypatch):
    rnd = random.Random(3)
    docs = [(d, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(40)))) for d in rnd.sample(range(-500, 500), 150)]
    docs += [(900, docs[0][1]), (-900, docs[1][1]), (901, "é ü x " * 9)]
    for batch in (50, 2_000_000):  # settled in many small batches, then all together
        monkeypatch.setattr(op1, "BATCH_WINDOWS", batch)
        found = op1.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), window=6)
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect())
        assert got == repeats(docs, 6)


def test_substring_dedup_tells_regular_words_and_windows_apart(spark):
    """Thue-Morse strings and their complements collide under polynomials modulo 2^64 of any odd base."""
    word = "".join("ab"[n.bit_count() % 2] for n in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(d, " ".join([*(f"x{n}" for n in range(30)), w, *(f"y{n}" for n in range(19))])) for d, w in ((1, word), (2, other), (3, word))]
    rows += [(4, " ".join(word[:50])), (5, " ".join(other[:50])), (6, " ".join(word[:60])), (7, " ".join(other[:60]))]
    found = op1.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()) == repeats(rows, 50)
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()}[2] == 0


def test_substring_dedup_over_many_ranges(spark):
    rnd = random.Random(5)
    docs = [(d, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(60)))) for d in range(200)]
    found = op1.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), window=7, range_bytes=500)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()) == repeats(docs, 7)


def test_prefix_sum_hashes_are_rabin_karp():
    values = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    got = op1.span_hashes(values, np.arange(290), np.arange(290) + 10, op1.Powers(base))
    want = [sum(int(v) * pow(base, n, 1 << 64) for n, v in enumerate(values[i : i + 10])) % (1 << 64) for i in range(290)]
    assert got.tolist() == want


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(2)
    start, step, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3)
    model = op3.Hmm(start, step, emit)
    seqs = [np.array(s) for s in ([0, 1, 2, 3, 1], [2, 2, 0], [3])]
    got = op3.forward(model, seqs)
    for s, x in zip(seqs, got, strict=True):
        total = sum(start[p[0]] * math.prod(step[a, b] for a, b in zip(p, p[1:], strict=False)) * math.prod(emit[q, o] for q, o in zip(p, s, strict=True)) for p in itertools.product(range(3), repeat=len(s)))
        assert math.isclose(math.exp(x), total)


def test_expected_counts_and_rising_likelihood():
    rng = np.random.default_rng(5)
    model = op3.Hmm(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(5), 2))
    seqs = sorted((rng.integers(0, 5, n) for n in (9, 6, 6, 1)), key=lambda s: -len(s))
    last = -math.inf
    for _ in range(5):
        sums = [np.zeros(2), np.zeros((2, 2)), np.zeros((2, 5))]
        now = op3.expected(model, seqs, sums)
        assert math.isclose(sums[0].sum(), 4) and math.isclose(sums[1].sum(), 18) and math.isclose(sums[2].sum(), 22)
        assert now >= last - 1e-9
        last, model = now, op3.Hmm(sums[0] / 4, sums[1] / sums[1].sum(axis=1, keepdims=True), sums[2] / sums[2].sum(axis=1, keepdims=True))


def test_language_model_counts_and_gain(spark, duck, data):
    got = {r["doc_id"]: r for r in registry.queries()["op3_hmm_score"](spark, data).collect()}
    tokens = {d: (t or "").encode().lower().split() + [b""] for d, t, *_ in documents(duck)}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    count: dict = {}
    for d, w in tokens.items():
        if not held[d]:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for d, w in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(x in count for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    rows = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_scores_against_plain_baum_welch(spark):
    """The whole operator against sums over states in plain Python: training, classes of unseen words, scores."""
    rnd = random.Random(12)
    docs = [(d, " ".join(rnd.choice(["red", "Blue", "green", "one", "two"][: 3 + 2 * (d % 2)]) for _ in range(rnd.randrange(9)))) for d in range(60)]
    docs = [(d, t + " unseen" * (zlib.crc32(str(d).encode()) % 10 == 0)) for d, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in op3.score_documents(df, states=3, rounds=2).collect()}

    tokens = {d: t.encode().lower().split() + [b""] for d, t in docs}
    held = {d for d in tokens if zlib.crc32(str(d).encode()) % 10 == 0}
    count: dict = {}
    for d in set(tokens) - held:
        for w in tokens[d]:
            count[w] = count.get(w, 0) + 1
    own = sorted(count, key=lambda w: (w != b"", -count[w], w))
    symbol = {w: n for n, w in enumerate(own)}
    unigram = np.array([count[w] + 0.1 for w in own] + [0.1] * op3.CLASSES)
    unigram /= unigram.sum()
    rows = df.withColumn("held_out", F.col("doc_id").isin(*held))
    counts = op3.count_words(rows.where("NOT held_out"))
    train = op3.encode(rows, op3.learn_vocabulary(counts)).where("NOT held_out")
    n = len(tokens) - len(held)
    model = op3.first_model(op3.first_sample(train, n), len(unigram), unigram, 3)
    start, step, emit = model.start, model.step, model.emit
    seqs = {d: [symbol.get(w, len(own) + zlib.crc32(w[-3:]) % op3.CLASSES) for w in tokens[d]] for d in tokens}

    def ahead(s):
        alpha = [start * emit[:, s[0]]]
        for o in s[1:]:
            alpha.append((alpha[-1] @ step) * emit[:, o])
        return alpha

    for _ in range(2):
        sums = [np.zeros(3), np.zeros((3, 3)), np.zeros_like(emit)]
        for s in (seqs[d] for d in tokens if d not in held):
            alpha, beta = ahead(s), [np.ones(3)]
            for o in reversed(s[1:]):
                beta.insert(0, step @ (emit[:, o] * beta[0]))
            whole = alpha[-1].sum()
            for t, o in enumerate(s):
                at = alpha[t] * beta[t] / whole
                sums[2][:, o] += at
                if t == 0:
                    sums[0] += at
                else:
                    sums[1] += alpha[t - 1][:, None] * step * (emit[:, o] * beta[t])[None, :] / whole
        start = (sums[0] + 0.1) / (sums[0].sum() + 0.3)
        step = (sums[1] + 0.1) / (sums[1].sum(axis=1, keepdims=True) + 0.3)
        emit = (sums[2] + op3.DRAWN * unigram) / (sums[2].sum(axis=1, keepdims=True) + op3.DRAWN)
    for d, s in seqs.items():
        assert math.isclose(got[d], math.log10(ahead(s)[-1].sum()), rel_tol=1e-9), d  # an unseen word is all of its class
    again = {r["doc_id"]: r["score"] for r in op3.score_documents(df.repartition(5, "text"), states=3, rounds=2).collect()}
    assert all(math.isclose(got[d], again[d], rel_tol=1e-9) for d in got)  # however the rows lie


def test_exact_dedup_spreads_a_hot_group(spark):
    from startline.llm import op04_exact_dedup as op4

    docs = spark.createDataFrame([(n, "a  b" if n % 3 else f"t {n}") for n in range(3000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in op4.exact_dedup(docs).collect()}
    assert all(r["keep_id"] == (1 if d % 3 else d) for d, r in got.items())
    assert got[2]["group_size"] == 2000 and got[2]["text_sha256"] == hashlib.sha256(b"a b").hexdigest()


def test_exact_dedup_merges_sorted_runs(spark):
    from startline.llm import op04_exact_dedup as op4

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = op4.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan and "Python" not in plan and "Arrow" not in plan


def level(sizes, weights, cap=3):
    """Targets by plain resharing."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        target = [cap * sizes[i] if i in capped else rest * weights[i] / w for i in range(len(sizes))]
        more = {i for i in range(len(sizes)) if i not in capped and target[i] > cap * sizes[i]}
        if not more:
            return target
        capped |= more


def test_mix_targets_and_totals(spark):
    rnd = random.Random(8)
    docs = [(n, " ".join("w" for _ in range(rnd.randrange(1, 60))), s) for n, s in enumerate(rnd.choices(["a", "B", "é", None, "tiny", "z"], [50, 20, 20, 5, 1, 4], k=800))]
    found = op6.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    again = op6.mix_sources(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string").repartition(5)).collect()
    assert {(r["doc_id"], r["taken"]) for r in found} == {(r["doc_id"], r["taken"]) for r in again}
    names = sorted({s for *_, s in docs if s}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len(t.split()) for _, t, s in docs if s == name) for name in names]
    want = level(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))])
    for name, size, target in zip(names, sizes, want, strict=True):
        own = [r for r in found if r["source"] == name]
        assert {r["source_size"] for r in own} == {size}
        assert all(math.isclose(r["target"], target) for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 1
        assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in own)


def test_fit_budget_is_the_best_sum_when_small():
    rnd = random.Random(1)
    for _ in range(40):
        lengths = rnd.sample(range(2, 30), 4)
        counts = [rnd.randrange(1, 4) for _ in lengths]
        budget = rnd.randrange(sum(n * c for n, c in zip(lengths, counts, strict=True)) + 1)
        taken = op6.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, taken, strict=True)) <= budget
        again = op6.fit_budget(lengths, counts, budget, extra=2)
        assert all(0 <= t <= 3 * c for t, c in zip(again, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, taken, strict=True)) <= sum(n * t for n, t in zip(lengths, again, strict=True)) <= budget
    assert op6.fit_budget([10, 7], [1, 1], 14) == [1, 0] and op6.fit_budget([10, 7], [1, 1], 14, extra=2) == [0, 2]
    assert op6.fit_budget([7, 5, 3], [1, 1, 1], 8) == op6.fit_budget([7, 5, 3], [1, 1, 1], 8, extra=2) == [0, 1, 1]
    assert sum(n * t for n, t in zip([10**5, 99_991, 3], op6.fit_budget([10**5, 99_991, 3], [900, 900, 50], 10**8), strict=True)) > 10**8 - 10**5


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(300):
        idx = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        vectors.append(op7.unit(idx, rng.integers(1, 4, len(idx)).astype(float), np.linspace(1, 5, 40)))
    index = op7.BlockMaxIndex(vectors, 40, block=16)
    dense = np.zeros((300, 40))
    for n, (idx, w) in enumerate(vectors):
        dense[n, idx] = w
    for n in range(0, 300, 7):
        ids, sims = index.nearest(*vectors[n], k=9, without=n)
        want = dense @ dense[n]
        want[n] = 0
        assert np.allclose(sims, np.sort(want)[::-1][: len(sims)], atol=1e-5)
        assert np.allclose(want[ids], sims, atol=1e-5)


def test_toxicity_against_plain_cosines(spark, duck, data):
    """The whole operator against terms, weights, all cosines and votes in plain Python."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in op7.toxicity(docs, labels).collect()}
    chosen = {r["doc_id"]: r["toxic"] for r in op7.sample_of(docs, labels, op7.EXAMPLES).collect()}
    plain_words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def terms(text):
        words = [w.encode() for w in plain_words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return [t for w in words for t in [w] + [w[:n] + b"*" for n in (4, 5, 6) if len(w) >= n]]

    own = {d: terms(t) for d, t, *_ in documents(duck)}
    n = [sum(v == c for v in chosen.values()) for c in (0, 1)]
    by = {}
    for t in {t for d in chosen for t in own[d]}:
        seen = [sum(t in own[d] for d, v in chosen.items() if v == c) for c in (0, 1)]
        share = sum(seen) / sum(n)
        ratio = sum(2 * x * math.log(x / (m * p)) for c in (0, 1) for x, m, p in ((seen[c], n[c], share), (n[c] - seen[c], n[c], 1 - share)) if x)
        if not t.endswith(b"*") or ratio >= 10:
            by[t] = max(0.001, ratio**2 / (ratio**2 + 64)) * (math.log((1 + len(own)) / (1 + sum(t in x for x in own.values()))) + 1)
    assert len(by) > 1000

    def vector(d):
        v = {t: (1 + math.log(own[d].count(t))) * by[t] for t in set(own[d]) & by.keys()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {d: vector(d) for d in own}
    with_terms = {d: c for d, c in chosen.items() if vectors[d]}
    whole = [sum(1 for d, t in duck.sql("SELECT doc_id, toxic FROM labels").fetchall() if zlib.crc32(str(d).encode()) % 5 and t == c) for c in (0, 1)]
    weight = [whole[c] / n[c] for c in (0, 1)]
    mean = weight[1] * n[1] / sum(weight[c] * n[c] for c in (0, 1))

    def vote(d, without=None):
        cosines = sorted(((sum(x * vectors[e].get(t, 0) for t, x in vectors[d].items()), e) for e in with_terms if e != without), reverse=True)[:15]
        cosines = [(x, e) for x, e in cosines if x > 1e-12]
        votes = sum(x * weight[with_terms[e]] for x, e in cosines)
        share = (sum(x * weight[1] for x, e in cosines if with_terms[e]) + 0.5 * mean) / (votes + 0.5)
        return math.log(share / (1 - share)), cosines

    examples = sorted(with_terms)
    a, b = op7.logistic(np.array([vote(d, d)[0] for d in examples]), np.array([with_terms[d] for d in examples]), np.array([weight[with_terms[d]] for d in examples]))
    compared = 0
    for d in sorted(own):
        x, cosines = vote(d)
        if not cosines:
            continue
        assert np.allclose(sorted(got[d]["cosines"]), sorted(x for x, _ in cosines), atol=1e-9)
        ends = [y for y, e in cosines if abs(y - cosines[-1][0]) < 1e-8]
        if len(ends) == 1 or len(cosines) < 15:  # else which of equal ones votes is the index's choice
            assert math.isclose(got[d]["score"], 1 / (1 + math.exp(-(a + b * x))), abs_tol=2e-3)
            compared += 1
    assert compared > 150
    assert all(got[d]["neighbours"] for d in own if vectors[d]) and len({r["score"] for r in got.values()}) > 100


def test_simhash_against_all_pairs(spark, duck, data):
    def bits(text):
        w = SPACES.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {d: bits(t) for d, t, *_ in documents(duck)}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.queries()["op10_simhash"](spark, data).collect()}
    assert got == {d: (f"{fp[d]:016x}", find(d)) for d in fp}


@pytest.mark.parametrize("meeting", [16384, 16])
def test_links_span_chains_and_hot_meetings(spark, meeting):
    rnd = random.Random(6)
    fps = {0}
    chain = 0
    for n in range(40):  # a chain whose ends are far apart
        chain ^= 0b1111 << ((4 * n) % 64)
        fps.add(chain)
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = op10.close_links(spark.createDataFrame(signed, "fp long"), meeting=meeting)
    found = {r["node"]: r["root"] for r in op10.components(links).collect()}
    label = {x: x for x in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            label[find(a)] = find(b)
    groups: dict = {}
    for x in fps:
        s = x - (1 << 64) if x >> 63 else x
        groups.setdefault(find(x), set()).add(found.get(s, s))
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == len(groups)
    if meeting > 1000:  # one meeting for each key: a spanning tree at most
        assert links.count() < 15 * len(fps)


def test_every_close_pair_shares_a_key():
    rnd = random.Random(9)
    masks = op10.block_masks(6, 4)
    assert len(masks) == 15
    for _ in range(500):
        a = rnd.getrandbits(64)
        b = a
        for _ in range(4):
            b ^= 1 << rnd.randrange(64)
        assert any(a & m == b & m for m in masks)
