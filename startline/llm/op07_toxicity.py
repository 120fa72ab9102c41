"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The classifier is fitted on a bounded sample of labelled documents, about SAMPLE of each class. Its terms are all words
of these, and those word beginnings that go with a label. A term's weight is (1 + log tf) times its idf, over all
documents, times its evidence: how far the likelihood ratio of the term and the labels, counted over the sample, lies
from chance. Evidence is a smooth factor and never 0, so every text that shares a word with an example has neighbours;
words that go with neither label just count little.

About EXAMPLES documents of each class are neighbours to be found. Their vectors are held in an inverted index: a
term's postings lie by block of examples, and each such run carries its largest weight. A query adds these up to a
bound for each block, visits blocks in the order of their bounds and stops once no block can hold a nearer example, so
its neighbours are exact. Their votes, weighted by similarity and by how thinly each class was sampled, are calibrated
by a logistic curve fitted on the examples, each judged without itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.llm.common import byte_values, coded_words, materialise, pieces, schema_of
from startline.llm.op05_decontaminate import FOLD, words_of
from startline.llm.op08_language_id import bounded_sample, remainder

SAMPLE, EXAMPLES, NEIGHBOURS, BLOCK, SEED = 3000, 1000, 15, 512, 7
BEGINNINGS = (4, 5, 6)
#: Likelihood-ratio statistic of a beginning that is a term; of a term that has half its weight; the least evidence.
BEGINNING_G2, HALF_G2, LEAST_EVIDENCE = 10.0, 8.0, 0.001
#: Words that a task remembers from one batch to the next.
KNOWN_WORDS = 200_000
SEPARATES = np.array([b == 32 for b in FOLD])
FOLDED = np.frombuffer(FOLD, np.uint8)


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings; a beginning ends with a star."""
    return [word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) >= n)]


def g2(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """Log-likelihood ratio of a term in a of n_a and b of n_b documents."""
    share = (a + b) / F.lit(float(n_a + n_b))
    part = lambda seen, n, p: F.when(seen > 0, seen * F.log(seen / (F.lit(float(n)) * p))).otherwise(F.lit(0.0))
    return 2 * (part(a, n_a, share) + part(n_a - a, n_a, 1 - share) + part(b, n_b, share) + part(n_b - b, n_b, 1 - share))


def evidence(ratio: np.ndarray) -> np.ndarray:
    """The factor, LEAST_EVIDENCE to 1, that a term's likelihood-ratio statistic gives it."""
    return np.maximum(LEAST_EVIDENCE, ratio**2 / (ratio**2 + HALF_G2**2))


def numbers_of(word: bytes, number: dict[bytes, int]) -> list[int]:
    """The numbers of those of terms_of() that have one."""
    own, size = number.get(word), len(word)
    found = [] if own is None else [own]
    for n in BEGINNINGS:
        if size < n:
            break
        own = number.get(word[:n] + b"*")
        if own is not None:
            found.append(own)
    return found


def vectors_of(texts: list[bytes], number: dict[bytes, int], known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together (known remembers words from call to call): how many terms each has, the terms' numbers and how often they occur."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, _, coded = coded_words(FOLDED[raw], SEPARATES[raw])
    found = []
    for w in coded.dictionary.to_pylist():
        own = known.get(w)
        if own is None:
            own = known[w] = numbers_of(w, number)
        found.append(own)
    if len(known) > KNOWN_WORDS:
        known.clear()
    sizes, flat = np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum([len(t) + 1 for t in texts])
    use = np.nonzero(sizes[codes] > 0)[0] if len(codes) else np.zeros(0, np.int64)
    text, codes = np.searchsorted(ends, starts[use], side="right"), codes[use]
    terms = ranges((np.cumsum(sizes) - sizes)[codes], sizes[codes])
    key, tf = np.unique(np.repeat(text, sizes[codes]) * max(1, len(number)) + flat[terms], return_counts=True)
    return np.bincount(key // max(1, len(number)), minlength=len(texts)), key % max(1, len(number)), tf


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges behind one another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Postings of unit vectors by term and block of examples, with each run's largest weight; nearest() is exact."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        self.n, self.blocks = len(vectors), max(1, -(-len(vectors) // block))
        doc = np.repeat(np.arange(self.n), [len(idx) for idx, _ in vectors])
        term = np.concatenate([idx for idx, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], weight[order]
        run = term[order] * self.blocks + self.doc // block
        self.start = np.nonzero(np.concatenate(([True], run[1:] != run[:-1])))[0] if len(run) else np.zeros(0, np.int64)
        self.length = np.diff(np.append(self.start, len(run)))
        self.block = run[self.start] % self.blocks
        self.most = np.maximum.reduceat(self.weight, self.start) if len(run) else np.zeros(0)
        self.of_term = np.searchsorted(run[self.start] // self.blocks, np.arange(terms + 1))

    def nearest(self, idx: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with a common term; equal cosines by position."""
        own = self.of_term[idx + 1] - self.of_term[idx]
        runs, by = ranges(self.of_term[idx], own), np.repeat(weight, own)
        bound = np.bincount(self.block[runs], by * self.most[runs], self.blocks)
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        place = np.empty(self.blocks, np.int64)
        place[order] = np.arange(len(order))
        turn = np.argsort(place[self.block[runs]], kind="stable")
        runs, by = runs[turn], by[turn]
        cuts = np.searchsorted(place[self.block[runs]], np.arange(len(order) + 1))
        ids, sims, at, group = np.zeros(0, np.int64), np.zeros(0), 0, 2
        while at < len(order):
            if len(sims) == k and bound[order[at]] < sims[-1] - 1e-9:
                break
            to = min(at + group, len(order))
            here = slice(cuts[at], cuts[to])
            postings = ranges(self.start[runs[here]], self.length[runs[here]])
            found = np.bincount(self.doc[postings], self.weight[postings] * np.repeat(by[here], self.length[runs[here]]))
            if 0 <= without < len(found):
                found[without] = 0.0
            new = np.nonzero(found > 1e-12)[0]
            ids, sims = np.concatenate((ids, new)), np.concatenate((sims, found[new]))
            best = np.lexsort((ids, -np.round(sims, 9)))[:k]
            ids, sims = ids[best], sims[best]
            at, group = to, group * 2
        return ids, sims


def unit(idx: np.ndarray, tf: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weight = (1 + np.log(tf)) * by[idx]
    norm = math.sqrt(float((weight * weight).sum()))
    return idx, weight / norm if norm else weight


class Model:
    """idf times evidence of each term, the index, labels, class weights, the prior of texts without terms, the curve."""

    def __init__(self, by, examples, weights):
        self.by, self.weights = by, weights
        own = [(e, unit(e[2], e[3], by)) for e in examples if len(e[2])]
        own.sort(key=lambda v: (v[1][0][np.argsort(-v[1][1], kind="stable")[:3]].tolist(), v[0][0]))  # of one strongest term side by side
        with_terms, vectors = [e for e, _ in own], [v for _, v in own]
        self.ids = np.array([e[0] for e in with_terms], np.int64)
        self.labels = np.array([e[1] for e in with_terms], np.int64)
        self.index = BlockMaxIndex(vectors, max(1, len(by)))
        rest = [weights[e[1]] * e[1] for e in examples if not len(e[2])]
        whole = sum(weights[e[1]] for e in examples if not len(e[2]))
        every = sum(weights[e[1]] for e in examples)
        mean = sum(weights[e[1]] * e[1] for e in examples) / every if every else 0.0
        self.prior = (sum(rest) + mean) / (whole + 1)
        self.mean, self.curve = mean, (0.0, 1.0)
        raw = [self.vote(*self.index.nearest(*v, without=n)) for n, v in enumerate(vectors)]
        self.curve = logistic(np.array(raw), self.labels, np.array([weights[x] for x in self.labels.tolist()])) if len(set(self.labels.tolist())) > 1 else (0.0, 1.0)

    def vote(self, ids, sims) -> float:
        """Log-odds of the weighted votes, drawn a little to the mean."""
        w = sims * np.array([self.weights[x] for x in self.labels[ids].tolist()]) if len(ids) else np.zeros(0)
        mean = min(max(self.mean, 1e-4), 1 - 1e-4)
        share = (float((w * self.labels[ids]).sum()) + 0.5 * mean) / (float(w.sum()) + 0.5) if len(ids) else mean
        return math.log(share / (1 - share))

    def score(self, idx, tf) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(idx) or not len(self.labels):
            return self.prior, np.zeros(0, np.int64), np.zeros(0)
        ids, sims = self.index.nearest(*unit(idx, tf, self.by))
        if not len(ids):
            return self.prior, ids, sims
        x = self.curve[0] + self.curve[1] * self.vote(ids, sims)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), ids, sims


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted Newton fit of y ~ a + b x with a slight pull to (0, 1); b stays positive."""
    a, b = 0.0, 1.0
    w = w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g0, g1 = float((w * (y - p)).sum()) - a, float((w * (y - p) * x).sum()) - (b - 1)
        v = w * p * (1 - p)
        h00, h01, h11 = float(v.sum()) + 1, float((v * x).sum()), float((v * x * x).sum()) + 1
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, max(0.05, b + db)
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def sample_of(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, toxic of about `sample` labelled documents of each class outside the held-out fifth."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return bounded_sample(known, "toxic", "doc_id", sample, SEED)


def terms_with_evidence(sampled: DataFrame) -> tuple[dict[bytes, int], np.ndarray]:
    """The sample's words and telling beginnings, numbered in order, and their likelihood ratios; from text, toxic."""

    def work(batches):
        for batch in pieces(batches, 4 << 20):
            term, toxic = [], []
            for text, label in zip(byte_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = {t for w in set(words_of(text)) for t in terms_of(w)}
                term += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.binary()), pa.array(toxic, pa.int32())], ["term", "toxic"])

    n = {r["toxic"]: r["n"] for r in sampled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return {}, np.zeros(0)
    counts = sampled.select("text", "toxic").mapInArrow(work, "term binary, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    ratios = counts.select("term", g2(F.col("a"), F.col("n") - F.col("a"), n[1], n[0]).alias("ratio"))
    star = F.endswith("term", F.lit("*").cast("binary"))
    found = ratios.where(~star | (F.col("ratio") >= BEGINNING_G2)).toArrow().sort_by("term")
    return {t: n for n, t in enumerate(found.column("term").to_pylist())}, found.column("ratio").to_numpy()


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, examples: int = EXAMPLES) -> DataFrame:
    """For every row doc_id, score (0 to 1), neighbours and cosines (the evidence).

    Labels come only from rows outside the held-out fifth; null labels and labels other than 0 and 1 teach nothing, of
    repeated labels the larger holds, and of rows that share a labelled identifier one teaches. Null and empty texts,
    and texts that share no word with the sample, score the share of toxic examples among such. Without examples of
    both classes every score is that share. Equal cosines are ranked by the index's order. An empty table gives an
    empty result. Other columns are not read. The sample bounds the terms: they are its distinct words, and its texts
    are held in tasks only.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = materialise(sample_of(rows, labels, sample), "toxic-sample")
    own = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sampled = materialise(own, "toxic-texts")
    number, ratios = terms_with_evidence(sampled)
    terms, sent = len(number), docs.sparkSession.sparkContext.broadcast(number)
    del number

    def count(batches):
        number, known = sent.value, {}
        df, total = np.zeros(len(number) + 1, np.int64), 0
        for batch in pieces(batches, 4 << 20):
            df += np.bincount(vectors_of([t or b"" for t in byte_values(batch.column(0))], number, known)[1], minlength=len(df))
            total += batch.num_rows
        own = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array([*own.tolist(), -1], pa.int32()), pa.array([*df[own].tolist(), total], pa.int64())], ["i", "df"])

    counted = rows.select("text").mapInArrow(count, "i int, df long").groupBy("i").agg(F.sum("df").alias("df")).toArrow()  # a row for each term
    df = np.zeros(terms + 1)  # the last, at -1, is the number of all texts
    df[counted.column("i").to_numpy()] = counted.column("df").to_numpy()
    by = (np.log((1 + df[-1]) / (1 + df[:terms])) + 1) * evidence(ratios)

    def vectors(batches):
        for batch in pieces(batches, 4 << 20):
            sizes, idx, tf = vectors_of([t or b"" for t in byte_values(batch.column(2))], sent.value, {})
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (idx, tf))], ["doc_id", "toxic", "idx", "tf"])

    few = sampled.join(F.broadcast(sample_of(rows, labels, examples)), ["doc_id", "toxic"]).select("doc_id", "toxic", "text")
    few = few.mapInArrow(vectors, schema_of(rows, "doc_id", "toxic int, idx array<int>, tf array<int>"))
    few = few.toArrow().combine_chunks()  # the examples
    arrays = [[x.values.to_numpy() for x in few.column(c)] for c in ("idx", "tf")]
    known_examples = [(d, t, i.astype(np.int64), f.astype(float)) for d, t, i, f in zip(few.column("doc_id").to_pylist(), few.column("toxic").to_pylist(), *arrays, strict=True)]
    n = {c: max(1, sum(1 for e in known_examples if e[1] == c)) for c in (0, 1)}
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(remainder("doc_id", 5) != 0)
    whole = {r["toxic"]: r["n"] for r in known.groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(by, known_examples, {c: whole.get(c, 0) / n[c] for c in (0, 1)})

    def judge(batches):
        seen, known = {}, {}
        for batch in pieces(batches, 4 << 20):
            sizes, idx, tf = vectors_of([t or b"" for t in byte_values(batch.column(1))], sent.value, known)
            out, at = [], 0
            for size in sizes.tolist():
                i, f = idx[at : at + size], tf[at : at + size]
                at += size
                key = xxhash.xxh3_128_digest(i.tobytes() + f.tobytes())  # copies are judged once
                if key not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    score, ids, sims = model.score(i, f.astype(float))
                    seen[key] = (score, model.ids[ids].tolist() if len(ids) else [], sims.tolist())
                out.append(seen[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["doc_id", "score", "neighbours", "cosines"])

    return rows.mapInArrow(judge, schema_of(rows, "doc_id", "score double, neighbours array<long>, cosines array<double>"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")
