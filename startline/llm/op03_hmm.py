"""Language-model scoring with a hidden Markov model trained by Baum-Welch.

Symbols. The OWN commonest training tokens are symbols of their own; every other word, known or not, belongs to a
class by its last three bytes. A state emits a symbol; a class symbol then emits one of its words by add-0.1
smoothed counts with room for one unknown word, so the model is a distribution over all sequences.

Counts. Words are counted over all training documents. At most COMMON of the commonest words, whole bands of like
counts, go to every task; the rest of a document's words meet their counts in a join, one row for each document and rare word.

Training. Each round computes expected counts of starts, steps and emissions by scaled forward-backward over all
training documents, sums them over partitions in a tree, and re-estimates on the driver (states x symbols numbers).
The start is a clustering of a sample of some SAMPLE documents, of longer ones a slice of SLICE symbols at a drawn
place; the draw depends on identifier and text, not on how rows lie in files.

Scoring. The scaled forward recursion gives the exact likelihood of the symbol sequence of a whole text; the
words' shares in their classes are added. Logarithms are to base 10.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.llm.common import byte_values, materialise, pieces
from startline.llm.op08_language_id import remainder

STATES, OWN, CLASSES, COMMON = 8, 4096, 1024, 100_000
ROUNDS, SAMPLE, SEED, ADD = 4, 2000, 3, 0.1
#: Symbols of a text that the start is drawn from.
SLICE = 8192
#: Symbols that run side by side; documents of like length share a run.
RUN, HELD = 400_000, 2_000_000
#: Pseudo-counts that draw a state's emissions to the whole corpus.
DRAWN = 200.0
END = b""


def class_of(word: bytes, classes: int = CLASSES) -> int:
    return zlib.crc32(word[-3:]) % classes


def count_words(train: DataFrame) -> DataFrame:
    """word (binary, empty for the end of a document) and c."""

    def work(batches):
        found, n = Counter(), 0

        def send():
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

        for batch in pieces(batches, 8 << 20):
            for text in byte_values(batch.column(0)):
                found.update((text or b"").lower().split())
            found[END] += batch.num_rows
            if len(found) > 600_000:
                yield from send()
                found.clear()
        yield from send()

    return train.select("text").mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What every task needs to turn words into symbols: a bounded number of words, and the classes' totals."""

    def __init__(self, common: list[tuple[bytes, int]], own: int, class_c, class_v, total: int, distinct: int):
        self.index = {w: n for n, (w, _) in enumerate(common)}
        counts = np.array([c for _, c in common] or [0], float)
        self.own, self.total, self.distinct = min(own, len(common)), total, distinct
        self.symbols = self.own + CLASSES
        self.log_c = np.log10(counts + ADD)
        self.class_log = np.log10(class_c + ADD * (class_v + 1))
        cls = np.array([class_of(w) for w, _ in common] or [0])
        n = np.arange(len(counts))
        self.symbol = np.where(n < self.own, n, self.own + cls).astype(np.uint16)
        self.share = np.where(n < self.own, 0.0, self.log_c - self.class_log[cls])
        whole = np.concatenate((counts[: self.own] + ADD, class_c + ADD * (class_v + 1)))
        self.unigram = whole / whole.sum()


def learn_vocabulary(counts: DataFrame, own: int = OWN, common: int = COMMON) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # whole classes of like counts, the highest first, while they fit; a top-k would send k rows from every partition
    band = F.floor(F.log2("c") * 16).cast("int")
    room, least = common, 1 << 30
    for r in sorted(counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["band"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["band"]
    top = [(bytes(r["word"]), r["c"]) for r in counts.where((band >= least) | (F.col("word") == F.lit(END))).collect()]
    # the end of a document is always a symbol of its own
    top.sort(key=lambda x: (x[0] != END, -x[1], x[0]))
    # classes hold all words that are not symbols of their own
    last = F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")
    by_class = counts.groupBy(F.pmod(F.crc32(last), F.lit(CLASSES)).alias("g"))
    class_c, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # a row for each class
        class_c[r["g"]], class_v[r["g"]] = r["c"], r["v"]
    for w, c in top[:own]:
        class_c[class_of(w)] -= c
        class_v[class_of(w)] -= 1
    return Vocabulary(top, own, class_c, class_v, total, distinct)


ENCODED = "uid long, doc_id {}, held_out boolean, n_tokens long, known long, base double, share double, symbols binary, rare array<binary>, rare_n array<int>"


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Symbols of every document, sums over its common words, and its rare words with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        v, n = sent.value, 0
        get, first = v.index.get, TaskContext.get().partitionId() << 40
        for batch in pieces(batches, 8 << 20):
            rows = []
            for text in byte_values(batch.column(1)):
                words = (text or b"").lower().split()
                words.append(END)
                at = np.array([get(w, -1) for w in words], np.int64)
                rare = np.nonzero(at < 0)[0]
                symbols = v.symbol[at]
                known = at[at >= 0] if len(rare) else at
                base, share = float(v.log_c[known].sum()), float(v.share[known].sum())
                counted: Counter = Counter()
                if len(rare):
                    own = [words[i] for i in rare.tolist()]
                    cls = np.array([class_of(w) for w in own])
                    symbols[rare] = (v.own + cls).astype(np.uint16)
                    share -= float(v.class_log[cls].sum())
                    counted.update(own)
                rows.append((len(words), len(known), base, share, symbols.astype("<u2").tobytes(), list(counted), list(counted.values())))
            cols = list(zip(*rows, strict=True))
            uid = pa.array(np.arange(first + n, first + n + len(rows)))
            n += len(rows)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([uid, batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "share", "symbols", "rare", "rare_n"])

    rows = docs.select("doc_id", "text", "held_out")
    return rows.mapInArrow(work, ENCODED.format(rows.schema["doc_id"].dataType.simpleString()))


class Hmm:
    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit


def runs_of(sequences: list[np.ndarray], most: int = RUN):
    """Groups of sequence numbers, longest first, of about `most` symbols together."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    group, size = [], 0
    for i in order:
        if group and size + len(sequences[i]) > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(sequences[i])
    if group:
        yield group


def forward(model: Hmm, seqs: list[np.ndarray], keep: bool = False):
    """Natural log-likelihoods of sequences ordered longest first; with keep also what backward needs."""
    lengths = np.array([len(s) for s in seqs])
    width = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # sequences that reach each place
    offset = np.concatenate(([0], np.cumsum(width)))
    flat = np.empty(offset[-1], np.int64)
    for k, s in enumerate(seqs):
        flat[offset[: len(s)] + k] = s
    emit = np.ascontiguousarray(model.emit.T)
    total, states = np.zeros(len(seqs)), len(model.start)
    alphas = np.empty((offset[-1] if keep else 0, states))
    scales = np.empty(offset[-1] if keep else 0)
    alpha = None
    for t in range(lengths[0]):
        n = width[t]
        alpha = (model.start if t == 0 else alpha[:n] @ model.step) * emit[flat[offset[t] : offset[t + 1]]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
        if keep:
            alphas[offset[t] : offset[t + 1]] = alpha
            scales[offset[t] : offset[t + 1]] = scale
    return (total, flat, offset, width, alphas, scales, emit) if keep else total


def expected(model: Hmm, seqs: list[np.ndarray], sums: list[np.ndarray]) -> float:
    """Adds the expected counts of starts, steps and emissions to sums; the log-likelihood."""
    total, flat, offset, width, alphas, scales, emit = forward(model, seqs, keep=True)
    states = len(model.start)
    beta = np.ones((0, states))
    gamma = alphas
    for t in range(len(width) - 1, -1, -1):
        n = width[t]
        now = np.ones((n, states))
        if len(beta):
            m = len(beta)
            ahead = beta * emit[flat[offset[t + 1] : offset[t + 2]]] / scales[offset[t + 1] : offset[t + 2], None]
            sums[1] += model.step * (alphas[offset[t] : offset[t] + m].T @ ahead)
            now[:m] = ahead @ model.step.T
        gamma[offset[t] : offset[t + 1]] *= now
        beta = now
    sums[0] += gamma[offset[0] : offset[1]].sum(axis=0)
    for k in range(states):
        sums[2][k] += np.bincount(flat, weights=gamma[:, k], minlength=sums[2].shape[1])
    return float(total.sum())


def _held(batches, column: int, other: int):
    """Sequences with a second column, some millions of symbols at a time."""
    seqs, others, n = [], [], 0
    for batch in pieces(batches, 8 << 20):
        for raw, x in zip(batch.column(column), batch.column(other).to_pylist(), strict=True):
            seqs.append(np.frombuffer(raw.as_buffer(), "<u2"))
            others.append(x)
            n += len(seqs[-1])
        if n > HELD:
            yield seqs, others
            seqs, others, n = [], [], 0
    if seqs:
        yield seqs, others


def tree_sum(parts: DataFrame, fan_in: int = 32) -> np.ndarray | None:
    """The sum of the float64 vectors in `data` over all rows; node numbers the partitions."""

    def merge(key, table):
        total = sum((np.frombuffer(raw.as_buffer(), np.float64) for raw in table.column("data")), 0.0)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["node", "data"])

    level, width = parts, parts.rdd.getNumPartitions()
    while width > 1:
        level = level.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).groupBy("node").applyInArrow(merge, "node int, data binary")
        width = -(-width // fan_in)
    rows = level.collect()  # one row, or none
    return np.frombuffer(rows[0]["data"], np.float64) if rows else None


def baum_welch(encoded: DataFrame, model: Hmm, unigram: np.ndarray, rounds: int = ROUNDS, drawn: float = DRAWN) -> Hmm:
    """Rounds of expectation over all rows of encoded and re-estimation; smoothing keeps every emission possible."""
    for _ in range(rounds):
        sent = encoded.sparkSession.sparkContext.broadcast(model)

        def work(batches, sent=sent):
            m = sent.value
            sums = [np.zeros_like(m.start), np.zeros_like(m.step), np.zeros_like(m.emit)]
            seen = False
            for seqs, _ in _held(batches, 0, 1):
                for group in runs_of(seqs):
                    expected(m, [seqs[i] for i in group], sums)
                    seen = True
            if seen:
                data = np.concatenate([x.reshape(-1) for x in sums]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([data])], ["node", "data"])

        found = tree_sum(encoded.select("symbols", "uid").mapInArrow(work, "node int, data binary"))
        if found is None:
            return model
        k, a = model.emit.shape
        start, step, emit = found[:k], found[k : k + k * k].reshape(k, k), found[k + k * k :].reshape(k, a)
        model = estimate(start, step, emit, unigram, drawn)
    return model


def estimate(start, step, emit, unigram, drawn: float = DRAWN) -> Hmm:
    k = len(start)
    start = (start + 0.1) / (start.sum() + 0.1 * k)
    step = (step + 0.1) / (step.sum(axis=1, keepdims=True) + 0.1 * k)
    emit = (emit + drawn * unigram) / (emit.sum(axis=1, keepdims=True) + drawn)
    return Hmm(start, step, emit)


def first_model(sample: list[np.ndarray], symbols: int, unigram: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
    """States from a spherical k-means over the sample's symbol frequencies."""
    rng = np.random.default_rng(seed)
    counts = np.array([np.bincount(s, minlength=symbols) for s in sample if len(s)], float).reshape(-1, symbols)
    if len(counts) < states:
        emit = rng.dirichlet(np.ones(states), symbols).T * unigram
        return estimate(np.ones(states), np.eye(states) * 8 + 1, emit * 100, unigram)
    x = np.sqrt(counts)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[[0]]
    while len(centre) < states:  # the farthest so far
        centre = np.concatenate((centre, x[[int(np.argmin((x @ centre.T).max(axis=1)))]]))
    for _ in range(10):
        own = np.argmax(x @ centre.T, axis=1)
        centre = np.array([x[own == k].sum(axis=0) if (own == k).any() else x[rng.integers(len(x))] for k in range(states)])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    own = np.argmax(x @ centre.T, axis=1)
    emit = np.array([counts[own == k].sum(axis=0) for k in range(states)])
    # documents seldom change their state at first
    return estimate(np.bincount(own, minlength=states).astype(float), np.eye(states) * 95 + 1, emit, unigram, drawn=1000.0)


def first_sample(train: DataFrame, n: int, sample: int = SAMPLE, most: int = SLICE) -> list[np.ndarray]:
    """Symbols of about `sample` of n rows, drawn by identifier and symbols alone; of longer ones a slice of `most`."""
    seed = F.xxhash64(F.lit(SEED), "doc_id", "symbols")
    drawn = train.select("symbols", seed.alias("draw")).where(F.pmod("draw", F.lit(1 << 30)) < F.lit(sample / max(1, n) * (1 << 30)))
    over = F.greatest(F.octet_length("symbols") - 2 * most, F.lit(0))
    part = F.substring("symbols", 1 + 2 * F.pmod(F.xxhash64("draw"), F.floor(over / 2) + 1).cast("int"), F.lit(2 * most))
    rows = drawn.select("draw", part.alias("symbols")).orderBy("draw", "symbols").limit(2 * sample).collect()
    return [np.frombuffer(r["symbols"], "<u2") for r in rows]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """For every row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: one token, the end. Rows of null identifier are training rows unless held_out says
    otherwise. Repeated rows are trained on and scored each. Without training rows the counts are 0, all words are
    unknown and the states do not differ. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(remainder("doc_id", 10) == 0 if held_out is None else held_out, F.lit(False)))
    counts = materialise(count_words(rows.where("NOT held_out")), "word-counts")
    vocabulary = learn_vocabulary(counts)
    encoded = materialise(encode(rows, vocabulary), "symbols")
    train = encoded.where("NOT held_out")
    n = train.count()
    model = first_model(first_sample(train, n), vocabulary.symbols, vocabulary.unigram, states)
    model = baum_welch(train, model, vocabulary.unigram, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = sent.value
        for seqs, uids in _held(batches, 0, 1):
            found = np.empty(len(seqs))
            for group in runs_of(seqs):
                found[group] = forward(m, [seqs[i] for i in group])
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(found / math.log(10))], ["uid", "path"])

    paths = encoded.select("symbols", "uid").mapInArrow(judge, "uid long, path double")
    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    rare = rare.join(counts, "word", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    norm = math.log10(vocabulary.total + ADD * (vocabulary.distinct + 1))
    out = encoded.drop("symbols", "rare", "rare_n").join(paths, "uid").join(rare, "uid", "left")
    more = F.coalesce("rare_base", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("path") + F.col("share") + more).alias("score"),
    )


def op3_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
