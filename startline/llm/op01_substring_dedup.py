"""Substring dedup: Rabin-Karp hashes of every window of `window` words, matched in Spark.

Every distinct word of a batch is hashed by XXH64 with two seeds; two independent Rabin-Karp hashes of each window of
these values come from prefix sums modulo 2^64, whole batches at a time. Inside a batch equal windows are settled at
once: all but those of the smallest document are repeats, so a passage that a third of all documents share leaves one
row for each batch. The others are dealt over hash ranges as packed columns: a 64-bit key from both hashes (beside
the range's own bits), document and position. Each range marks windows whose key also starts in a smaller document.
Marked windows come back to their document as intervals, merged there into maximal removal intervals. About nine
bytes a window are shuffled, and the texts once.

Ranges hold about RANGE_BYTES of text each, however large the input, one range to a partition.

Matched windows are not compared word by word. Two different windows match if 32 bits of either hash and the range
agree: a chance of 2^-64 for each pair of windows in one range, as words have random values. A polynomial modulo 2^64
is weaker for windows that arrange the same words in certain regular ways (of 32 such words, 2^-45 for one hash
instead of 2^-64), which still leaves 2^-64 by both, as only 32 bits of each are used. With W windows in R ranges some
W * W / (2 R) * 2^-64 false matches are expected in all: 0.0003 at 30 GB of text, 0.01 at 1 TB and one at 100 TB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.llm.common import byte_values, coded_words, give_back, pieces

WINDOW = 50
#: Windows settled together in a batch, and bytes of text hashed at a time.
BATCH_WINDOWS, BATCH_BYTES = 2_000_000, 2 << 20
#: Of packed runs: identifier, mark, first window, end.
KINDS = (np.int64, np.int32, np.int32, np.int32)
#: Of the two hashes: the base of the windows' polynomial, and the seed of the words' values.
BASES, SEEDS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (11, 23)
#: Bytes of text whose windows make a range.
RANGE_BYTES = 16 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, kept and extended."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, powers(base, 0), powers(base, 0)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up, self.down = powers(self.base, n), powers(pow(self.base, -1, 1 << 64), n)
        return self.up[:n], self.down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, power: Powers) -> np.ndarray:
    """Rabin-Karp hashes of values[start:end] modulo 2^64, by prefix sums and inverse powers."""
    up, down = power.of(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def word_values(coded: pa.DictionaryArray) -> list[np.ndarray]:
    """The two values of every word; each distinct word is hashed once."""
    at, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    return [np.fromiter((digest(w, seed) for w in distinct), np.uint64, len(distinct))[at] for seed in SEEDS]


def window_hashes(texts: list[bytes], window: int, power: list[Powers]) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: two hashes, text number and first word; and the words of each text."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, _, coded = coded_words(buffer, IS_SPACE[buffer])
    values = word_values(coded)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    at = np.searchsorted(starts, first)
    n_words = np.diff(at)
    n_windows = np.maximum(n_words - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), n_windows)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    begin = at[text] + pos
    one, two = (mix(span_hashes(v, begin, begin + window, p)) for v, p in zip(values, power, strict=True))
    return one, two, text.astype(np.int32), pos.astype(np.int32), n_words


def pack(array: np.ndarray, tool) -> bytes:
    """Byte planes, compressed: the high planes of small numbers cost nothing."""
    return tool.compress(np.ascontiguousarray(array.view(np.uint8).reshape(-1, array.itemsize).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive positions: document, first, last + 1. Input ordered by both."""
    if not len(doc):
        return doc, pos, pos
    cut = np.nonzero((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1))[0]
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(doc) - 1]))
    return doc[first], pos[first], pos[last] + 1


def _replies(columns: list[np.ndarray], buckets: int, tool):
    """Runs (identifier, mark, start, end) packed by bucket of the identifier: one row for each bucket."""
    bucket = mix(columns[0].astype(np.int64).view(np.uint64)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    own, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at[1:], len(order))
    packed = [[pack(np.ascontiguousarray(c[order[x:y]]), tool) for c in columns] for x, y in zip(at.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.list_(pa.binary()))], ["bucket", "packed"])


def repeated_windows(rows: DataFrame, window: int, ranges: int) -> DataFrame:
    """From doc_id, mark, text: rows of doc_id, mark, starts, ends (of runs of window starts that are repeats)."""

    def settle(held):
        """Settles a batch; yields what is left by range, and the repeats found as a reply of range -1."""
        tool = zstandard.ZstdCompressor(level=1)
        ids, marks = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held[:-1]]).tolist()
        doc = np.concatenate([h[4] + np.int32(b) for h, b in zip(held, base, strict=True)])
        key, part, pos = (np.concatenate([h[i] for h in held]) for i in (2, 3, 5))
        held.clear()
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
        order = np.lexsort((doc, rank[doc])) if np.any(np.diff(rank) < 0) else np.arange(len(doc))
        order = order[np.argsort(key[order], kind="stable")]
        repeat = marked(key[order], rank[doc[order]], extra=part[order])
        again = np.zeros(len(doc), bool)
        again[order[repeat]] = True
        if again.any():
            d, a, b = runs(doc[again], pos[again])
            yield -1, [pack(x, tool) for x in (ids[d], marks[d].astype(np.int32), a.astype(np.int32), b.astype(np.int32))]
        doc, pos, key, part = (x[~again] for x in (doc, pos, key, part))
        order = np.argsort(part, kind="stable")
        doc, pos, key = doc[order], pos[order], key[order]
        cuts = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint32))
        for p in np.nonzero(np.diff(cuts))[0].tolist():
            d, x, k = (y[cuts[p] : cuts[p + 1]] for y in (doc, pos, key))
            head = np.nonzero(np.concatenate(([True], d[1:] != d[:-1])))[0]
            step = np.diff(x, prepend=x[:1])
            step[head] = x[head]
            own = d[head]
            # identifiers as steps: neighbours in a file have near identifiers
            yield p, [pack(np.diff(ids[own], prepend=0), tool), pack(marks[own].astype(np.int32), tool), pack(np.diff(np.append(head, len(d))).astype(np.int32), tool), pack(step.astype(np.int32), tool), k.tobytes()]

    def hash_all(batches):
        power = [Powers(b | 1) for b in BASES]
        # replies settled here go to any range: every task begins at another one
        held, n, turn = [], 0, TaskContext.get().partitionId() * 0x9E3779B1

        def send():
            nonlocal turn
            for p, packed in settle(held):
                turn += 1
                yield pa.RecordBatch.from_arrays([pa.array([p if p >= 0 else turn % ranges], pa.int32()), pa.array([p < 0]), pa.array([packed], pa.list_(pa.binary()))], ["part", "settled", "packed"])

        for batch in pieces(batches, BATCH_BYTES):
            texts = [t or b"" for t in byte_values(batch.column(2))]
            one, two, doc, pos, _ = window_hashes(texts, window, power)
            # the key takes the low half of either hash, the range the high half of the first
            key = (one & np.uint64(0xFFFFFFFF)) | (two << np.uint64(32))
            part = (((one >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint32)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), key, part, doc, pos))
            n += len(one)
            if n >= BATCH_WINDOWS:
                yield from send()
                held, n = [], 0
        if n:
            yield from send()
        give_back()

    def match(batches):
        """Each task holds whole ranges, one after the other; repeats go to the bucket of their document."""
        held, at, tool = [], None, zstandard.ZstdCompressor(level=1)

        def finish():
            if not held:
                return
            ids = np.concatenate([h[0] for h in held])
            marks = np.concatenate([h[1] for h in held])
            base = np.cumsum([0] + [len(h[0]) for h in held[:-1]]).tolist()
            doc = np.concatenate([h[2] + np.int32(b) for h, b in zip(held, base, strict=True)])
            pos, key = (np.concatenate([h[i] for h in held]) for i in (3, 4))
            held.clear()
            rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
            order = np.argsort(key, kind="stable")
            repeat = marked(key[order], rank[doc[order]])
            again = np.zeros(len(doc), bool)
            again[order[repeat]] = True
            if again.any():
                order = np.nonzero(again)[0]
                order = order[np.lexsort((pos[order], doc[order]))]
                d, a, b = runs(doc[order], pos[order])
                yield _replies([ids[d], marks[d], a.astype(np.int32), b.astype(np.int32)], ranges, tool)

        for batch in batches:
            for part, settled, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if settled:
                    yield _replies([unpack(x, k) for x, k in zip(packed, KINDS, strict=True)], ranges, tool)
                    continue
                if part != at:
                    yield from finish()
                    held, at = [], part
                ids, marks, n = np.cumsum(unpack(packed[0], np.int64)), unpack(packed[1], np.int32), unpack(packed[2], np.int32)
                doc = np.repeat(np.arange(len(ids), dtype=np.int32), n)
                step = unpack(packed[3], np.int32)
                total = np.cumsum(step, dtype=np.int64)
                head = np.cumsum(n) - n
                pos = (total - np.repeat(total[head] - step[head], n)).astype(np.int32)
                held.append((ids, marks, doc, pos, np.frombuffer(packed[4], np.uint64)))
        yield from finish()
        give_back()

    def merge(batches):
        """Each task holds whole buckets: the runs of a document as one row."""
        held, at = [], None

        def finish():
            if not held:
                return
            ids, marks, a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((a, marks, ids))
            ids, marks, a, b = ids[order], marks[order], a[order], b[order]
            # the furthest end so far in each document; runs that overlap or touch become one
            own = np.concatenate(([0], np.cumsum((ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])))) << 32
            reach = np.maximum.accumulate(b + own) - own
            first = np.nonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (a[1:] > reach[:-1]))))[0]
            ids, marks, a, b = ids[first], marks[first], a[first], reach[np.append(first[1:], len(ids)) - 1].astype(np.int32)
            own = np.nonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))))[0]
            offsets = pa.array(np.append(own, len(ids)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(marks[own]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (a, b))], ["doc_id", "mark", "starts", "ends"])

        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at:
                    yield from finish()
                    held, at = [], bucket
                held.append([unpack(x, k) for x, k in zip(packed, KINDS, strict=True)])
        yield from finish()

    dealt = rows.mapInArrow(hash_all, "part int, settled boolean, packed array<binary>")
    dealt = dealt.repartitionById(ranges, "part").sortWithinPartitions("part")
    replies = dealt.mapInArrow(match, "bucket int, packed array<binary>")
    replies = replies.repartitionById(ranges, "bucket").sortWithinPartitions("bucket")
    return replies.mapInArrow(merge, "doc_id long, mark int, starts array<int>, ends array<int>")


def marked(key: np.ndarray, rank: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
    """Of rows ordered by key: whether a row of smaller rank has the same key (and the same extra)."""
    if not len(key):
        return np.zeros(0, bool)
    if extra is not None:
        order = np.lexsort((extra, key)) if np.any((key[1:] == key[:-1]) & (extra[1:] != extra[:-1])) else None
        if order is not None:
            out = np.zeros(len(key), bool)
            k, e = key[order], extra[order]
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (e[1:] != e[:-1])))
            out[order] = rank[order] > np.repeat(np.minimum.reduceat(rank[order], np.nonzero(new)[0]), np.diff(np.append(np.nonzero(new)[0], len(k))))
            return out
    head = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
    return rank > np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(key))))


def ranges_for(docs: DataFrame, text_col: str = "text", range_bytes: int = RANGE_BYTES) -> int:
    """The number of ranges for the bytes of all texts, counted in a pass of its own."""
    return 1 + (docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0) // range_bytes


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For every row doc_id, n_words, n_removed, kept_text (kept words joined by one space) and spans (word ranges).

    The identifier is an integer. Null text has no words, like an empty one; texts shorter than a window keep all
    words. Rows that share an identifier are not smaller than each other, so they do not remove one another's
    windows; rows without identifier neither remove nor lose words. An empty table gives an empty result. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    found = repeated_windows(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), window, ranges_for(rows, "text", range_bytes))
    both = rows.join(found.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("doc_id", "text", "starts", "ends")

    def cut(batches):
        for batch in pieces(batches, 8 << 20):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, a, b in zip(byte_values(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if not a:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    spans.append([])
                    continue
                turn = np.zeros(len(words) + 1, np.int32)
                np.add.at(turn, np.array(a), 1)
                np.add.at(turn, np.array(b) + window - 1, -1)
                gone = np.cumsum(turn[:-1]) > 0
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept_text", "spans"],
            )

    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, k, sha256(array_to_string(w[k : k + 49], ' ')) AS part
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)
), f AS (
  SELECT part, min(doc_id) AS least FROM s GROUP BY part
), g AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS pos FROM s JOIN f USING (part) WHERE f.least < s.doc_id
), r AS (
  SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(r.gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN r.gone IS NULL THEN d.w ELSE list_filter(list_transform(d.w, lambda x, i : CASE WHEN list_contains(r.gone, i) THEN NULL ELSE x END), lambda x : x IS NOT NULL) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
