"""Filter interaction audit: what each quality filter removes alone, after others, and on average over all orders.

Texts are scanned in their Arrow buffers: a table of byte classes marks white space, capitals, symbols and the bytes
that continue a code point, and differences of prefix sums at the texts' offsets give the counts of every text of a
batch at once. Words get a hash by prefix sums as well; within each document the hashes are sorted, equal neighbours
are verified byte by byte, and what is left is the number of distinct words. A document then is a mask of the filters
that it fails, documents reduce to counts by part and mask, and every order of the filters is read off these counts.
"""

from __future__ import annotations

import hashlib
import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.llm.common import materialise, pieces, schema_of, with_least

SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
SYMBOLS = b"#$%&*|"
#: Bytes of text that a task scans at once; arrays of 64-bit numbers of that length are held. Longer texts go in parts.
SCAN_BYTES = 2 << 20
#: A sort key holds the row of a scan above this many bits of a word's hash.
HASH_BITS = 44
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def byte_classes(symbols: bytes = SYMBOLS) -> np.ndarray:
    classes = np.zeros(256, np.uint8)
    classes[[0x20, *range(0x09, 0x0E)]] = SPACE
    classes[0x41:0x5B] = CAPITAL
    classes[0x80:0xC0] = INNER
    classes[list(symbols)] |= SYMBOL
    return classes


def powers(base: int, n: int) -> np.ndarray:
    """base ^ 0 to base ^ (n - 1) modulo 2^64, by doubling."""
    found = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        found[done : done + more] = found[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return found


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of these lengths at a and at b differ in any byte."""
    bad = np.zeros(len(a), bool)
    for size in np.unique(length[length <= 64]).tolist():
        at = np.nonzero(length == size)[0]
        step = np.arange(size)
        bad[at] = (data[a[at, None] + step] != data[b[at, None] + step]).any(axis=1)
    for i in np.nonzero(length > 64)[0].tolist():
        bad[i] = not np.array_equal(data[a[i] : a[i] + length[i]], data[b[i] : b[i] + length[i]])
    return bad


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int, raise_to: np.ndarray, lower_by: np.ndarray) -> np.ndarray:
    """The number of distinct words of each row; words are data[starts:ends], in order of rows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * raise_to[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * lower_by[starts]
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    key = (row.astype(np.uint64) << np.uint64(HASH_BITS)) | (value >> np.uint64(64 - HASH_BITS))
    order = np.argsort(key)
    key, starts, length = key[order], starts[order], (ends - starts)[order]
    same = np.nonzero(key[1:] == key[:-1])[0]
    other = length[same] != length[same + 1]
    other |= differing(data, starts[same], starts[same + 1], np.where(other, 0, length[same]))
    row = row[order]
    found = np.bincount(row, minlength=rows) - np.bincount(row[same], minlength=rows)
    for r in np.unique(row[same[other]]).tolist():  # words of one hash that differ: count this row by its words
        own = np.nonzero(row == r)[0]
        found[r] = len({data[a : a + n].tobytes() for a, n in zip(starts[own].tolist(), length[own].tolist(), strict=True)})
    return found


def scan(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, raise_to: np.ndarray, lower_by: np.ndarray) -> list[np.ndarray]:
    """COUNTS of the texts data[offsets[i]:offsets[i + 1]]."""
    kind, rows = classes[data], len(offsets) - 1

    def by_row(mark: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mark, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    apart = np.ones(len(data) + 1, bool)
    apart[1:] = (kind & SPACE) != 0  # before each byte and after the last
    word = ~apart[1:]
    first = apart[:-1].copy()
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.ones(len(data), bool)
    last[:-1] = apart[2:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    begins = word & first
    n_words = by_row(begins)
    starts, ends = np.nonzero(begins)[0], np.nonzero(word & last)[0] + 1
    row = np.repeat(np.arange(rows), n_words)
    n_distinct = distinct_words(data, starts, ends, row, rows, raise_to, lower_by)
    return [n_words, n_distinct, by_row((kind & CAPITAL) != 0), by_row((kind & INNER) == 0), by_row((kind & SYMBOL) != 0)]


def scan_long(data: np.ndarray, classes: np.ndarray, raise_to: np.ndarray, lower_by: np.ndarray) -> list[int]:
    """COUNTS of one text, in parts that end at white space; distinct words are held as a set."""
    gaps = np.nonzero(classes[data] & SPACE)[0]
    total, words, at = np.zeros(5, np.int64), set(), 0
    while at < len(data):
        n = np.searchsorted(gaps, at + SCAN_BYTES)
        end = len(data) if n == len(gaps) else int(gaps[n]) + 1
        part = data[at:end]
        words.update(part.tobytes().split())
        if len(part) > 2 * SCAN_BYTES:  # a word of more than a scan
            kind = classes[part]
            total += [len(part.tobytes().split()), 0, *(int(np.count_nonzero(x)) for x in (kind & CAPITAL, (kind & INNER) == 0, kind & SYMBOL))]
        else:
            total += [int(c[0]) for c in scan(part, np.array([0, len(part)]), classes, raise_to, lower_by)]
        at = end
    total[1] = len(words)
    return total.tolist()


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", symbols: bytes = SYMBOLS) -> DataFrame:
    """One row for each input row: doc_id, part, COUNTS (long) and digest, the SHA-256 of the text; null text is empty."""

    def work(batches):
        classes = byte_classes(symbols)
        raise_to, lower_by = powers(BASE, 2 * SCAN_BYTES), powers(BASE_INVERSE, 2 * SCAN_BYTES)
        for batch in pieces(batches, SCAN_BYTES):
            for at in range(0, batch.num_rows, 1 << 16):
                now = batch.slice(at, 1 << 16)
                text = now.column(2)
                offsets = np.frombuffer(text.buffers()[1], np.int32 if pa.types.is_string(text.type) else np.int64, len(text) + 1 + text.offset)[text.offset :].astype(np.int64)
                data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
                offsets = offsets - offsets[0]
                if len(data) > 2 * SCAN_BYTES:  # a row that is longer by itself
                    counts = [np.array([x]) for x in scan_long(data, classes, raise_to, lower_by)] if len(text) == 1 else _each(data, offsets, classes, raise_to, lower_by)
                else:
                    counts = scan(data, offsets, classes, raise_to, lower_by)
                view = memoryview(data)
                digests = [hashlib.sha256(view[a:z]).digest() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([now.column(0), now.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.binary())], ["doc_id", "part", *COUNTS, "digest"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(part_col).cast("string").alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, schema_of(rows, "doc_id", "part string, " + ", ".join(f"{c} long" for c in COUNTS) + ", digest binary"))


def _each(data, offsets, classes, raise_to, lower_by):
    """scan_long for every row of a batch that could not be cut."""
    return list(np.array([scan_long(data[a:z], classes, raise_to, lower_by) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]).T)


def fails(filters: dict[str, str]) -> Column:
    """The mask of the filters that a row fails, the first filter in the lowest bit; null is not a failure."""
    return sum((F.coalesce(F.expr(c), F.lit(False)).cast("int") * (1 << n) for n, c in enumerate(filters.values())), F.lit(0))


def interactions(masks: DataFrame, names: str) -> DataFrame:
    """From counts by part and mask (n, n_good, n_toxic): a row for each part, order of the filters and step.

    A document leaves at the first filter of an order that it fails. A filter of k that a document fails is the first
    in one of k orders, so its removals summed over all orders need no order.
    """
    steps = []
    for order in permutations(names):
        bits = [1 << names.index(x) for x in order]
        steps += [{"filter_order": "".join(order), "step": n + 1, "own": b, "before": sum(bits[:n])} for n, b in enumerate(bits)]
    rows = masks.withColumn("at", F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, own int, before int>>")))
    rows = rows.select("part", "mask", "n", "n_good", "n_toxic", "at.*")
    own, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    out = own & ~earlier

    def total(value: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(value)).otherwise(0))

    share = F.expr(f"n * {factorial(len(names))}L div greatest(bit_count(mask), 1)")
    return rows.groupBy("part", "filter_order", "step").agg(
        total("n", ~own & ~earlier).alias("kept"),
        total("n", out).alias("removed"),
        total("n", own & earlier).alias("redundant"),
        total("n", F.col("mask") == F.col("own")).alias("unique_fails"),
        total("n_good", out).alias("good_lost"),
        total("n_toxic", out).alias("toxic_lost"),
        F.sum(F.when(own, share).otherwise(0)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `filters` names SQL conditions of failure, one letter each, at most six, over doc_id, COUNTS and copy (whether a
    row of a smaller identifier has the same text); the default is FILTERS. Null and empty texts are one text without words. A null
    part is the empty string. Rows without identifier are never copies and have no labels; repeated rows of one
    identifier count each and are no copies of each other. A document is good or toxic if any of its labels says 1.
    Filters may be null, which is not a failure. An empty table gives an empty result. Other columns are not read.
    """
    filters = filters or FILTERS
    if len(filters) > 6 or any(len(name) != 1 for name in filters):
        raise ValueError("name at most six filters, one letter each")
    rows = with_least(materialise(document_counts(docs, id_col, text_col, part_col), "counts"), "digest", "doc_id", "least")
    rows = rows.withColumn("copy", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)))
    rows = rows.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), fails(filters).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))  # repeats of one identifier are one row from here
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    masks = rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic")
    )
    return interactions(masks, "".join(filters))


#: Few words; few distinct ones; many capitals; a symbol; a copy of a smaller identifier's text.
FILTERS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 3 * n_points", "D": "n_symbols > 0", "E": "copy"}


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least < w.doc_id THEN 16 ELSE 0 END AS mask,
    coalesce(good, 0) AS good, coalesce(marks.toxic, 0) AS toxic
  FROM w LEFT JOIN marks USING (doc_id)
), g AS (
  SELECT part, mask, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM m GROUP BY part, mask
), f(name, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT concat(a.name, b.name, c.name, d.name, e.name) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)
), x AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & own = 0 AND mask & before = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM x
"""
