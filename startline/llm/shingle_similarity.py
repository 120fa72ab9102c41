"""Near copies by the Jaccard similarity of their sets of five-word shingles: MinHash bands, then exact sets.

Rows that share a band meet, and every link is verified on exact shingle sets. Two rows of similarity s share no band
with a chance of (1 - s^ROWS)^BANDS: 1.2e-7 at 0.8, less above. As in op10, links that span the components are
enough, so a meeting is settled in two steps, and no row of a large group meets all others:

1. Every row is compared with the smallest row of each of its meetings, its hub; links by then make components.
2. In a meeting that still holds several components, the rows outside the hub's component are compared with all rows
   of other components than their own, in chunks of CHUNK, each pair of chunks a group of its own. A meeting of n near
   copies costs n comparisons; only rows that share a band without being alike cost more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from startline.llm.common import byte_values, materialise, pieces, schema_of
from startline.llm.op10_simhash import components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 40, 5
#: Rows of a chunk in the second step; a task holds the sets of one chunk.
CHUNK = 256


def shingle_set(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, last = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = np.concatenate(([0], ends[:-1]))[:last], (ends - 1)[min(shingle, len(words)) - 1 :]
    joined = b" ".join(words)
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, last))


def multipliers(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1), random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band of the MinHash signature."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):  # products that stay in the processor's cache
        np.minimum(least, (hashes[at : at + 256, None] * a + b).min(axis=0), out=least)
    rows = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return np.fromiter((xxhash.xxh64_intdigest(rows[n].tobytes(), n) for n in range(BANDS)), np.uint64, BANDS).view(np.int64).tolist()


def alike(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < similarity * len(y) - 1e-9:
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def joining(held: list, row: tuple, label: dict, similarity: float) -> list[tuple[int, int]]:
    """Links of a row (identifier, root, set) with held rows of other components; label joins the roots."""

    def root(x):
        while label.get(x, x) != x:
            x = label[x]
        return x

    links = []
    for other in held:
        x, y = root(other[1]), root(row[1])
        if x != y and alike(other[2], row[2], similarity):
            links.append((other[0], row[0]))
            label[y] = x
    return links


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and keys, one for each band; texts without words have none."""

    def work(batches):
        a, b = multipliers()
        for batch in pieces(batches, 8 << 20):
            sets = [shingle_set(t) for t in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([band_keys(s, a, b) if len(s) else [] for s in sets], pa.list_(pa.int64()))], ["doc_id", "keys"])

    ids = _texts(docs, id_col, text_col)
    return ids.mapInArrow(work, schema_of(ids, "doc_id", "keys array<long>"))


def sets_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and hashes, the shingle set as bytes."""

    def work(batches):
        for batch in pieces(batches, 8 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in byte_values(batch.column(1))], pa.binary())], ["doc_id", "hashes"])

    ids = _texts(docs, id_col, text_col)
    return ids.mapInArrow(work, schema_of(ids, "doc_id", "hashes binary"))


def hub_links(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of rows that are like the hub of one of their meetings."""

    def work(batches):
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            same = [alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity) for p, q in zip(x, y, strict=True)]
            found = batch.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], ["a", "b"])

    pairs = met.where("doc_id <> hub").select("doc_id", "hub").distinct().join(sets, "doc_id")
    both = pairs.join(sets.select(F.col("doc_id").alias("hub"), F.col("hashes").alias("others")), "hub")
    return both.select("doc_id", "hub", "hashes", "others").mapInArrow(work, _link_schema(met))


def rest_links(met: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """Links (a, b) between rows of a meeting that lie in different components so far and are both not its hub."""
    placed = met.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    # the meetings' numbers of rows in and outside the hub's component
    hubs = placed.where("doc_id = hub").select("key", F.col("root").alias("heart")).distinct()
    inside = placed.join(hubs, "key").withColumn("inside", F.col("root") == F.col("heart")).where("doc_id <> hub").drop("heart", "hub")
    inside = materialise(inside, "placed")
    count = inside.groupBy("key").agg(F.sum(F.when(F.col("inside"), 0).otherwise(1)).alias("out"), F.count(F.lit(1)).alias("n"))
    left = count.where("out > 0 AND n > 1").select("key", F.ceil(F.col("out") / chunk).cast("int").alias("outs"), F.ceil((F.col("n") - F.col("out")) / chunk).cast("int").alias("ins"))
    rows = inside.join(left, "key")
    own = F.when(F.col("inside"), F.col("outs") + F.pmod(F.xxhash64("doc_id"), F.greatest("ins", F.lit(1)))).otherwise(F.pmod(F.xxhash64("doc_id"), F.greatest("outs", F.lit(1)))).cast("int")
    # chunks outside meet all, chunks inside only those outside
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("outs") - 1)).otherwise(F.sequence(F.lit(0), F.col("outs") + F.col("ins") - 1))
    rows = rows.withColumn("chunk", own).withColumn("other", F.explode(others))
    keys = ["key", "lo", "hi"]
    rows = rows.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "doc_id", "root").join(sets, "doc_id")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "chunk", "doc_id").select(*keys, "chunk", "doc_id", "root", "hashes")

    def work(batches):
        at, held, label = None, [], {}
        for batch in batches:
            links, of = [], batch.schema.field("doc_id").type
            for key, lo, hi, own, doc, root, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, lo, hi) != at:
                    at, held, label = (key, lo, hi), [], {}
                row = (doc, _plain(root), np.frombuffer(raw, np.uint64))
                links += joining(held, row, label, similarity)
                if own == lo:
                    held.append(row)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], of) for n in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(work, _link_schema(met))


def _link_schema(met: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(c, met.schema["doc_id"].dataType) for c in ("a", "b")])


def _plain(value):
    """An identifier that can be looked up; structs come as dictionaries."""
    return tuple(value.values()) if isinstance(value, dict) else value


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, chunk: int = CHUNK, among: DataFrame | None = None) -> DataFrame:
    """node and root, the smallest identifier of its component, for every row that is linked to another.

    Identifiers are distinct and not null; they may be structs. With `among`, a table of doc_id, only these rows take
    part; the identifiers of the others may repeat. Texts without words are linked to nothing, texts of fewer words
    than a shingle are one shingle. An empty table gives an empty result. Other columns are not read.
    """
    keys = materialise(bands(docs, id_col, text_col), "bands")
    if among is not None:
        keys = keys.join(among.select("doc_id"), "doc_id", "left_semi")
    keys = keys.select("doc_id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = materialise(keys.join(shared, "key"), "met")
    rows = _texts(docs, id_col, text_col)
    sets = materialise(sets_of(rows.join(met.select("doc_id").distinct(), "doc_id", "left_semi")), "sets")
    first = materialise(hub_links(met, sets, similarity), "hub-links")
    more = rest_links(met, components(first, "similar-hubs"), sets, similarity, chunk)
    return components(first.union(more), "similar")


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, among: DataFrame | None = None) -> DataFrame:
    """doc_id of every row with a smaller identifier in its component."""
    return similar_components(docs, id_col, text_col, similarity, among=among).select(F.col("node").alias("doc_id"))
