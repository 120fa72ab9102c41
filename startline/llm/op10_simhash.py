"""SimHash near-dedup: pigeonhole blocks, Hamming verification, connected components.

Fingerprints are made once and stored. Distinct fingerprints are cut into blocks; two that differ in at most d bits
agree on at least (blocks - d) whole blocks, so they meet under one of the block combinations. Each meeting is
verified by XOR and bit count, and only links that connect something new within a meeting are kept: a group of n
close fingerprints gives n - 1 links, not n * n / 2, and no link between different components is lost. Meetings
larger than MEETING are dealt in chunks, every pair of chunks to a task of its own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.llm.common import byte_values, materialise, pieces, salt_of, schema_of, with_least

SHINGLE, SEED, DISTANCE = 4, 42, 4
SALTS, MEETING = 64, 16384
#: Any number over the distance finds the same links at another cost. For n distinct fingerprints that do not cluster,
#: at distance 4: rows shuffled and pairs compared are
#:   6 blocks: 15 keys of 21 bits, 15 n rows, 3.1e-6 n^2 pairs; 1.5e10 rows and 3.1e12 pairs at 10^9
#:   7 blocks: 35 keys of 27 bits, 35 n rows, 1.0e-7 n^2 pairs; 3.5e10 rows and 1.0e11 pairs at 10^9
#:   8 blocks: 70 keys of 32 bits, 70 n rows, 8.1e-9 n^2 pairs; 7.0e10 rows and 8.1e9 pairs at 10^9
#: A core compares some 10^8 pairs a second, so six serve to about 10^9, seven to 10^10, eight beyond.
BLOCKS = 6


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], ">u8")
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def work(batches):
        for batch in pieces(batches, 8 << 20):
            found = np.array([fingerprint(t, shingle, seed) for t in byte_values(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(work, schema_of(ids, "doc_id", "fp long"))


def block_masks(blocks: int, distance: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def spanning_links(a: np.ndarray, b: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links (positions in a, then b) that join all of a, or of a and b across, that lie within the distance."""
    every = a if b is None else np.concatenate((a, b))
    label, links = np.arange(len(every)), []
    if b is None and len(a) <= 128:
        x, y = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= distance, 1))
        found = zip(x.tolist(), y.tolist(), strict=True)
        for i, j in found:
            if label[i] != label[j]:
                links.append((i, j))
                label[label == label[j]] = label[i]
        return links
    for i in range(len(a)):
        start = i + 1 if b is None else len(a)
        near = np.bitwise_count(every[start:] ^ every[i]) <= distance
        near &= label[start:] != label[i]
        hits = np.nonzero(near)[0]
        if len(hits):
            other, first = np.unique(label[start:][hits], return_index=True)
            links += [(i, start + int(hits[k])) for k in first]
            label[np.isin(label, other)] = label[i]
    return links


def close_links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, meeting: int = MEETING) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that span every component of the close pairs."""
    meets = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(n).cast("int").alias("table"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for n, m in enumerate(block_masks(blocks, distance))])).alias("m")
    ).select("fp", "m.table", "m.key")
    hot = meets.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > meeting)
    hot = materialise(hot.withColumn("chunks", F.ceil(F.col("n") / (meeting // 2)).cast("int")).drop("n"), "hot-meetings")
    if hot.isEmpty():
        dealt = meets.select("fp", "table", "key", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(-1).alias("chunk"))
    else:
        mine = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("chunks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("lo"), F.greatest(o, F.col("chunk")).alias("hi")))
        dealt = meets.join(hot, ["table", "key"], "left").withColumn("chunk", F.coalesce(mine, F.lit(-1)))
        alone = F.array(F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi")))
        dealt = dealt.withColumn("p", F.explode(F.when(F.col("chunks").isNull(), alone).otherwise(pairs))).select("fp", "table", "key", "p.lo", "p.hi", "chunk")
    keys = ["table", "key", "lo", "hi"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "chunk", "fp").select(*keys, "chunk", "fp")

    def work(batches):
        held = None
        for batch in _ended(batches):
            if batch is not None:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if held is None or not len(held[0]):
                continue
            change = np.ones(len(held[0]), bool)
            change[1:] = np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)
            starts = np.append(np.nonzero(change)[0], len(held[0]))
            whole = len(starts) - 1 if batch is None else len(starts) - 2
            out_a, out_b = [], []
            for k in np.nonzero(np.diff(starts)[:whole] > 1)[0].tolist():
                a, z = starts[k], starts[k + 1]
                fps, lo, hi = held[5][a:z].view(np.uint64), held[2][a], held[3][a]
                if lo == hi:
                    links = spanning_links(fps, None, distance)
                else:
                    cut = int(np.searchsorted(held[4][a:z], hi))
                    links = spanning_links(fps[:cut], fps[cut:], distance) if 0 < cut < z - a else []
                for i, j in links:
                    out_a.append(fps[i])
                    out_b.append(fps[j])
            held = [c[starts[whole] :] for c in held]
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (out_a, out_b)], ["a", "b"])

    return dealt.mapInArrow(work, "a long, b long")


def _ended(batches):
    yield from batches
    yield None


def components(links: DataFrame, name: str = "links", rounds: int = 100) -> DataFrame:
    """node and root (the smallest node of its component), by alternating large and small stars, for every linked node.

    A star of any size is dealt by (centre, salt), never by its centre alone.
    """
    now = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    seen = None
    for n in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialise(large.distinct(), f"{name}-large-{n}")
        # each neighbour but the least is tied to the least; the least's own row ties the centre to it
        small = with_least(large, "u", "v", "m").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        now = materialise(small.where("u <> v").distinct(), f"{name}-{n}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """One row for each input row: doc_id, fp (signed long), component_id, the smallest doc_id of its component.

    Null and empty texts have fingerprint 0 and link like any other. Texts shorter than a shingle are one shingle.
    Repeated rows are members of the same component; null identifiers are never the smallest unless there is no
    other. An empty table gives an empty result. Other columns, clashing names included, are not read. `blocks`
    changes the cost alone, see BLOCKS.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints").withColumn("salt", salt_of("doc_id", salts=SALTS))
    part = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    distinct = materialise(part.groupBy("fp").agg(F.min("least").alias("least")), "distinct")
    roots = components(close_links(distinct.select("fp"), distance, blocks))
    nodes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = with_least(materialise(nodes, "nodes"), "root", "least", "component_id", spread="fp").select("fp", "component_id")
    back = part.select("fp", "salt").join(found, "fp")
    return rows.join(back, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
