"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Every document gets the SHA-256 of its normalised text, once. Documents are dealt into 64 runs. A run is sorted by
digest and cut into ranges of digests (their first bytes), and holds one entry for each digest: the smallest
identifier and a count. In each round groups of four neighbouring runs, two rounds of a binomial tree, exchange their
entries range by range and are merged in order of the digest (64, 16, 4, 1), every level keeping the smallest
identifier. An entry is only merged with another of the same digest, byte length and second hash, so no single hash
decides. The root then flows back to the first runs, and from there to the documents, keyed by run and digest: a
digest that a third of all rows share is 64 keys at each step, never one.

The smallest identifier is kept in a struct, which Spark aggregates by streaming over sorted rows (SortAggregate), not
in a hash table: a partition of the first level sorts its rows into runs before the exchange, and every merge is one
pass over the sorted ranges that arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.llm.common import SPACE, materialise

RUNS, FAN_IN = 64, 4
#: Bytes of a digest that name its range: 65,536 ranges a run.
RANGE_BYTES = 2
KEY = ["range", "digest", "size", "second"]


def merge(runs: DataFrame, node: str) -> DataFrame:
    """One sorted run for each node, from entries of several: range, digest, size, second, least, group_size."""
    dealt = runs.repartition(node, "range").sortWithinPartitions(node, *KEY)
    return dealt.groupBy(node, *KEY).agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other. A null identifier is never the smallest unless
    the whole group has none; then keep_id is null and kept is false. Repeated rows with the smallest identifier
    are all kept: kept says that the identifier is the one that stays. An empty table gives an empty result.
    Columns of other names, clashing ones too, are not read.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
        .select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("size"), F.xxhash64("norm").alias("second"))
        .withColumn("run", F.pmod(F.hash("doc_id"), F.lit(runs)))
    )
    rows = materialise(rows, "digests").withColumn("range", F.substring("digest", 1, RANGE_BYTES))
    entry = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    first = materialise(rows.groupBy("run", *KEY).agg(F.min(entry).alias("least"), F.count(F.lit(1)).alias("group_size")), "runs")
    level, left = first.withColumnRenamed("run", "node"), runs
    while left > 1:
        left = -(-left // fan_in)
        level = merge(level.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")), "node")
    back = first.select("run", *KEY).join(level.select(*KEY, "least", "group_size"), KEY)
    return rows.join(back, ["run", *KEY]).select(
        "doc_id",
        F.col("least.id").alias("keep_id"),
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("least.id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, false) AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
