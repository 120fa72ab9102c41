"""From documents to packed token identifiers: five stages, each one operator of startline.llm.

Every stage takes what its predecessor kept and returns the columns of documents, whatever else they are named; the
last returns one row for each encoded document. Rows are told apart by all their columns but maps and variants, not by
doc_id alone: rows that share a doc_id, or have none, are documents of their own. A null doc_id is never the one of a
group that stays unless the group has no other. Null and empty texts have no language and end in the first stage. Rows
that are equal in every column are one document from near-dedup on. Empty tables give empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.llm.common import materialise
from startline.llm.op05_decontaminate import decontaminate
from startline.llm.op06_mixture import mix_sources
from startline.llm.op08_language_id import language_id
from startline.llm.op09_token_ids import default_tokenizer, token_ids
from startline.llm.op10_simhash import simhash_components
from startline.llm.shingle_similarity import similar_rows


def free(name: str, docs: DataFrame) -> str:
    """A column name that docs have not."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def row_key(docs: DataFrame) -> Column:
    """Tells rows apart that differ in any column; the smallest has the smallest doc_id, no doc_id comes last."""
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.xxhash64(F.lit(1), *plain).alias("all"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters, or two languages within the margin."""
    names = tuple(free(c, docs) for c in ("language", "language_score", "language_rejected"))
    return language_id(docs, names=names).where(f"NOT `{names[2]}`").select(*docs.columns)


def stay_by_simhash(rows: DataFrame, key: str) -> DataFrame:
    """doc_id: the smallest key of every group of near-duplicates by op10's fingerprints."""
    return simhash_components(rows, id_col=key).where("doc_id = component_id").select("doc_id").distinct()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the smallest, of the near copies that op10's 4 bits find, then of all others of similarity 0.8.

    Only keys, fingerprints and shingle sets are compared; the texts are moved once, to be left out or not. Most pairs
    of five-word similarity 0.8 differ in 5 to 14 bits, so the second step is needed; it verifies exact shingle sets.
    """
    key = free("key", docs)
    rows = docs.withColumn(key, row_key(docs))
    stay = materialise(stay_by_simhash(rows, key), "simhash")
    stay = stay.join(similar_rows(rows, id_col=key, among=stay), "doc_id", "left_anti").withColumnRenamed("doc_id", key)
    return rows.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; rows pass through the scan whole, so nothing is joined."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row").where("n_hit = 0").select("doc_id.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    mixed = mix_sources(docs, carry=tuple(docs.columns)).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and reads them back."""
    return token_ids(docs, default_tokenizer(), ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", encode),
]

#: SQL has neither the compression, the fingerprints nor the tokenizer; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
