"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by source and exact token length. Targets come from weights, capped at a multiple of the
source's size. Every document is first taken as many whole times as the target allows; the rest of the target is
fitted by length counts: a proportional floor of each length's documents, then the longest lengths that still fit,
then a bounded-knapsack dynamic programme over the little that remains. Which documents of a length are taken
follows a seeded order, found through the counts of hash bins, so that no source or length is sorted in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from startline.llm.common import WORD, materialise, running_sums

SEED, MOST_COPIES, BINS = 20240, 3, 4096
WEIGHTS = (1, 2, 3)
#: The dynamic programme runs over budgets up to this; larger ones are first cut down by the longest lengths.
TABLE = 1 << 16


def fit_budget(lengths: list[int], counts: list[int], budget: int, table: int = TABLE, extra: int = 0) -> list[int]:
    """How many documents of each length to take so that their sizes sum as near under budget as can be found.

    The proportional share comes first, then longest-first down to `table`, then the exact best subset sum. Only if
    that does not meet the budget may documents be taken again, up to `extra` times each.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total <= budget:
        return list(counts)
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= table:
            break
        add = min(counts[i] - taken[i], (left - table // 2) // lengths[i])
        if add > 0:
            taken[i] += add
            left -= add * lengths[i]
    # bounded knapsack: bit b of a state says that a sum of b can be reached; counts are split in powers of two
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i, may in [(i, counts[i] - taken[i]) for i in order] + [(i, counts[i] * extra) for i in order]:
        if reach >> left & 1:
            break
        spare, size = min(may, left // lengths[i]), 1
        while spare > 0:
            many = min(size, spare)
            spare, size = spare - many, size * 2
            new = (reach | (reach << (many * lengths[i]))) & mask
            if new != reach:
                steps.append((i, many, reach))
                reach = new
    at = reach.bit_length() - 1
    for i, many, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += many
            at -= many * lengths[i]
    return taken


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """(source, name, source_size) -> with target: shares of the total by weight, stopped at cap times the size.

    Weights repeat over the sources by code point, null last. A source is at its stop exactly if its stop per
    weight is below the level that the sources after it would get, so one ordered pass settles the resharing. Both
    orders run over ranges of sources, so that hosts may be sources.
    """
    ranked = running_sums(sizes, [F.col("source").isNull(), F.col("source")], {"pos": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights)).cast("int") + 1)
    ranked = materialise(ranked.withColumn("weight", weight).withColumn("stop", F.lit(float(cap)) * F.col("source_size")), "sources")
    whole_size, whole_weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    ranked = running_sums(ranked, [F.col("stop") / F.col("weight"), F.col("pos")], {"stops": F.col("stop"), "weights": F.col("weight")})
    level = (F.lit(float(whole_size)) - F.col("stops")) / (F.lit(whole_weight) - F.col("weights"))
    ranked = materialise(ranked.withColumn("level", level).withColumn("capped", F.col("stop") < F.col("weight") * F.col("level")), "levels")
    rest = ranked.where("NOT capped").agg(F.min(F.struct(F.col("stop") / F.col("weight"), "pos", "level"))["level"]).first()[0]
    shared = F.least(F.col("stop"), F.col("weight") * F.lit(rest).cast("double"))
    return ranked.select("source", "name", "source_size", F.when(F.col("capped"), F.col("stop")).otherwise(shared).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), weights=WEIGHTS, cap: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """For every input row doc_id, source, size, source_size, target, copies and taken, and the struct `row` of the columns in carry.

    Size is the number of words, 0 for null or empty text; such documents are never taken. Null sources are one
    source, the last. Repeated rows are documents of their own; rows alike in source, length, identifier and text
    may stand for each other. A source without words has target 0. An empty table gives an empty result.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("name"),  # the source, never null
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), id_col).alias("draw"),
        F.xxhash64(text_col).alias("tie"),
        (F.struct(*carry) if carry else F.lit(0)).alias("row"),
    )
    base = materialise(base.withColumn("bin", F.pmod("draw", F.lit(BINS)).cast("int")), "sizes")
    counts = base.groupBy("name", "size", "bin").agg(F.count(F.lit(1)).alias("n"))
    by_length = materialise(counts.groupBy("name", "size").agg(F.sum("n").alias("n")), "lengths")
    sources = by_length.groupBy("name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = sources.withColumn("source", F.when(F.col("name") != "", F.expr("substring(name, 2)").cast(base.schema["source"].dataType)))
    targets = source_targets(sources, weights, cap).drop("source")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        copies = min(int(target // whole), cap)
        more = pd.Series(0, index=pdf.index)
        if copies < cap:
            more += fit_budget(pdf["size"].tolist(), pdf["n"].tolist(), round(target - copies * whole), extra=cap - copies - 1)
        return pd.DataFrame({"name": pdf["name"], "size": pdf["size"], "copies": copies + more // pdf["n"], "more": more % pdf["n"]})

    lengths = by_length.join(targets, "name").select("name", "size", "n", "source_size", "target")
    plans = lengths.where("size > 0").groupBy("name").applyInPandas(plan, "name string, size long, copies long, more long")
    # a document is taken once more if its rank in the seeded order of its source and length is within `more`
    run = Window.partitionBy("name", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    cut = bins.join(plans, ["name", "size"], "left").join(targets, "name")
    cut = cut.select("name", "size", "bin", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("whole"), (F.coalesce("more", F.lit(0)) - F.col("before")).alias("room"))
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy("name", "size", "bin").orderBy("draw", "doc_id", "tie")))
    out = ranked.join(cut, ["name", "size", "bin"])
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("rank") <= F.col("room")).cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
