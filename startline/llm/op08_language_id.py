"""Language ID by compression: the language whose dictionary compresses a text smallest.

Each language that any training row is labelled with has a raw-content zstandard dictionary: its commonest words,
counted over a bounded sample of labelled documents (about SAMPLE for each), the commonest last, where matches are
cheapest. A text is folded to lower-case letters, cut into pieces of PIECE bytes so that its own history does not hide
the dictionary, and every piece is compressed with each dictionary. The smallest total wins; the margin is the share by
which it beats the next, and a text is rejected if the margin is under MARGIN or it has no letters.

A label costs the driver and each worker its dictionary of at most 32 kB and the compressor's table of it, and one
compression of each text; there is no limit to their number but that.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from startline.llm.common import byte_values, materialise, pieces, worker_cache

SAMPLE, DICTIONARY, LEVEL, PIECE, MARGIN, SEED = 1500, 32 << 10, 6, 2048, 0.003, 8
BROADCAST_LABELS = 1 << 16
UNKNOWN = "und"
NAMES = ("lang_pred", "lang_score", "lang_rejected")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: bytes | None) -> bytes:
    """Lower-case letters, other characters as single spaces."""
    return NOT_LETTERS.sub(" ", (text or b"").decode("utf-8", "replace").lower()).strip().encode()


def bounded_sample(rows: DataFrame, label: str, id_col: str, per_label: int, seed: int) -> DataFrame:
    """About per_label rows of each label, chosen by a hash of the identifier; all of a label that has fewer.

    The counts of up to BROADCAST_LABELS labels are broadcast, so that rows stay where they are; more are joined.
    """
    counts = materialise(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "label-counts")
    draw = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_LABELS else counts, label).where(draw < F.lit(float(per_label)) / F.col("_n")).drop("_n")


def learn_dictionaries(train: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Language -> dictionary, from rows of doc_id, text, lang. Rows of null text or language teach nothing."""

    def count(batches):
        for batch in pieces(batches, 4 << 20):
            found: dict[str, Counter] = {}
            for text, lang in zip(byte_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(fold(text).decode().split())
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            if rows:
                lang, word, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word), pa.array(n, pa.int64())], ["lang", "word", "n"])

    rows = bounded_sample(train.where("text IS NOT NULL AND lang IS NOT NULL"), "lang", "doc_id", sample, SEED)
    words = rows.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = words.withColumn("sum", F.sum(F.octet_length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= size)
    lists: dict[str, list] = {}
    for r in words.select("lang", "word", "n").collect():  # at most `size` bytes of words for each language
        lists.setdefault(r["lang"], []).append((r["n"], r["word"]))
    return {lang: (" " + " ".join(w for _, w in sorted(found, key=lambda x: (x[0], x[1]))) + " ").encode() for lang, found in sorted(lists.items())}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> dict:
    out = {}
    for lang, data in dictionaries.items():
        words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        out[lang] = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def classify(text: bytes | None, tools: dict, piece: int = PIECE) -> tuple[str, float]:
    """Language and margin; the unknown language if there are no letters."""
    folded = fold(text)
    if not folded or not tools:
        return UNKNOWN, 0.0
    cuts = [folded[i : i + piece] for i in range(0, len(folded), piece)]
    sizes = sorted((sum(len(tool.compress(c)) for c in cuts), lang) for lang, tool in tools.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """The input's columns and, under `names`, the language, the margin (0 to 1) and whether it is rejected.

    Null texts and texts without letters are `und` with score 0, rejected. Ties go to the smaller language name,
    with margin 0, rejected. Columns of the input that have one of the names are replaced.
    """
    added = list(names)
    docs = docs.drop(*added)
    at = docs.columns.index(text_col)

    def work(batches):
        cache = worker_cache("op8")
        key = hash(tuple(sorted(dictionaries.items())))
        if cache.get("languages", (None,))[0] != key:
            cache["languages"] = (key, compressors(dictionaries))
        tools = cache["languages"][1]
        for batch in pieces(batches, 8 << 20):
            found = [classify(t, tools) for t in byte_values(batch.column(at))]
            rejected = [lang == UNKNOWN or score < margin for lang, score in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])
    return docs.mapInArrow(work, schema)


def remainder(id_col: str, n: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def language_id(docs: DataFrame, margin: float = MARGIN, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """Learns from labelled rows outside the held-out quarter and classifies every row; see identify()."""
    train = docs.where(F.coalesce(remainder("doc_id", 4), F.lit(0)) != 2).select("doc_id", "text", "lang")
    return identify(docs, learn_dictionaries(train), margin=margin, names=names)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(F.coalesce(remainder("doc_id", 4), F.lit(0)) != 2).select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn_dictionaries(train))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
