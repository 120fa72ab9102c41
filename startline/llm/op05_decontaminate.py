"""Benchmark decontamination: an Aho-Corasick automaton over the normalised items, each text scanned once.

Texts and items are lower-cased (A-Z) and reduced to words joined by single spaces; the automaton holds every
window of `window` consecutive item words with a space at either end, so that matches fall on whole words. Matches
are mapped to word numbers, and for texts with matches to character offsets of the original.

Windows are made and told apart in Spark and written to the shared folder in blocks of BLOCK_BYTES, in order; no
driver and no broadcast ever holds them. A worker reads a block, builds its automaton once and keeps it. Benchmarks
of one block (some 100,000 windows) are one automaton and one scan; of more, each block is a scan of its own, and only
the rows that it hits are gathered by document.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.llm.common import byte_values, pieces, running_sums, schema_of, scratch, shared_files, worker_cache

WINDOW, BLOCK_BYTES = 10, 8 << 20
#: ASCII bytes outside 0-9, A-Z and a-z separate words; A-Z are lower-cased; other bytes are kept.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def item_windows(texts: list[tuple], window: int) -> dict[str, tuple[int, set]]:
    """Spaced window (one character a byte) -> (its number of words, the identifiers of its items)."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in texts:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            found.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), set()))[1].add(item)
    return found


def window_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> tuple[str, int]:
    """The folder of the blocks, and their number: window, words, item in parquet, a folder for each block."""

    def work(batches):
        for batch in pieces(batches, 1 << 20):
            found = item_windows(list(zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True)), window)
            rows = [(key.encode("latin-1"), n, item) for key, (n, items) in found.items() for item in items]
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.string()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["window", "words", "item"])

    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    rows = items.mapInArrow(work, "window binary, words int, item string").distinct()
    size = F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16
    rows = running_sums(rows, [F.col("window"), F.col("item")], {"before": size.cast("long")}).withColumn("block", F.floor(F.col("before") / block_bytes))
    folder = scratch(spark, "windows")
    rows.write.partitionBy("block").parquet(folder)
    found = spark.read.schema("window binary, words int, item string, before long, block long").parquet(folder)
    return folder, 1 + (found.agg(F.max("block")).first()[0] or 0)


def read_block(folder: str, block: int) -> dict[str, tuple[int, set]]:
    """The windows of a block, as item_windows() has them; none if it was not written."""
    fs, path = shared_files(f"{folder}/block={block}")
    found: dict[str, tuple[int, set]] = {}
    for info in fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            table = pq.read_table(info.path, filesystem=fs, columns=["window", "words", "item"], partitioning=None)
            for key, n, item in zip(*(c.to_pylist() for c in table.columns), strict=True):
                found.setdefault(key.decode("latin-1"), (n, set()))[1].add(item)
    return found


def automaton(windows: dict):
    import ahocorasick

    built = ahocorasick.Automaton()
    for key, (n, items) in windows.items():
        built.add_word(key, (len(key), n, tuple(items)))
    built.make_automaton()
    return built


def scan(words: list[bytes], automata) -> tuple[list[tuple[int, int]], set]:
    """Word ranges [start, end) of all matches, and the items they belong to."""
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits, items = [], set()
    for built in automata:
        for end, (size, n, own) in built.iter(text):
            hits.append((end - size + 1, n))
            items.update(own)
    if not hits:
        return [], items
    hits = sorted(set(hits))
    ranges, at, word = [], 0, 0
    for start, n in hits:
        word, at = word + text.count(" ", at, start), start
        ranges.append((word, word + n))
    return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


FOUND = "k1 long, k2 long, n_words long, ranges array<struct<start: long, end: long, first: long, last: long>>, items array<string>"


def scan_block(rows: DataFrame, folder: str, block: int) -> DataFrame:
    """Every row with the word ranges and character offsets that a block's windows hit, and their items."""

    def work(batches):
        cache = worker_cache("op5")
        if cache.get("block", ("",))[0] != (folder, block):
            cache.pop("block", None)
            cache["block"] = ((folder, block), automaton(read_block(folder, block)))
        automata = [cache["block"][1]]
        for batch in pieces(batches, 16 << 20):
            texts = byte_values(batch.column(1))
            n_words, listed, spans = [], [], []
            for text in texts:
                words = words_of(text)
                n_words.append(len(words))
                ranges, own = scan(words, automata)
                listed.append(sorted(x for x in own if x is not None))
                at = [(m.start(), m.end()) for m in ORIGINAL_WORD.finditer(text.decode())] if ranges else []
                spans.append([{"start": a, "end": b, "first": at[a][0], "last": at[b - 1][1]} for a, b in merged(ranges)])
            kinds = (pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "first", "last")])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n_words, pa.int64()), pa.array(spans, kinds[0]), pa.array(listed, kinds[1])], ["doc_id", "k1", "k2", "n_words", "ranges", "items"])

    return rows.mapInArrow(work, schema_of(rows, "doc_id", FOUND))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row doc_id, n_words, n_hit, items (sorted strings) and spans (character offsets of the merged hits).

    Null and empty texts have no words and no hits. An item shorter than the window is one window; an item without
    words matches nothing. Items of a null identifier hit words but are not listed; rows that repeat an identifier
    are one item. Without items nothing is hit. Repeated documents are scanned each. Other columns are not read; the
    identifier may be of any type that can be hashed, a struct of a whole row too.
    """
    folder, blocks = window_blocks(benchmark, item_col, text_col, window, block_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = (F.xxhash64(F.lit(n), "doc_id", "text") if blocks > 1 else F.lit(0).cast("long") for n in (1, 2))
    rows = rows.withColumns(dict(zip(("k1", "k2"), keys, strict=True)))
    found = scan_block(rows, folder, 0)
    if blocks > 1:
        others = None
        for block in range(1, blocks):
            hit = scan_block(rows, folder, block).where(F.size("ranges") > 0).select("k1", "k2", "ranges", "items")
            others = hit if others is None else others.union(hit)
        # a set: rows alike in identifier and text are hit alike
        others = others.groupBy("k1", "k2").agg(F.flatten(F.collect_set("ranges")).alias("more"), F.flatten(F.collect_set("items")).alias("others"))
        none = F.array().cast(found.schema["ranges"].dataType)
        found = found.join(others, ["k1", "k2"], "left").select(
            "doc_id",
            "n_words",
            F.concat("ranges", F.coalesce("more", none)).alias("ranges"),
            F.array_sort(F.array_distinct(F.concat("items", F.coalesce("others", F.array().cast("array<string>"))))).alias("items"),
        )
        found = found.mapInArrow(_join_ranges, found.schema)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_hit"),
        "items",
        F.transform("ranges", lambda r: F.struct(r["first"].alias("start"), r["last"].alias("end"))).alias("spans"),
    )


def _join_ranges(batches):
    """Ranges of several blocks, joined where they overlap or touch."""
    for batch in batches:
        at, out = batch.schema.get_field_index("ranges"), []
        for ranges in batch.column(at).to_pylist():
            done: list[dict] = []
            for r in sorted(ranges, key=lambda r: (r["start"], r["end"])):
                if done and r["start"] <= done[-1]["end"]:
                    if r["end"] > done[-1]["end"]:
                        done[-1] |= {"end": r["end"], "last": r["last"]}
                else:
                    done.append(dict(r))
            out.append(done)
        yield pa.RecordBatch.from_arrays([pa.array(out, c.type) if n == at else c for n, c in enumerate(batch.columns)], batch.schema.names)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), d AS (
  SELECT doc_id, coalesce(w, []) AS w FROM w
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS part
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
), h AS (
  SELECT s.doc_id, s.k, p.n, p.item_id
  FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS part
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)) s
  JOIN p ON p.n = s.n AND p.part = s.part
), c AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id
), x AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(x.n_items, 0) AS BIGINT) AS n_items, coalesce(x.items_sha256, sha256('')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""
