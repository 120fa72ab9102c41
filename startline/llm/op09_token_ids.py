"""Token identifiers as binary files: patched frame-of-reference blocks.

Documents are range-partitioned by identifier; each partition becomes files of consecutive documents, a new one
whenever a file has grown over FILE_BYTES, so that a reader never holds more. A file holds blocks of BLOCK identifiers: the block's minimum is subtracted, the rest is packed at the width that covers
the given percentile, and the low bits of larger values are packed too while their high bits go to an exception
list. An index at the end gives the start of every block, so any range of identifiers is read without the rest.

    file    = b"PFOR" version:u8, blocks, docs:u64 docs without identifier:u64 ids:u64 blocks:u32, block offsets:u64 each,
              doc identifiers:i64 each, token counts:u32 each, offset of docs:u64, crc32 of all before:u32
    block   = minimum:u32 width:u8 exceptions:u16 count:u32, packed bits, positions:u16 each, high bits:u32 each
All numbers are little-endian.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from startline.llm.common import give_back, materialise, pieces, scratch, shuffle_width, target_file, worker_cache

BLOCK, PERCENTILE, END = 4096, 0.90, 0
MAGIC, VERSION = b"PFOR", 2
FOOTER = "<QQQI"
BLOCK_HEADER = "<IBHI"
#: Bytes of pieces and identifiers that a worker remembers, pieces encoded in one string, strings in one call.
REMEMBERED, TOGETHER, CALL = 12 << 20, 200, 256
#: Bytes of text whose pieces are numbered together, and of a file before the next one is begun.
SEGMENT, FILE_BYTES = 4 << 20, 32 << 20
#: Kinds of bytes that decide where a text may be cut; all others are 0.
SPACE_BYTE, PUNCTUATION, ALPHANUMERIC = 1, 2, 3
KIND = np.array([SPACE_BYTE if 9 <= b <= 13 or b == 32 else ALPHANUMERIC if chr(b).isalnum() and b < 128 else PUNCTUATION if 33 <= b < 127 else 0 for b in range(256)], np.uint8)
#: White space that is not one of the six bytes above.
OTHER_SPACE = r"[\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, least significant bit first."""
    kind = "<u2" if width <= 16 else "<u4"
    bits = np.unpackbits(values.astype(kind).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    kind, whole = ("<u2", 16) if width <= 16 else ("<u4", 32)
    bits = np.zeros((n, whole), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view(kind).reshape(-1).astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(rest, k := min(len(rest) - 1, int(percentile * len(rest))))[k]).bit_length()
    over = np.nonzero(rest >> np.uint32(width) if width < 32 else np.zeros(0, np.uint32))[0]
    head = struct.pack(BLOCK_HEADER, low, width, len(over), len(ids))
    high = (rest[over] >> np.uint32(width)).astype("<u4") if len(over) else np.zeros(0, "<u4")
    return head + pack_bits(rest, width) + over.astype("<u2").tobytes() + high.tobytes()


def decode_block(data: memoryview) -> np.ndarray:
    low, width, over, n = struct.unpack_from(BLOCK_HEADER, data)
    at = struct.calcsize(BLOCK_HEADER)
    size = (n * width + 7) // 8
    rest = unpack_bits(data[at : at + size], width, n)
    at += size
    if over:
        pos = np.frombuffer(data, "<u2", over, at)
        rest[pos] |= np.frombuffer(data, "<u4", over, at + 2 * over) << np.uint32(width)
    return rest + np.uint32(low)


def write_file(out, docs, block: int = BLOCK, most: int | None = None) -> tuple[int, int, bool]:
    """Writes pairs (doc_id or None, identifiers) to a stream; the numbers of documents and identifiers.

    Documents without doc_id come last. Stops behind the document that takes the file over `most` bytes; the third
    result says whether docs had ended by then.
    """
    crc, at, offsets, ids, counts, held, n, nulls = 0, 0, [], [], [], [], 0, 0

    def put(data: bytes):
        nonlocal crc, at
        out.write(data)
        crc = zlib.crc32(data, crc)
        at += len(data)

    put(MAGIC + bytes([VERSION]))
    total, ended = 0, True
    for doc_id, tokens in docs:
        nulls += doc_id is None
        ids.append(doc_id or 0)
        counts.append(len(tokens))
        total += len(tokens)
        held.append(tokens)
        n += len(tokens)
        if n >= block:
            flat = np.concatenate(held)
            for k in range(0, n - n % block, block):
                offsets.append(at)
                put(encode_block(flat[k : k + block]))
            held, n = [flat[n - n % block :].copy()], n % block
            if most is not None and at > most:
                ended = False
                break
    if n:
        offsets.append(at)
        put(encode_block(np.concatenate(held)))
    footer = at
    put(struct.pack(FOOTER, len(ids), nulls, total, len(offsets)))
    put(np.array(offsets, "<u8").tobytes() + np.array(ids, "<i8").tobytes() + np.array(counts, "<u4").tobytes())
    put(struct.pack("<Q", footer))
    out.write(struct.pack("<I", crc))
    return len(ids), total, ended


def read_file(data):
    """Yields (doc_id, identifiers) in file order; raises ValueError if the file is not whole."""
    view = memoryview(data)
    if bytes(view[:5]) != MAGIC + bytes([VERSION]):
        raise ValueError("not a token file of this version")
    if zlib.crc32(view[:-4]) != struct.unpack("<I", view[-4:])[0]:
        raise ValueError("checksum differs")
    footer = struct.unpack("<Q", view[-12:-4])[0]
    n_docs, nulls, n_ids, n_blocks = struct.unpack_from(FOOTER, view, footer)
    at = footer + struct.calcsize(FOOTER)
    offsets = np.frombuffer(view, "<u8", n_blocks, at)
    ids = np.frombuffer(view, "<i8", n_docs, at + 8 * n_blocks)
    counts = np.frombuffer(view, "<u4", n_docs, at + 8 * n_blocks + 8 * n_docs)
    if int(counts.sum()) != n_ids:
        raise ValueError("counts differ")
    ends = np.append(offsets[1:], footer)
    held, have, block = [], 0, 0
    names = ids[: n_docs - nulls].tolist() + [None] * nulls
    for doc_id, n in zip(names, counts.tolist(), strict=True):
        while have < n:
            found = decode_block(view[int(offsets[block]) : int(ends[block])])
            held.append(found)
            have += len(found)
            block += 1
        flat = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, np.uint32)
        yield doc_id, flat[:n]
        held, have = [flat[n:]], have - n


class Encoder:
    """Encodes texts with a byte-level BPE tokenizer file, each distinct piece of a batch once.

    Such a tokenizer cuts a text by a pattern and encodes every part alone. No part reaches from a character that is
    not white space into white space, nor from an ASCII letter or digit into ASCII punctuation, so cutting there
    changes nothing. The pieces of a batch are cut in numpy and numbered by Arrow; new ones go through the library,
    many to a string with line ends between them, and the commonest are remembered as flat arrays of at most
    `remembered` bytes. Texts with white space outside ASCII or with a special token's string go to the library whole.
    """

    def __init__(self, path: str, special_as_text: bool = False, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([OTHER_SPACE, *map(re.escape, special)])
        self.remembered = remembered
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.keys, self.counts, self.ids = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of identifiers of each part, and all identifiers."""
        counts, ids = [], []
        for at in range(0, len(parts), CALL):
            for e in self.tokenizer.encode_batch_fast(parts[at : at + CALL], add_special_tokens=False):
                found = e.ids
                counts.append(len(found))
                ids.append(np.array(found, np.uint32))
        return np.array(counts, np.int64), np.concatenate(ids) if ids else np.zeros(0, np.uint32)

    def together(self, parts: list[str], leading: int) -> tuple[np.ndarray, np.ndarray]:
        """As library(), for parts whose only line ends are their first `leading` characters (0 or 1)."""
        if self.line is None:
            return self.library(parts)
        every = []
        groups = ["\n" * (1 - leading) + ("" if leading else "\n").join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        for at in range(0, len(groups), 64):
            every += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(groups[at : at + 64], add_special_tokens=False)]
        ids = np.concatenate(every)
        head = ids == self.line
        starts = np.nonzero(head)[0]
        if len(starts) != len(parts):
            raise ValueError("a part was joined to a line end")
        counts = np.diff(np.append(starts, len(ids)))
        return (counts, ids) if leading else (counts - 1, ids[~head])

    def new_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As library(), in the order of the pieces."""
        kinds: tuple[list, list, list] = ([], [], [])
        for n, p in enumerate(pieces):
            gap = len(p) - len(p.lstrip())
            kinds[2 if gap == len(p) or gap > 1 else 0 if gap == 0 or p[0] == 32 else 1 if p[0] == 10 else 2].append(n)
        order, counts, ids = [], [], []
        for kind, own in enumerate(kinds):
            if own:
                texts = [pieces[n].decode() for n in own]
                c, i = self.library(texts) if kind == 2 else self.together(texts, kind)
                order += own
                counts.append(c)
                ids.append(i)
        if not order:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        counts, ids = np.concatenate(counts), np.concatenate(ids)
        back = np.argsort(np.array(order), kind="stable")
        return counts[back], gathered(ids, counts, back)

    def table(self, distinct: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and identifiers of distinct pieces; remembers them as far as they fit."""
        at = pc.index_in(distinct, self.keys)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        new = np.nonzero(~known)[0]
        counts, ids = self.new_pieces(distinct.take(pa.array(new)).to_pylist())
        source = np.empty(len(distinct), np.int64)
        source[known] = at.drop_null().to_numpy(zero_copy_only=False)
        source[new] = len(self.counts) + np.arange(len(new))
        every, flat = np.concatenate((self.counts, counts)), np.concatenate((self.ids, ids))
        counts, ids = every[source], gathered(flat, every, source)
        self.remember(distinct, source, np.nonzero(often | known)[0], every, flat)
        return counts, ids

    def remember(self, distinct: pa.Array, source: np.ndarray, first: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Keeps the pieces numbered `first`, then those remembered before, then all others, as far as they fit."""
        rest = np.ones(len(distinct), bool)
        rest[first] = False
        old = np.ones(len(self.counts), bool)
        old[source[source < len(old)]] = False
        old = np.nonzero(old)[0]
        keys = pa.concat_arrays([distinct.take(pa.array(first)), self.keys.take(pa.array(old)), distinct.filter(pa.array(rest))])
        source = np.concatenate((source[first], old, source[rest]))
        sizes = np.diff(np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1)) + 4 * counts[source] + 16
        n = int(np.searchsorted(np.cumsum(sizes), self.remembered, side="right"))
        self.keys, self.counts, self.ids = keys.take(pa.array(np.arange(n))), counts[source[:n]], gathered(ids, counts, source[:n])

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts of identifiers of each text and all identifiers, of texts that the cuts suit."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        if offsets[-1] == offsets[0]:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        kind = KIND[np.frombuffer(data, np.uint8)]
        cut = np.zeros(len(kind) + 1, bool)
        cut[1:-1] = (kind[1:] == SPACE_BYTE) & (kind[:-1] != SPACE_BYTE) | (kind[1:] == PUNCTUATION) & (kind[:-1] == ALPHANUMERIC)
        cut[offsets] = True
        cuts = np.nonzero(cut)[0]
        totals, found = np.zeros(len(cuts), np.int64), []  # identifiers before each cut
        first = 0
        while first < len(cuts) - 1:
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + SEGMENT, side="right")) - 1)
            here = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(cuts[first : last + 1].astype(np.int32)), data])
            coded = here.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            counts, ids = self.table(coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)) > 1)
            found.append(gathered(ids, counts, codes))
            totals[first + 1 : last + 1] = totals[first] + np.cumsum(counts[codes])
            first = last
        return np.diff(totals[np.searchsorted(cuts, offsets)]), np.concatenate(found)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The identifiers of every text of a string array without nulls."""
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        parts = [self.segments(texts.filter(pa.array(~whole)) if whole.any() else texts), self.library(texts.filter(pa.array(whole)).to_pylist())]
        out: list = [None] * len(texts)
        for own, (counts, ids) in zip((np.nonzero(~whole)[0], np.nonzero(whole)[0]), parts, strict=True):
            for n, found in zip(own.tolist(), np.split(ids, np.cumsum(counts)[:-1]) if len(own) else [], strict=True):
                out[n] = found
        return out


def gathered(ids: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of ids, counts[k] long each, in another order, repeats included."""
    starts, lengths = (np.cumsum(counts) - counts)[order], counts[order]
    ends = np.cumsum(lengths)
    return ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, files: int | None = None, special_as_text: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all texts in ascending identifier order, null last; the manifest: name, docs, ids."""
    files = files or shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # of rows that share an identifier, or have none, those of other texts may go to other tasks
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def work(batches):
        cache = worker_cache("op9")
        key = (tokenizer, special_as_text)
        if cache.get("encoder", ("",))[0] != key:
            cache["encoder"] = (key, Encoder(*key))
        encoder, tail = cache["encoder"][1], np.array([end], np.uint32)

        def encoded():
            for batch in pieces(batches, SEGMENT):
                for doc_id, tokens in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                    yield doc_id, np.concatenate((tokens, tail))

        rest, part, number = encoded(), TaskContext.get().partitionId(), 0
        first = next(rest, None)
        while first is not None:
            name = f"tokens-{part:06d}-{number:06d}.pfor"
            out, place = target_file(folder, name)
            with out:
                n_docs, n_ids, ended = write_file(out, chain([first], rest), most=file_bytes)
            place()
            yield pa.RecordBatch.from_pylist([{"name": name, "docs": n_docs, "ids": n_ids}])
            first, number = None if ended else next(rest, None), number + 1
        give_back()  # the next stage's tasks run in the same worker

    manifest = rows.mapInArrow(work, "name string, docs long, ids long")
    return materialise(manifest, "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (null if not asked for) of every document, from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    offsets = manifest.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(offsets, "name")

    def work(batches):
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for doc_id, found in read_file(content.as_buffer()):
                    raw = found.astype("<u4").tobytes()
                    rows.append((doc_id, start, len(found), zlib.crc32(raw), raw if ids else None))
                    start += len(found)
                    size += len(raw) if ids else 64
                    if size > 8 << 20:
                        yield _decoded(rows)
                        rows, size = [], 0
                if rows:
                    yield _decoded(rows)

    return named.select("start", "content").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _decoded(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def token_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, ids: bool = True, special_as_text: bool = False) -> DataFrame:
    """Encodes, writes, reads back: one row for each input row with its identifiers, from the files.

    Null text counts as empty: only the end identifier. Rows without identifier stand behind all others, with a null
    doc_id; repeated identifiers stand side by side, in the order of a hash of their texts. An empty table writes no
    file and gives no rows. Other columns are not read. `tokenizer` is the path of a byte-level BPE file that every
    executor can read. The string of a special token in a text becomes that token, as the library has it; with
    special_as_text it is ordinary text.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    manifest = write_token_files(docs, folder, tokenizer, id_col, text_col, end, special_as_text=special_as_text)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return read_token_files(spark, folder, manifest, ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), ids=False)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
