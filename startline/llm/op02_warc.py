"""WARC archives in Zstandard frames: a writer that turns repeated payloads into revisit records, and a reader.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then every record is one frame,
so a record is found and decoded without the others. The reader streams a file: it loads the dictionary from the file
itself, decodes one frame at a time and checks version line, headers and lengths, and digests where they are stated.
It holds one record and a few hundred kilobytes of the file, however long that is. A writer begins a new file whenever
one has grown over FILE_BYTES.

Which record of equal payloads is the response is settled before writing by a grouping on the payload's SHA-1,
length and a second hash, salted so that one payload on a third of all pages is dealt over many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.llm.common import byte_values, pieces, salt_of, scratch, shared_files, target_file

FRAME, SKIPPABLE = b"\x28\xb5\x2f\xfd", 0x184D2A50
FILE_BYTES = 64 << 20
DICTIONARY_MAGIC, DICTIONARY, SAMPLE, SAMPLE_BYTES, LEVEL, SALTS = 0x184D2A5D, 32 << 10, 200, 32 << 10, 3, 64
DATE = "2024-01-01T00:00:00Z"
PAGE = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(rb"[\x00-\x20\x7f]")


class WarcError(ValueError):
    """A file or record that is not as it should be."""


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, headers: dict[str, str], content_type: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items()]
    lines += [f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id, url: bytes | None, payload: bytes, response_id) -> bytes:
    """A response, or a revisit of response_id if that is another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {} if url is None else {"WARC-Target-URI": CONTROL.sub(lambda m: b"%%%02X" % m[0][0], url).decode("utf-8", "replace")}
    headers["WARC-Payload-Digest"] = f"sha1:{digest_of(payload)}"
    if response_id is None or response_id == page_id:
        return record("response", f"{PAGE}{page_id}", http + payload, headers, "application/http; msgtype=response")
    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{PAGE}{response_id}>"}
    return record("revisit", f"{PAGE}{page_id}", http, headers, "application/http; msgtype=response")


class Source:
    """Bytes of a file, some ahead of what has been used."""

    def __init__(self, stream, chunk: int = 256 << 10):
        self.stream, self.chunk, self.held = stream, chunk, b""

    def ahead(self, n: int) -> bytes:
        """The next n bytes, or all that are left, without using them."""
        while len(self.held) < n and (more := self.stream.read(max(self.chunk, n - len(self.held)))):
            self.held += bytes(more)
        return self.held[:n]

    def take(self, n: int, what: str) -> bytes:
        found = self.ahead(n)
        if len(found) < n:
            raise WarcError(f"{what} is cut short")
        self.held = self.held[n:]
        return found

    def skip(self, n: int) -> None:
        """Passes over n bytes, some at a time."""
        while n:
            n -= len(self.take(min(n, self.chunk), "a skippable frame"))


def one_frame(source: Source, tool) -> bytes:
    """The content of the frame that starts here; its size need not be stated."""
    out, decoder = [], tool.decompressobj()
    try:
        while not decoder.eof:
            if not source.ahead(1):
                raise WarcError("a frame is cut short")
            held, source.held = source.held, b""
            out.append(decoder.decompress(held))
    except zstandard.ZstdError as e:
        raise WarcError(f"a frame does not decode: {e}") from e
    source.held = decoder.unused_data + source.held
    return b"".join(out)


def frames(stream):
    """Each decoded record of an archive, by the dictionary of its leading skippable frame if it has one."""
    source, words = Source(stream), b""
    if not source.ahead(1):
        raise WarcError("an empty file")
    magic, size = struct.unpack("<II", source.ahead(8).ljust(8, b"\0"))
    if magic == DICTIONARY_MAGIC:
        source.take(8, "the dictionary")
        words = source.take(size, "the dictionary")
        if words[:4] == FRAME:  # the dictionary itself may be compressed
            words = one_frame(Source(io.BytesIO(words)), zstandard.ZstdDecompressor())
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    while head := source.ahead(8):
        if SKIPPABLE <= int.from_bytes(head[:4], "little") < SKIPPABLE + 16:
            source.skip(int.from_bytes(source.take(8, "a skippable frame")[4:], "little"))
        elif head[:4] != FRAME:
            raise WarcError("not a Zstandard frame")
        else:
            yield one_frame(source, tool)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record that fills data exactly."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#-'*+.^-z|~0-9A-Z-]+", name):
            raise WarcError(f"not a header: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the length is not as stated")
    block = rest[:-4]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != digest_of(block):
        raise WarcError("the block digest differs")
    return headers, block


def parse_page(headers: dict[str, str], block: bytes) -> dict | None:
    """The page of a response or revisit record of HTTP, None for other records.

    Digests and the length of the body are optional: they are checked where they are stated, but not against a
    transfer coding or a record that says it is cut off. A record identifier that is no page's gives a null page_id.
    """
    kind = headers["warc-type"]
    if kind not in ("response", "revisit") or not block.startswith(b"HTTP/"):
        return None
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap and kind == "response":
        raise WarcError("no HTTP headers")
    stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    coded = re.search(rb"(?im)^transfer-encoding:", http) or "warc-truncated" in headers
    digest = headers.get("warc-payload-digest", "")
    if kind == "response":
        if stated and not coded and len(payload) != int(stated[1]):
            raise WarcError("the payload's length is not as stated")
        own = digest_of(payload)
        if digest.startswith("sha1:") and not coded and digest[5:] != own:
            raise WarcError("the payload's digest is not as stated")
        size, digest = len(payload), own
    else:
        if payload:
            raise WarcError("a revisit has a payload")
        size, digest = int(stated[1]) if stated else None, digest[5:] if digest.startswith("sha1:") else None
    number = lambda x: int(x) if re.fullmatch(r"-?\d+", x := x.strip("<>").removeprefix(PAGE)) else None
    return {
        "page_id": number(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(headers.get("warc-refers-to", "")) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def train_dictionary(pages: DataFrame, html_col: str, size: int = DICTIONARY, sample: int = SAMPLE) -> bytes:
    """A dictionary from the beginnings of about `sample` pages; it only affects the size of the files."""
    n = pages.count()
    draw = F.pmod(F.xxhash64(F.lit(2), html_col), F.lit(1 << 30)) / float(1 << 30)
    texts = pages.where(draw < sample / max(1, n)).select(F.substring(html_col, 1, SAMPLE_BYTES).alias("t")).limit(4 * sample).collect()
    texts = [r["t"].encode() for r in texts if r["t"]]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b"".join(texts)[:size] if sum(map(len, texts)) > 64 else b""


def responses(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """page_id, url, html and response_id: the largest page_id of its payload, or its own if that is too small."""
    key = ["digest", "size", "second", "salt"]
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        html.alias("html"),
        F.unhex(F.sha1(html)).alias("digest"),
        F.octet_length(html).alias("size"),
        F.xxhash64(html).alias("second"),
        salt_of(F.col(id_col), salts=SALTS).alias("salt"),
    )
    part = rows.groupBy(*key).agg(F.max("page_id").alias("most"))
    root = part.groupBy(*key[:3]).agg(F.max("most").alias("response_id"))
    back = part.select(*key).join(root, key[:3])
    return rows.join(back.hint("shuffle_hash"), key).select("page_id", "url", "html", F.when(F.col("size") >= least, F.col("response_id")).otherwise(F.col("page_id")).alias("response_id"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one or more files for each partition; the manifest: name, records, bytes.

    A file's name holds the task's attempt, and the manifest in the folder, which Spark commits, names the files of
    the attempts that ended well. What a lost or repeated attempt, or an earlier write, has left is in no manifest and
    is not read. Null html is an empty payload. Pages without identifier are responses of identifier `None`, read back as null;
    rows that repeat the largest identifier of a payload are all responses. An empty table writes no file.
    """
    words = train_dictionary(pages, html_col)

    def work(batches):
        table = zstandard.ZstdCompressionDict(words) if words else None
        if table:
            table.precompute_compress(level=LEVEL)
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=table, write_checksum=True, write_content_size=True)

        def records():
            for batch in pieces(batches, 8 << 20):
                for page_id, url, html, response_id in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), byte_values(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    yield tool.compress(page_record(page_id, url, html, response_id))

        rest, part, attempt, number = records(), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        now = next(rest, None)
        while now is not None:
            name = f"pages-{part:06d}-{attempt}-{number:06d}.warc.zst"
            head = struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words
            head += tool.compress(record("warcinfo", f"urn:x-file:{name}", b"format: WARC File Format 1.1\r\n", {"WARC-Filename": name}, "application/warc-fields"))
            out, place = target_file(folder, name)
            size, n = len(head), 0
            with out:
                out.write(head)
                while now is not None and (n == 0 or size + len(now) <= file_bytes):
                    out.write(now)
                    size, n, now = size + len(now), n + 1, next(rest, None)
            place()
            number += 1
            yield pa.RecordBatch.from_pylist([{"name": name, "records": n, "bytes": size}])

    rows = responses(pages, id_col, url_col, html_col, least)
    rows.mapInArrow(work, MANIFEST).write.mode("overwrite").parquet(f"{folder}/{MANIFEST_FOLDER}")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/{MANIFEST_FOLDER}")


MANIFEST, MANIFEST_FOLDER = "name string, records long, bytes long", "_manifest"
FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every response and revisit of the archives in a folder; raises WarcError on a file that is not whole.

    With a manifest in the folder, its files are read, and one that is missing is an error; else all archives are.

    Each task streams its files from the folder. With payloads=False the payload column is null; records are decoded
    and checked all the same.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")
    manifest = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST_FOLDER}/_SUCCESS")
    if manifest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(manifest):
        named = spark.read.schema(MANIFEST).parquet(f"{folder}/{MANIFEST_FOLDER}").select("name")
        found = files.select("path", F.substring_index("path", "/", -1).alias("name"))
        files = named.join(found, "name", "left").select(F.coalesce("path", F.raise_error(F.concat(F.lit("WarcError: missing "), "name"))).alias("path"))

    def work(batches):
        for path in chain.from_iterable(batch.column(0).to_pylist() for batch in batches):
            fs, at = shared_files(path)
            rows, size = [], 0
            with fs.open_input_stream(at, compression=None) as stream:
                for data in frames(stream):
                    page = parse_page(*parse_record(data))
                    if page:
                        if payloads:
                            size += len(page["payload"] or b"")
                        else:
                            page["payload"] = None
                        rows.append(page)
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, FIELDS)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, FIELDS)

    return files.mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder, payloads=False).drop("url", "payload")


SQL = r"""
WITH b AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), g AS (
  SELECT payload, max(page_id) AS response_id FROM b GROUP BY payload
), d AS (
  SELECT page_id, strlen(payload) AS payload_bytes, response_id, sha1(payload) AS hex FROM b JOIN g USING (payload)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       -- five hexadecimal digits are four of base 32
       array_to_string(list_transform(range(0, 32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN response_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response_id = page_id THEN NULL ELSE response_id END AS refers_to
FROM d
"""
