"""Live providers as data sources: calls are made by Spark's readers, paced by site and tried again.

A provider is a function from a request (a dictionary of its columns) and the number of the try to a dictionary of the
answer's columns, or None if there is no answer; what it raises counts as a failed try. source() makes it a format that
Spark reads, as a batch or as a stream. Requests lie in a folder, dealt by site, so that a site is one partition, whose
reader keeps the site's delay between its calls; sites are many, and a delay is what bounds a site, not a task. The
columns of an answer are those of the lookup tables, so either can be used for the other.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from startline.operators import store

Provider = Callable[[dict, int], dict | None]
#: Seconds that a site's delay is at most; partitions of a batch of requests.
DELAY_CAP, PARTITIONS = 30.0, 64
#: A failed try waits, doubled each time.
TRIES, LEAST_WAIT, MOST_WAIT = 3, 2.0, 30.0
SITE = "_part"


@dataclass
class Share(InputPartition):
    """The files of one part of a batch of requests."""

    files: list[str]


def folder_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def shares(path: str) -> list[Share]:
    """The parts of a written batch of requests."""
    fs, root = folder_of(path)
    found: dict[str, list[str]] = {}
    for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
        if f.is_file and f.path.endswith(".parquet"):
            found.setdefault(f.path.rpartition("/")[0], []).append(f.path)
    return [Share(files) for _, files in sorted(found.items())]


def call(provider: Provider, request: dict, tries: int, wait: Callable[[float], None]) -> tuple[dict | None, int]:
    """The answer to a request and how many tries were made; none if no try had one."""
    pause = LEAST_WAIT
    for n in range(tries):
        try:
            found = provider(request, n)
        except Exception:  # noqa: BLE001 - whatever a provider raises is a failed call, as a lookup's missing row is
            found = None
        if found is not None:
            return found, n + 1
        if n + 1 < tries:
            wait(pause)
            pause = min(MOST_WAIT, pause * 2)
    return None, tries


def calls(provider: Provider, path: str, share: Share, columns: list[str], tries: int, scale: float) -> Iterator[tuple]:
    """Answers to the requests of a part, a site behind another; key, columns and tries of those that have one."""
    fs, _ = folder_of(path)
    last: dict[object, float] = {}

    def wait(seconds: float) -> None:
        if seconds > 0:
            time.sleep(seconds * scale)

    for file in share.files:
        with fs.open_input_file(file) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(batch_size=1024):
                for request in batch.to_pylist():
                    site, gap = request["site"], min(request.get("delay") or 0.0, DELAY_CAP)
                    if site in last:
                        wait(last[site] + gap - time.monotonic() if scale == 1 else gap)
                    last[site] = time.monotonic()
                    found, made = call(provider, request, tries, wait)
                    if found is not None:
                        yield (request["key"], *[found.get(c) for c in columns], made)


def source(name: str, provider: Provider, columns: str, tries: int = TRIES, scale: float = 1.0) -> type[DataSource]:
    """A data source of that name: rows of key (string), the answer's columns (DDL) and tries (int).

    Its option `requests` names a folder that requested() wrote, or for a stream a folder of such folders, read in the
    order of their names. Every wait is multiplied by `scale`.
    """

    class Reader(DataSourceReader):
        def __init__(self, schema, options):
            self.path, self.columns = options["requests"], schema.names[1:-1]

        def partitions(self):
            return shares(self.path)

        def read(self, partition):
            return calls(provider, self.path, partition, self.columns, tries, scale)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, schema, options):
            self.path, self.columns = options["requests"], schema.names[1:-1]

        def _batches(self) -> list[str]:
            fs, root = folder_of(self.path)
            found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
            return sorted(f.base_name for f in found if not f.is_file and fs.get_file_info(f"{f.path}/_SUCCESS").type != pyarrow.fs.FileType.NotFound)

        def initialOffset(self):
            return {"last": ""}

        def latestOffset(self):
            return {"last": max(self._batches(), default="")}

        def partitions(self, start, end):
            new = [b for b in self._batches() if start["last"] < b <= end["last"]]
            return [s for b in new for s in shares(f"{self.path}/{b}")]

        def read(self, partition):
            return calls(provider, self.path, partition, self.columns, tries, scale)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"key string, {columns}, tries int"

        def reader(self, schema):
            return Reader(schema, self.options)

        def streamReader(self, schema):
            return StreamReader(schema, self.options)

    return Source


def requested(requests: DataFrame, path: str, partitions: int = PARTITIONS) -> str:
    """Writes requests (key, site, delay and whatever a provider reads) dealt by site; rows without a key are left out."""
    rows = requests.where("key IS NOT NULL").withColumn(SITE, F.pmod(F.xxhash64("site"), F.lit(partitions)))
    rows.repartition(SITE).sortWithinPartitions(SITE, "site", "key").write.partitionBy(SITE).parquet(path)
    return path


def answers(requests: DataFrame, made: type[DataSource]) -> DataFrame:
    """What a provider answers to requests, called once: the rows are settled."""
    spark: SparkSession = requests.sparkSession
    spark.dataSource.register(made)
    path = requested(requests, f"{store.shared_folder(spark)}/startline-requests-{uuid.uuid4().hex}")
    return store.settle(spark.read.format(made.name()).option("requests", path).load())


def http_provider(timeout: float = 60.0, agent: str = "startline", most_bytes: int = 16 << 20) -> Provider:
    """Fetches a request's key as an address: html, status and final_url of a page of up to most_bytes."""

    def fetch(request: dict, _: int) -> dict | None:
        import urllib.request

        asked = urllib.request.Request(request["key"], headers={"User-Agent": agent})
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            return {"html": answer.read(most_bytes).decode("utf-8", "replace"), "status": answer.status, "final_url": answer.url}

    return fetch


def json_provider(url: str, timeout: float = 60.0) -> Provider:
    """Posts a request's columns as JSON to an address and reads the answer's text, as a model's endpoint takes them."""

    def ask(request: dict, _: int) -> dict | None:
        import urllib.request

        asked = urllib.request.Request(url, data=json.dumps(request, default=str).encode(), headers={"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            return {"answer": answer.read().decode("utf-8", "replace")}

    return ask
