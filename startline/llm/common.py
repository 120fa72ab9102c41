"""What the training-data operators share: shared storage, byte tokenisation and skew-safe lookups."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ASCII white space of the contracts: [\x20\x09-\x0D]. bytes.split() splits on exactly these.
SPACE = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        now = sc._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="startline-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/startline-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove():
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(remove)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt_of(*cols: Column | str, salts: int) -> Column:
    return F.pmod(F.hash(*cols), F.lit(salts))


def with_least(df: DataFrame, key: str, value: str, name: str, spread: str | None = None, salts: int = 64) -> DataFrame:
    """df, which should be stored, with the least `value` of each `key` as `name`.

    Rows of one key are dealt as `salts` keys by a hash of `spread` (else of value), and so is the answer: a key on a
    third of all rows is never one task.
    """
    rows = df.withColumn("_salt", salt_of(spread or value, salts=salts))
    part = rows.groupBy(key, "_salt").agg(F.min(value).alias("_least"))
    back = part.select(key, "_salt").join(part.groupBy(key).agg(F.min("_least").alias(name)), key)
    return rows.join(back, [key, "_salt"]).drop("_salt")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df and, under each name, the sum of an expression over all rows before a row in the given order, 0 for the first.

    Rows are dealt to ranges of the order and summed there; only a row for each range goes through one task.
    """
    ranged = materialise(df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(*[F.sum(e).alias(f"_{n}") for n, e in sums.items()])
    starts = starts.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    rows = ranged.withColumns({n: F.coalesce(F.sum(e).over(before), F.lit(0)) for n, e in sums.items()})
    rows = rows.join(F.broadcast(starts), "_range")  # a row for each range
    return rows.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def schema_of(df: DataFrame, column: str, rest: str) -> T.StructType:
    """The field of a column of df, whatever its type, followed by the fields of a DDL string."""
    return T.StructType([df.schema[column], *T.StructType.fromDDL(rest).fields])


def byte_values(column: pa.Array) -> list:
    """The rows of a string column as bytes, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def coded_words(buffer: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Where the words of a text begin and end, and the words themselves, each distinct one once.

    The text ends with a space; space says which bytes separate words.
    """
    edge = np.diff(np.concatenate(([False], ~space)).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buffer[~space]))])
    return starts, ends, words.dictionary_encode()


def pieces(batches, most_bytes: int):
    """Cuts record batches so that each piece has about most_bytes at most; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row = max(1, int(most_bytes / max(1, batch.nbytes / batch.num_rows)))
        sizes = _row_sizes(batch)
        if sizes is None:
            for at in range(0, batch.num_rows, row):
                yield batch.slice(at, row)
            continue
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def _row_sizes(batch):
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            offsets = np.frombuffer(column.buffers()[1], np.int32, batch.num_rows + 1 + column.offset)[column.offset :]
            return np.diff(offsets)
        if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            offsets = np.frombuffer(column.buffers()[1], np.int64, batch.num_rows + 1 + column.offset)[column.offset :]
            return np.diff(offsets)
    return None


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker, whatever functions it is sent.

    It belongs to one operator at a time: what another one left there is let go, and its memory given back.
    """
    import sys
    import types

    found = sys.modules.setdefault("_startline_worker", types.ModuleType("_startline_worker")).__dict__
    if found.get("owner") != owner:
        for name in [k for k in found if not k.startswith("__")]:
            del found[name]
        found["owner"] = owner
        give_back()
    return found


def give_back() -> None:
    """Returns freed memory of this worker to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def shared_files(folder: str):
    """(file system, path) of a folder that executors share."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def target_file(folder: str, name: str):
    """Opens a new file in a folder that executors share; (stream, function that puts it in place)."""
    fs, path = shared_files(folder)
    fs.create_dir(path, recursive=True)
    context = TaskContext.get()
    draft = f"{path}/_draft-{name}-{context.taskAttemptId() if context else 0}"
    return fs.open_output_stream(draft), lambda: fs.move(draft, f"{path}/{name}")
