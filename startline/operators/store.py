"""Tables as snapshots: upserts, child sets, dimensions, schema growth, swaps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from startline.functions.text import canonical_category, coerce_sport, race_label, slugify


def upsert(stored: DataFrame, incoming: DataFrame, key: str, now: Column, keep: tuple[str, ...] = ("first_seen_at",), touch: tuple[str, ...] = ("last_seen_at", "last_crawled_at"), order: str | None = None, update: tuple[str, ...] | None = None) -> DataFrame:
    """The new snapshot of stored: incoming rows overwrite by key, kept columns stay as first set, touched ones are now.

    Of incoming rows with one key the last by `order` holds. With update only those columns change in stored rows.
    Columns that one side lacks are null there.
    """
    if order is not None:
        best = Window.partitionBy(key).orderBy(F.col(order).desc())
        incoming = incoming.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", order)
    stamped = incoming.withColumns({c: now for c in (*keep, *touch) if c in stored.columns})
    names = list(dict.fromkeys([*stored.columns, *stamped.columns]))
    old, new = stored.alias("o"), stamped.withColumn("_here", F.lit(True)).alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    here, there = F.coalesce(F.col("n._here"), F.lit(False)), F.col(f"o.{key}").isNotNull()

    def value(c):
        if c not in stored.columns:
            return F.col(f"n.{c}")
        if c not in stamped.columns:
            return F.col(f"o.{c}")
        if c == key:
            return F.coalesce(f"o.{c}", f"n.{c}")
        if c in keep or (update is not None and c not in update):
            return F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[value(c).alias(c) for c in names])


def replace_children(children: DataFrame, touched: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of untouched parents and the incoming ones; a touched parent without incoming children has none."""
    return children.join(touched.select(parent).distinct(), parent, "left_anti").unionByName(incoming, allowMissingColumns=True)


def numbered(rows: DataFrame, array: str, parent: str) -> DataFrame:
    """One row for each element of an array of structs, with its position as sort_order."""
    return rows.select(parent, F.posexplode(array).alias("sort_order", "e")).select(parent, "sort_order", "e.*")


def occurrence_rows(events: DataFrame, parent: str = "url") -> DataFrame:
    """Children of events with occurrences: undated ones dropped, one for each start, the first of a start kept."""
    from startline.functions.dates import moment

    rows = numbered(events, "occurrences", parent).withColumn("starts_at", moment(F.col("date_iso"), F.col("time_24h"))).where("starts_at IS NOT NULL")
    first = Window.partitionBy(parent, "starts_at").orderBy("sort_order")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(parent, "sort_order", "starts_at", "date_text", "time_text", "price_text")


def race_types(distances: DataFrame, stored: DataFrame | None = None, sport: str = "sport", category: str = "distance_category") -> DataFrame:
    """label, sport, distance_category: the stored dimension and the labels that distances add."""
    found = distances.select(
        race_label(F.col(sport), F.col(category)).alias("label"), coerce_sport(F.col(sport)).alias("sport"), canonical_category(slugify(F.col(category))).alias("distance_category")
    ).where("label IS NOT NULL").distinct()
    if stored is None:
        return found
    return stored.select("label", "sport", "distance_category").unionByName(found.join(stored.select("label"), "label", "left_anti"))


def umbrella_organiser(organisers: DataFrame, name: str, homepage_url: str, discovered_via: str) -> DataFrame:
    """organisers with one of that name, of type platform: the stored one changed to it, or a new row."""
    changed = organisers.withColumn("source_type", F.when(F.col("name") == name, F.lit("platform")).otherwise(F.col("source_type")))
    spark = organisers.sparkSession
    row = spark.createDataFrame([(name, homepage_url, discovered_via, "platform")], "name string, homepage_url string, discovered_via string, source_type string")
    return changed.unionByName(row.join(organisers.select("name"), "name", "left_anti"), allowMissingColumns=True)


def sync_seed(organisers: DataFrame, seed: DataFrame, line: str | None = None) -> DataFrame:
    """New seed rows by homepage_url; of stored organisers only handler_params and registrator follow the seed.

    Of seed rows with one homepage the first makes the row and the last sets what is synced, in the order of the
    column `line`, which is dropped, else as the rows lie in the seed's file.
    """
    numbered_seed = seed.withColumn("_n", F.monotonically_increasing_id()) if line is None else seed.withColumnRenamed(line, "_n")
    first = Window.partitionBy("homepage_url").orderBy("_n")
    last = Window.partitionBy("homepage_url").orderBy(F.col("_n").desc())
    synced = {c: F.first_value(c).over(last) for c in ("handler_params", "registrator")}
    once = numbered_seed.withColumns({**synced, "_k": F.row_number().over(first)}).where("_k = 1").drop("_k", "_n", "sitemap_url")
    return upsert(organisers, once, "homepage_url", F.current_timestamp(), keep=(), touch=(), update=("handler_params", "registrator"))


def latest(history: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with first_seen, the earliest. Rows are aggregated where they lie; no key is a task."""
    best = history.groupBy(key).agg(F.max_by(F.struct(*history.columns), F.struct(order)).alias("_last"), F.min(order).alias("first_seen"))
    return best.select("_last.*", "first_seen")


def grow_schema(rows: DataFrame, wanted: T.StructType, defaults: dict[str, object] | None = None) -> tuple[DataFrame, list[str]]:
    """rows with the wanted columns they lack, and the names of those left out.

    A missing column is added if it may be null or has a default, which also fills stored rows; columns are never
    dropped or changed.
    """
    defaults, left_out = defaults or {}, []
    for f in wanted.fields:
        if f.name in rows.columns:
            continue
        if f.name in defaults or f.nullable:
            rows = rows.withColumn(f.name, F.lit(defaults.get(f.name)).cast(f.dataType))
        else:
            left_out.append(f.name)
    return rows, left_out


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster shares; a temporary one only in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = root or tempfile.mkdtemp(prefix="startline-")
        sc.setCheckpointDir(root)
    return (root or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def settle(rows: DataFrame) -> DataFrame:
    """rows computed once into the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all cores by keys, for a step that costs far more than its small file's few row groups show."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream has now, written to a new place in the shared folder by its own query; the driver holds none of it."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/startline-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


class SnapshotTable:
    """A table whose readers see whole snapshots: each is written beside the others, then a pointer file is replaced.

    A write that fails leaves the pointer as it was; readers keep the snapshot that they opened.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        pointer = self._path(f"{self.path}/current.txt")
        return self.spark.read.text(pointer.toString()).first()[0] if self._fs.exists(pointer) else None

    def read(self) -> DataFrame | None:
        now = self._current()
        return None if now is None else self.spark.read.parquet(f"{self.path}/{now}")

    def replace(self, rows: DataFrame) -> None:
        name = f"snapshot-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        self.point(name)

    def point(self, text: str) -> None:
        """Replaces the pointer file in one step."""
        draft, pointer = self._path(f"{self.path}/draft-{uuid.uuid4().hex}"), self._path(f"{self.path}/current.txt")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        modes = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        modes[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(draft, pointer, modes)
