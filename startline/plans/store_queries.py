"""Commits: batches that are handed on again, merges of a few buckets, writers that meet."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from startline.operators import commits, sketches, store
from startline.plans.roles import table
from startline.streaming import queue


def new_log(spark, name: str, **options) -> commits.TableLog:
    return commits.TableLog(spark, f"{store.shared_folder(spark)}/startline-{name}-{uuid.uuid4().hex}", **options)


def replayed_batches(spark, d):
    """Events by user from a stream in four batches, of which two end after their commit and are handed on again."""
    log = new_log(spark, "replayed", keys={"users": "user_id"}, buckets=8)
    source, checkpoint = f"{log.path}/in", f"{log.path}/stream"
    table(spark, d, "events").select("event_id", "user_id").repartition(4, "event_id").write.parquet(source)
    ends = {1, 3}

    def apply(batch, number):
        rows = store.settle(batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("events")))

        def work(base):
            touched = base.buckets_of("users", rows, "user_id")
            before = base.read("users", touched)
            after = rows if before is None else before.unionByName(rows).groupBy("user_id").agg(F.sum("events").alias("events"))
            return {"users": commits.Merge(after, touched), "audit": commits.Append(rows.withColumn("batch", F.lit(number)))}

        log.commit(work, commits.stream_id(spark, checkpoint), number)
        if number in ends:
            ends.remove(number)
            raise InterruptedError("ends between the commit and the stream's own note of it")

    while True:
        stream = spark.readStream.schema("event_id long, user_id long").option("maxFilesPerTrigger", 1).parquet(source)
        try:
            queue.upserts(stream, apply, checkpoint).awaitTermination()
            break
        except StreamingQueryException:
            if len(log.versions()) > 8:
                raise
    audited = log.read("audit").groupBy("user_id").agg(F.sum("events").alias("audited"))
    return log.read("users").join(audited, "user_id", "full")


def incremental_merge(spark, d):
    """Customers of which one in a hundred gets a new balance; whether exactly the buckets of these have new files."""
    log = new_log(spark, "merge", keys={"customers": "c_custkey"}, buckets=128)
    log.replace({"customers": table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")})
    first = log.snapshot()
    news = table(spark, d, "customer").where("c_custkey % 100 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    touched = first.buckets_of("customers", news, "c_custkey")

    def work(base):
        return {"customers": commits.Merge(store.upsert(base.read("customers", touched), news, "c_custkey", F.current_timestamp(), keep=(), touch=(), update=("c_acctbal",)), touched)}

    log.commit(work)
    last = log.snapshot()
    before, after = (s.manifest("customers")["files"] for s in (first, last))
    right = [(int(b), (before.get(b) == after.get(b)) == (int(b) not in touched)) for b in sorted(before.keys() | after.keys())]
    buckets = spark.createDataFrame(right, "bucket int, kept_right boolean")
    rows = last.read("customers").withColumn("bucket", commits.bucket_of(F.col("c_custkey"), 128))
    return rows.join(buckets, "bucket").select("c_custkey", "c_name", "c_acctbal", "kept_right")


def writers_meet(spark, d):
    """Two writers start from one version: the second works again on what the first left, and nothing is lost."""
    log = new_log(spark, "writers", keys={"suppliers": "s_suppkey"}, buckets=16)
    log.replace({"suppliers": table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")})

    def other(base):
        rows = base.read("suppliers")
        return {"suppliers": rows.withColumn("s_name", F.when(F.col("s_suppkey") % 2 == 1, F.lit("renamed")).otherwise(F.col("s_name"))), "audit": commits.Append(rows.limit(1).select(F.lit("other").alias("writer")))}

    met = []

    def work(base):
        if not met:
            met.append(log.commit(other))
        rows = base.read("suppliers").withColumn("s_acctbal", F.col("s_acctbal") + 1)
        return {"suppliers": rows, "audit": commits.Append(rows.limit(1).select(F.lit("own").alias("writer")))}

    log.commit(work)
    writers = ",".join(sorted(r["writer"] for r in log.read("audit").collect()))  # two rows
    return log.read("suppliers").withColumn("writers", F.lit(writers))


def merged_sketches(spark, d):
    """Distinct users and the median value of each kind of event, from daily sketches of three runs; how near they are."""
    e = table(spark, d, "events").select("event_type", "user_id", "value", F.to_date(F.col("ts").cast("timestamp")).alias("day"))
    log = new_log(spark, "sketches")
    for n in range(3):
        daily = sketches.sketched(e.where(F.pmod(F.unix_date("day"), F.lit(3)) == n), ["event_type", "day"], F.col("user_id"), F.col("value"))
        log.commit(lambda base, daily=daily: {"daily": commits.Append(daily)}, "sketches", n)
    found = sketches.estimates(sketches.merged(log.read("daily"), ["event_type"]), {"median": 0.5})
    exact = e.join(found, "event_type").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.max("n").alias("n"), F.max("distinct_estimate").alias("estimate"), (F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("rank")
    )
    near = F.abs(F.col("estimate") - F.col("users")) <= 0.02 * F.col("users")
    return exact.select("event_type", "n", "users", near.alias("users_near"), F.col("rank").between(0.48, 0.52).alias("median_near"))


QUERIES = {
    "merged_sketches": (merged_sketches, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY event_type"),
    "replayed_batches": (replayed_batches, "SELECT user_id, count(*) AS events, count(*) AS audited FROM events GROUP BY user_id"),
    "incremental_merge": (incremental_merge, "SELECT c_custkey, c_name, CASE WHEN c_custkey % 100 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, true AS kept_right FROM customer"),
    "writers_meet": (writers_meet, "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN 'renamed' ELSE s_name END AS s_name, s_acctbal + 1 AS s_acctbal, 'other,own' AS writers FROM supplier"),
}
