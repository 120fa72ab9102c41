"""Readers that call providers, and streams that keep time."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from startline.functions import urls
from startline.operators import runs, store
from startline.plans.crawl_queries import QUERIES as CRAWL
from startline.plans.roles import table
from startline.sources import providers
from startline.streaming import queue


def slow_site(request: dict, n: int) -> dict | None:
    """A stub that has an answer only after some tries, or never."""
    if request["page_id"] % 5 > n:
        raise TimeoutError("no answer yet")
    return {"markdown": request["body"], "size": len(request["body"])}


def provider_read(spark, d):
    """Pages of a provider that fails at first, read by site with three tries, joined as the lookup is."""
    pages = table(spark, d, "pages")
    asked = pages.select("page_id", F.col("page_id").cast("string").alias("key"), F.coalesce(urls.site_root(F.col("url")), F.lit("")).alias("site"), F.lit(1.0).alias("delay"), F.col("html").alias("body"))
    got = providers.answers(asked, providers.source("slow_site", slow_site, "markdown string, size long", scale=0.0))
    return pages.select("page_id", F.col("page_id").cast("string").alias("key")).join(got, "key", "left").select("page_id", "size", F.md5("markdown").alias("digest"), "tries")


def pacing_stream(spark, d):
    """Crawl pacing by state and timers: requests in the order of their days, a third of all in each micro-batch."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("site"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("arrival"), ((F.col("user_id") % 4) * 20).cast("double").alias("delay"))
    first, last = e.agg(F.min("arrival"), F.max("arrival")).first()
    folder, parts, files = f"{store.shared_folder(spark)}/startline-paced-{uuid.uuid4().hex}", 3, 8
    span = (last - first).total_seconds() / parts + 1
    number = F.floor((F.unix_seconds("arrival") - F.unix_seconds(F.lit(first))) / span)
    for n in range(parts):
        e.where(number == n).repartition(files).write.mode("append").parquet(folder)
    # a beat long after all requests lets the last of them go
    e.limit(1).select(F.lit(0).cast("long").alias("id"), F.lit(-1).cast(e.schema["site"].dataType).alias("site"), (F.lit(last) + F.expr("INTERVAL 1000 DAYS")).alias("arrival"), F.lit(1.0).alias("delay")).write.mode("append").parquet(folder)
    with queue.with_state(spark):
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(folder)
        got = store.drained(queue.paced(stream, f"{int(span) + 1} seconds"), "paced")
    return got.where("site >= 0").select(F.col("id").alias("event_id"), "starts")


def crawls(spark, d):
    """Organisers' crawls and events that follow them, on one clock."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("site"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return e.where("event_id % 5 = 0"), e.where("event_id % 5 <> 0")


def last_crawl(spark, d):
    """Each event with the last crawl of its site that is not after it."""
    asked, events = crawls(spark, d)
    return runs.as_of_join(events, asked, "site", "at", tie="event_id").select("event_id", F.col("found.event_id").alias("crawl_id"))


def open_seasons(spark, d):
    """Dates of orders within the seasons of their customer, each pair once."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("organiser_id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    seasons = o.where("o_orderkey % 4 = 0").select("organiser_id", F.col("o_orderkey").alias("season"), F.col("day").alias("opens"), (F.col("day") + F.col("o_orderkey") % 200).alias("closes"))
    return runs.within(o, seasons, "day", "opens", "closes", 90.0, ["organiser_id"]).select("o_orderkey", "season")


def event_sessions(spark, d):
    """Sessions of users from a stream in several micro-batches; a beat after all rows closes the last ones."""
    e = table(spark, d, "events").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("at"))
    folder, (last,) = f"{store.shared_folder(spark)}/startline-sessions-{uuid.uuid4().hex}", e.agg(F.max("at")).first()
    e.repartition(6).write.parquet(folder)
    beat = e.limit(1).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), (F.lit(last) + F.expr("INTERVAL 4000 DAYS")).alias("at"))
    beat.write.mode("append").parquet(folder)
    beat.withColumn("at", F.col("at") + F.expr("INTERVAL 4000 DAYS")).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return store.drained(queue.sessions(stream, "user_id", "at", "6 hours", "3000 days"), "sessions").where("user_id >= 0")


QUERIES = {
    "last_crawl": (
        last_crawl,
        """WITH e AS (SELECT event_id, user_id, ts FROM events)
SELECT a.event_id, (SELECT arg_max(b.event_id, (b.ts, b.event_id)) FROM e b WHERE b.user_id = a.user_id AND b.event_id % 5 = 0 AND b.ts <= a.ts) AS crawl_id FROM e a WHERE a.event_id % 5 <> 0""",
    ),
    "open_seasons": (
        open_seasons,
        """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT a.o_orderkey, s.o_orderkey AS season FROM o a JOIN o s USING (o_custkey) WHERE s.o_orderkey % 4 = 0 AND a.day >= s.day AND a.day < s.day + CAST(s.o_orderkey % 200 AS INTEGER)""",
    ),
    "event_sessions": (
        event_sessions,
        """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 6 HOURS AS ends, count(*) AS n FROM s GROUP BY user_id, k""",
    ),
    "provider_read": (
        provider_read,
        "SELECT page_id, CASE WHEN page_id % 5 < 3 THEN length(html) END AS size, CASE WHEN page_id % 5 < 3 THEN md5(html) END AS digest, CASE WHEN page_id % 5 < 3 THEN CAST(page_id % 5 + 1 AS INTEGER) END AS tries FROM pages",
    ),
    "pacing_stream": (pacing_stream, CRAWL["crawl_pacing"][1]),
}
