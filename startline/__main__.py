"""python -m startline COMMAND: the engine's jobs over tables in a folder.

Tables are Parquet folders under --tables: events, distances, occurrences, race_types, organisers, runs, committed
together; lookups are pages, probes, robots, answers, places, views (of listings) and sitemaps.
"""

from __future__ import annotations

import argparse
import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startline.functions.text import sitemap_directive
from startline.functions.urls import robots_url
from startline.operators import commits, decide, feed, report, store
from startline.plans import crawl as plans
from startline.plans import discovery
from startline.sources import files, lookups
from startline.streaming import queue

ORGANISER = "id long, name string, listing_urls array<string>, homepage_url string, discovered_via string, handler string, handler_params map<string,string>, registrator string, source_type string, active boolean"
SCHEMAS = {"events": plans.EVENT, "distances": plans.DISTANCE, "occurrences": plans.OCCURRENCE, "race_types": plans.RACE_TYPE, "organisers": ORGANISER, "runs": plans.RUN}
LOOKUPS = {"pages": lookups.PAGES, "probes": lookups.PROBES, "robots": lookups.ROBOTS, "answers": lookups.ANSWERS, "places": lookups.PLACES, "views": lookups.VIEWS, "sitemaps": lookups.SITEMAPS}


#: The tables that are dealt in buckets, by their column; a crawl rewrites the buckets of the addresses that it asks for.
KEYS = {"events": "url", "distances": "url", "occurrences": "url"}


def log_of(spark: SparkSession, folder: str) -> commits.TableLog:
    return commits.TableLog(spark, folder, KEYS)


def own(spark: SparkSession, now: commits.Snapshot, name: str, buckets: list[int] | None = None) -> DataFrame:
    """A table of a version, or some buckets of it; an empty one before it is first written."""
    found = now.read(name, buckets)
    return found if found is not None else spark.createDataFrame([], SCHEMAS[name])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return own(spark, log_of(spark, folder).snapshot(), name)


def save(spark: SparkSession, folder: str, **tables: DataFrame) -> None:
    """Whole tables, in one commit."""
    log_of(spark, folder).replace(tables)


def tables_of(spark, now: commits.Snapshot) -> plans.Tables:
    return plans.Tables(*(own(spark, now, n) for n in ("events", "distances", "occurrences", "race_types")))


def merged(spark, now: commits.Snapshot, urls: DataFrame, plan: Callable[[plans.Tables], tuple[plans.Tables, DataFrame | None]]) -> dict[str, commits.Change]:
    """The changes that a plan makes to the buckets of some addresses, whose rows are all that it is given."""
    touched = {n: now.buckets_of(n, urls, "url") for n in KEYS}
    before = plans.Tables(*(own(spark, now, n, touched.get(n)) for n in ("events", "distances", "occurrences", "race_types")))
    after, runs = plan(before)
    changes = {n: commits.Merge(getattr(after, n), touched[n]) for n in KEYS}
    changes["race_types"] = commits.Append(after.race_types.join(before.race_types.select("label"), "label", "left_anti").select(*before.race_types.columns))
    return changes | ({} if runs is None else {"runs": commits.Append(runs)})


def lookup(spark, folder, name, schema) -> DataFrame:
    """A lookup table; without one every call fails."""
    path = f"{folder}/{name}"
    return spark.read.parquet(path) if folder and files.exists(spark, path) else spark.createDataFrame([], schema)


def lookups_of(spark, folder) -> plans.Lookups:
    return plans.Lookups(*(lookup(spark, folder, n, s) for n, s in LOOKUPS.items()))


def import_feed(spark, a) -> dict:
    params = dict(p.partition("=")[::2] for p in a.param)
    rows = files.read_feed(spark, a.path)
    summary = {"status": "unusable", "registered": 0}
    if rows is not None:
        events = feed.feed_events(rows, params.get("today", datetime.date.today().isoformat()), params.get("country", feed.DEFAULT_COUNTRY))
        summary = feed.import_summary(events, a.organiser)
    now = F.lit(datetime.datetime.now(datetime.UTC))

    def work(base: commits.Snapshot) -> dict[str, commits.Change]:
        organisers = store.umbrella_organiser(own(spark, base, "organisers"), a.organiser, params.get("homepage", ""), "feed_import")
        changes = {"organisers": organisers.withColumns({"id": F.coalesce("id", F.xxhash64("name"))})}
        if rows is not None:
            changes |= merged(spark, base, events, lambda before: (plans.register(before, events, F.xxhash64(F.lit(a.organiser)), F.lit("bot"), now), None))
        return changes

    log_of(spark, a.tables).commit(work)
    return summary


def seed(spark, a) -> dict:
    rows = files.read_seed(spark, a.path).withColumns({"id": F.xxhash64("name"), "source_type": F.lit("organiser"), "active": F.lit(True)})
    log_of(spark, a.tables).commit(lambda base: {"organisers": store.sync_seed(own(spark, base, "organisers"), rows)})
    return {"organisers": table(spark, a.tables, "organisers").count()}


def discover_sitemaps(spark, a) -> dict:
    """Rewrites a seed CSV with the sitemap that each home page's robots file names."""
    rows = spark.read.csv(a.path, header=True, quote='"', escape='"', multiLine=True)
    found = lookup(spark, a.lookups, "robots", lookups.ROBOTS).select(F.concat("site", F.lit("/robots.txt")).alias("_robots"), F.when(F.col("status") < 400, sitemap_directive(F.col("body"))).alias("_map"))
    out = rows.drop("sitemap_url").withColumn("_robots", robots_url(F.col("homepage_url"))).join(found, "_robots", "left").withColumn("sitemap_url", F.col("_map")).drop("_robots", "_map")
    report.write_csv(out, a.output)
    return dict(zip(("found", "total"), out.agg(F.count_if(F.length("sitemap_url") > 0), F.count(F.lit(1))).first(), strict=True))


def stop_if_unreachable(found: plans.Lookups, asked: DataFrame) -> None:
    """Ends a run before it stores anything if a page that it asked for says that nothing can be reached at all."""
    if "error" in found.pages.columns and decide.aborted(asked.select("url").distinct().join(found.pages.select("url", "error"), "url")):
        raise ConnectionError("pages cannot be fetched at all; nothing was stored")


def discover(spark, a, organisers: DataFrame, found: plans.Lookups, before: plans.Tables, now) -> discovery.Found:
    """New addresses of organisers; their listing pages' audit rows and discovered listings are settled."""
    new = discovery.discover(organisers, discovery.Request(found, before.events, now, a.force_refresh))
    return discovery.Found(*(store.settle(x) for x in (new.urls, new.runs, new.listings)))


def remembered(organisers: DataFrame, listings: DataFrame) -> DataFrame:
    """organisers with the listings that were discovered for them."""
    own = listings.select(F.col("organiser_id").alias("id"), F.col("listing_urls").alias("_own"))
    return organisers.join(own, "id", "left").withColumn("listing_urls", F.coalesce("_own", "listing_urls")).drop("_own").select(organisers.columns)


def crawl(spark, a) -> dict:
    """From organisers to stored events: sitemaps, listings or discovery, then the events that are new."""
    found, now, summary = lookups_of(spark, a.lookups), F.lit(datetime.datetime.now(datetime.UTC)), {}

    def work(base: commits.Snapshot) -> dict[str, commits.Change]:
        every = own(spark, base, "organisers")
        organisers = decide.eligible(every, a.organiser_id)
        if a.limit:
            organisers = organisers.orderBy("id").limit(a.limit)
        organisers = store.settle(organisers)
        named = decide.pick_handler(organisers, decide.handlers.names())
        unknown = named.where("NOT handler_known AND length(handler) > 0").count()  # the default handler takes these
        new = discover(spark, a, organisers, found, tables_of(spark, base), now)
        requests = store.settle(decide.planned(new.urls.join(organisers.select(F.col("id").alias("organiser_id"), "registrator"), "organiser_id"), a.mode))
        stop_if_unreachable(found, new.runs.select("url").unionByName(requests.select("url")))
        changes = merged(spark, base, requests, lambda before: plans.crawl(before, requests, found, now, decide.check_mode_of(a.force_refresh, a.check_mode)))
        runs = store.settle(changes["runs"].rows)
        summary.clear()
        summary.update({r["status"]: r["count"] for r in runs.groupBy("status").count().collect()})
        summary.update({f"listing {r['status']}": r["count"] for r in new.runs.groupBy("status").count().collect()})
        summary.update({"unknown handlers": unknown} if unknown else {})
        return changes | {"runs": commits.Append(new.runs.unionByName(runs)), "organisers": remembered(every, new.listings)}

    log_of(spark, a.tables).commit(work)
    return summary


def listing_queue(spark, a) -> dict:
    """Messages that name organisers: their new addresses as messages for the event queue, in a folder of JSON lines.

    Reads what has arrived in a folder of message bodies since the last time, as a stream. A batch that is handed on
    again writes its folder of messages again and is in the audit once.
    """
    def work(batch: DataFrame, number: int, base: commits.Snapshot) -> dict[str, commits.Change]:
        asked = queue.listing_messages(batch).distinct()
        every = own(spark, base, "organisers")
        organisers = store.settle(decide.eligible(every).join(asked.withColumnRenamed("organiser_id", "id"), "id", "left_semi"))
        now = F.lit(datetime.datetime.now(datetime.UTC))
        new = discover(spark, a, organisers, lookups_of(spark, a.lookups), tables_of(spark, base), now)
        listings = new.urls.groupBy("organiser_id").agg(F.collect_set("url").alias("urls"))
        out = queue.publish(queue.fan_out(asked, listings), "events").select(queue.envelope(F.col("value")).alias("value"))
        out.write.mode("overwrite").text(f"{a.output}/batch-{number:09d}")
        return {"runs": commits.Append(new.runs), "organisers": remembered(every, new.listings)}

    return drained(spark, a, work)


def event_queue(spark, a) -> dict:
    """Messages that name events: each is crawled and stored once; what is stored already is only looked at again."""
    def work(batch: DataFrame, number: int, base: commits.Snapshot) -> dict[str, commits.Change]:
        asked = queue.event_messages(batch).distinct()
        organisers = decide.eligible(own(spark, base, "organisers")).select(F.col("id").alias("organiser_id"), "registrator")
        requests = store.settle(asked.join(organisers, "organiser_id").select("organiser_id", F.col("event_url").alias("url"), "registrator"))
        found, now = lookups_of(spark, a.lookups), F.lit(datetime.datetime.now(datetime.UTC))
        stop_if_unreachable(found, requests)
        return merged(spark, base, requests, lambda before: plans.crawl(before, requests, found, now, decide.check_mode_of(a.force_refresh, a.check_mode)))

    return drained(spark, a, work)


def drained(spark, a, work: Callable[[DataFrame, int, commits.Snapshot], dict[str, commits.Change]]) -> dict:
    """Hands what has arrived to work, settled, a micro-batch at a time; each batch is one commit, made once."""
    read = []

    def one(batch: DataFrame, number: int) -> None:
        rows = store.settle(batch)
        log_of(spark, a.tables).commit(lambda base: work(rows, number, base), commits.stream_id(spark, a.checkpoint), number)
        read.append(rows.count())

    bodies = spark.readStream.option("wholetext", True).text(a.messages).withColumnRenamed("value", "body")
    queue.upserts(bodies, one, a.checkpoint).awaitTermination()
    return {"messages": sum(read)}


def export(spark, a) -> dict:
    base = log_of(spark, a.tables).snapshot()
    now = tables_of(spark, base)
    ids = lambda df: df.withColumn("event_id", F.xxhash64("url"))
    tree = report.event_tree(now.events.withColumn("id", F.xxhash64("url")), own(spark, base, "organisers"), ids(now.distances), ids(now.occurrences), "invalid" if a.format == "html-invalid" else "valid", a.organiser_id)
    if a.format == "csv":
        return {"rows": report.write_csv(report.ordered(report.csv_rows(tree), a.collation), a.output)}
    return {"events": report.event_type_report(tree, a.output) if a.format == "html-by-type" else report.organiser_report(tree, a.output)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="startline", description=__doc__)
    p.add_argument("--tables", required=True)
    p.add_argument("--lookups", default="")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("import-feed")
    c.add_argument("path")
    c.add_argument("--organiser", default="Feed organiser")
    c.add_argument("--param", action="append", default=[])
    c = commands.add_parser("seed")
    c.add_argument("path")
    c = commands.add_parser("discover-sitemaps")
    c.add_argument("path")
    c.add_argument("--output", required=True)
    c = commands.add_parser("crawl")
    c.add_argument("--limit", type=int)
    c.add_argument("--organiser-id", type=int)
    c.add_argument("--mode", choices=decide.RUN_MODES, default="normal")
    c.add_argument("--check-mode", choices=decide.CHECK_MODES, default="hash-check")
    c.add_argument("--force-refresh", action="store_true")
    for name in ("listing-queue", "event-queue"):
        c = commands.add_parser(name)
        c.add_argument("messages")
        c.add_argument("--checkpoint", required=True)
        c.add_argument("--check-mode", choices=decide.CHECK_MODES, default="hash-check")
        c.add_argument("--force-refresh", action="store_true")
        if name == "listing-queue":
            c.add_argument("--output", required=True)
    c = commands.add_parser("export")
    c.add_argument("--collation", help="of the CSV's order by organiser, such as de or UNICODE")
    c.add_argument("--format", choices=("csv", "html", "html-by-type", "html-invalid"), default="csv")
    c.add_argument("--output", required=True)
    c.add_argument("--organiser-id", type=int)
    return p


COMMANDS = {"listing-queue": listing_queue, "event-queue": event_queue, "import-feed": import_feed, "seed": seed, "discover-sitemaps": discover_sitemaps, "crawl": crawl, "export": export}


def main(arguments: list[str] | None = None) -> dict:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    summary = COMMANDS[a.command](spark, a)
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
