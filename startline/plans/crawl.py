"""A whole crawl as one plan: addresses and lookups in, the next snapshot and its audit out.

The cheap decisions come first and are settled: only addresses that are to be extracted reach the structured data
and the model's answers. What was extracted is settled too, as it feeds four tables. Stored events are read by one full join on the address, whatever happened to each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startline.functions.text import blank_to_null, race_label
from startline.operators import decide, extract, robots, store
from startline.sources import lookups
from startline.sources.files import registrator as or_bot

# Stored columns of an event, its children apart.
EVENT = (
    "url string, organiser_id long, name string, sport string, summary string, summary_alt string, summary_short string, date_text string, "
    "location string, start_location string, finish_location string, age_restriction_text string, registration_status string, "
    "registration_text string, registration_opens_at timestamp, registration_closes_at timestamp, lifecycle_status string, lifecycle_text string, "
    "status string, invalid_reason string, content_hash string, occurrence string, occurrence_weekdays array<string>, occurrence_time string, "
    "occurrence_starts_on date, occurrence_ends_on date, latitude double, longitude double, registrator string, "
    "first_seen_at timestamp, last_seen_at timestamp, last_crawled_at timestamp"
)
DISTANCE = "url string, sort_order int, distance_text string, price_text string, label string, registrator string"
OCCURRENCE = "url string, sort_order int, starts_at timestamp, date_text string, time_text string, price_text string, registrator string"
RACE_TYPE = "label string, sport string, distance_category string"
RUN = "run_type string, url string, organiser_id long, status string, detail string, finished_at timestamp"


@dataclass
class Tables:
    events: DataFrame
    distances: DataFrame
    occurrences: DataFrame
    race_types: DataFrame

    @classmethod
    def empty(cls, spark) -> Tables:
        return cls(*(spark.createDataFrame([], s) for s in (EVENT, DISTANCE, OCCURRENCE, RACE_TYPE)))


@dataclass
class Lookups:
    """Pages, probes, robots files, model answers (by task and key), places; views of listings and sitemap files."""

    pages: DataFrame
    probes: DataFrame
    robots: DataFrame
    answers: DataFrame
    places: DataFrame
    views: DataFrame | None = None
    sitemaps: DataFrame | None = None

    def __post_init__(self):
        spark = self.pages.sparkSession
        self.views = spark.createDataFrame([], lookups.VIEWS) if self.views is None else self.views
        self.sitemaps = spark.createDataFrame([], lookups.SITEMAPS) if self.sitemaps is None else self.sitemaps


def register(tables: Tables, fields: DataFrame, organiser_id: Column, who: Column, now: Column) -> Tables:
    """Events from fields that need neither page nor model, such as a feed's; children are replaced."""
    once = store.settle(fields.dropDuplicates(["url"]))
    rows = extract.event_rows(once, who).withColumn("organiser_id", organiser_id)
    decided = rows.select("url", "organiser_id", F.lit("upsert").alias("action"), F.lit(None).cast("int").alias("page_status"), who.alias("registrator"))
    return apply(tables, decided, rows, once, now)


def apply(tables: Tables, decided: DataFrame, rows: DataFrame, fields: DataFrame, now: Column) -> Tables:
    """The next tables from what was decided for each address and the rows of those that were extracted."""
    stored = [c for c in tables.events.columns if c not in ("url", "organiser_id", "first_seen_at", "last_seen_at", "last_crawled_at")]
    new = rows.select("url", F.struct(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(tables.events.schema[c].dataType).alias(c) for c in stored]).alias("new"))
    incoming = decided.join(new, "url", "left").withColumnRenamed("registrator", "who").withColumnRenamed("organiser_id", "by").withColumnRenamed("url", "address")
    both = tables.events.join(incoming, F.col("url") == F.col("address"), "full").where(F.col("url").isNotNull() | F.col("action").isin("upsert", "dead-link"))
    act = F.coalesce("action", F.lit("none"))
    dead = {"status": F.lit("invalid"), "invalid_reason": F.concat(F.lit("HTTP "), F.col("page_status").cast("string"), F.lit(" fetching the page")), "registrator": F.col("who")}
    fresh = {"status": "valid", "registration_status": "unknown", "lifecycle_status": "scheduled", "occurrence": "one_off"}

    def value(c):
        kept = F.col(c) if c not in fresh else F.when(F.col("url").isNull(), F.lit(fresh[c])).otherwise(F.col(c))
        return F.when(act == "upsert", F.col(f"new.{c}")).when(act == "dead-link", dead.get(c, kept)).otherwise(F.col(c))

    events = both.select(
        F.coalesce("url", "address").alias("url"),
        F.coalesce("organiser_id", "by").alias("organiser_id"),
        *[value(c).alias(c) for c in stored],
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(act.isin("upsert", "dead-link", "unchanged", "url-skip"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(act.isin("upsert", "dead-link", "unchanged"), now).otherwise(F.col("last_crawled_at")).alias("last_crawled_at"),
    )
    who = rows.select("url", "registrator", "sport")
    distances = store.numbered(fields, "distances", "url").join(who, "url")
    labelled = distances.withColumn("label", race_label(F.col("sport"), F.col("distance_category")))
    return Tables(
        events,
        store.replace_children(tables.distances, rows, labelled.select(*tables.distances.columns), "url"),
        store.replace_children(tables.occurrences, rows, store.occurrence_rows(fields).join(who, "url").select(*tables.occurrences.columns), "url"),
        store.race_types(distances, tables.race_types),
    )


def crawl(tables: Tables, requests: DataFrame, found: Lookups, now: Column, mode: str = "hash-check", agent: str = "startline", respect_robots: bool = True) -> tuple[Tables, DataFrame]:
    """The next tables and the audit rows of a crawl of requests (organiser_id, url, registrator).

    Of requests for one address one is crawled; its organiser is the smallest identifier.
    """
    asked = requests.groupBy("url").agg(F.min(F.struct("organiser_id", or_bot(F.col("registrator")).alias("registrator"))).alias("r")).select("url", "r.*")
    asked = robots.allowed(asked, robots.rules(found.robots, agent), F.col("registrator"), respect_robots)
    old = tables.events.select("url", F.lit(True).alias("known"), F.col("content_hash").alias("old_hash"))
    asked = lookups.liveness(asked.join(old, "url", "left").withColumn("known", F.coalesce("known", F.lit(False))), found.probes)
    pages = lookups.fetch(asked, found.pages).withColumn("new_hash", decide.content_hash(F.col("markdown")))
    pages = pages.withColumns({"extracted": F.lit(None).cast("boolean"), "is_valid": F.lit(None).cast("boolean"), "invalid_reason": F.lit(None).cast("string")})
    first = store.settle(decide.decide(pages, mode).drop("markdown", "links", "html", "final_url"))
    wanted = extract.known_fields(lookups.fetch(first.where("action = 'upsert'").select("url"), found.pages).select("url", "markdown", "html"))
    fields = store.settle(extract.event_fields(lookups.answered(wanted, found.answers, "extract_event", "url")))
    rewritten = lookups.answered(fields.where(blank_to_null(F.col("summary")).isNotNull()).select("url"), found.answers, "rewrite_summary", "url")
    fields = extract.with_summaries(fields, rewritten)
    fields = extract.with_coordinates(fields, found.places, tables.events.select("url", "latitude", "longitude"))
    fields = store.settle(fields)
    got = fields.select("url", F.lit(True).alias("_got"), F.col("is_valid_event").alias("_valid"), F.col("invalid_reason").alias("_reason"))
    again = first.drop("action", "run_status", "detail").join(got, "url", "left")
    again = again.withColumns({"extracted": F.coalesce("_got", F.lit(False)), "is_valid": F.col("_valid"), "invalid_reason": F.col("_reason")}).drop("_got", "_valid", "_reason")
    decided = store.settle(decide.decide(again, mode))
    rows = extract.event_rows(fields.join(decided.select("url", F.col("registrator").alias("_who")), "url"), F.col("_who"))
    runs = decided.select(F.lit("event").alias("run_type"), "url", "organiser_id", F.col("run_status").alias("status"), "detail", now.alias("finished_at"))
    return apply(tables, decided.select("url", "organiser_id", "action", "page_status", "registrator"), rows, fields, now), runs
