"""Files read back, whole discovery runs, streams and stored columns: operators that need more than one step."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from startline.functions import markup
from startline.operators import decide, extract, feed, listing, report, store
from startline.plans import crawl as plans
from startline.plans import discovery, roles
from startline.plans.extract_queries import extracted, feed_rows
from startline.plans.roles import table
from startline.sources import files, lookups
from startline.streaming import queue


def written(rows, name, kind="csv", **options) -> str:
    """rows in a new folder of the shared one."""
    path = f"{store.shared_folder(rows.sparkSession)}/startline-{name}-{uuid.uuid4().hex}"
    rows.write.options(**options).format(kind).save(path)
    return path


def seed_scan(spark, d):
    """A seed file written from customers and read back: quoted JSON, blank cells and a sitemap over the parameters."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    cells = {
        "name": F.concat(F.lit('The "best", '), "c_name"), "listing_urls": F.when(k % 3 == 0, F.concat(F.lit('["https://a/'), k.cast("string"), F.lit('","https://b/"]'))).when(k % 3 == 1, F.lit("[]")).otherwise(none),
        "homepage_url": F.concat(F.lit("https://o"), k.cast("string"), F.lit(".example/")), "discovered_via": F.lit("list"), "sitemap_url": F.when(k % 2 == 0, F.lit("https://s/")), "handler": F.when(k % 5 == 0, F.lit("own")),
        "handler_params": F.when(k % 7 == 0, F.lit('{"sitemap_url":"old","x":"1"}')), "registrator": F.when(k % 4 == 0, F.lit("person")),
    }
    rows = table(spark, d, "customer").select(*[cells[c].alias(c) for c in files.SEED_COLUMNS])
    read = files.read_seed(spark, written(rows, "seed", header=True, quote='"', escape='"'))
    return read.select("name", F.array_join("listing_urls", " ").alias("listings"), "handler", F.col("handler_params")["sitemap_url"].alias("sitemap"), F.col("handler_params")["x"].alias("x"), "registrator")


def feed_scan(spark, d):
    """A tab-separated feed read back and imported; what the summary counts is every row that is tried."""
    rows = files.read_feed(spark, written(feed_rows(spark, d), "feed", header=True, sep="\t", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    found = feed.import_summary(feed.feed_events(rows, "2024-05-01"), "Feed organiser")
    gone = feed.import_summary(None if files.read_feed(spark, f"{d}/no such feed.tsv") is None else rows, "Nobody")
    return spark.createDataFrame([(x["status"], x["registered"], x["organiser"]) for x in (found, gone)], "status string, registered long, organiser string")


def csv_column_rewrite(spark, d):
    """A CSV copied with one column replaced, read back, beside how many rows have a value."""
    path = written(table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit("old").alias("sitemap_url")), "csv", header=True)
    target = f"{path}-new"
    found, total = report.with_column_rewritten(spark, path, target, "sitemap_url", F.when(F.col("s_suppkey").cast("long") % 3 == 0, F.concat(F.lit('a "'), F.col("s_suppkey"), F.lit('", b'))))
    back = spark.read.csv(target, header=True, quote='"', escape='"')
    return back.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.nullif("sitemap_url", F.lit("")).alias("sitemap_url"), F.lit(found).alias("found"), F.lit(total).alias("total"))


def csv_all_columns(spark, d):
    """All columns of the flat export, of events that have a value in each."""
    k = F.col("id")
    e = roles.events(spark, d).drop("starts")
    words = ("name", "sport", "invalid_reason", "date_text", "occurrence", "occurrence_time", "location", "start_location", "finish_location", "age_restriction_text", "registration_status", "registration_text", "lifecycle_status", "lifecycle_text", "summary", "summary_alt", "summary_short")
    e = e.withColumns({c: F.concat(F.lit(f"{c} "), k.cast("string")) for c in words})
    e = e.withColumns({c: F.lit("2024-01-01") for c in ("occurrence_starts_on", "occurrence_ends_on", "registration_opens_at", "registration_closes_at", "first_seen_at", "last_seen_at", "last_crawled_at")})
    e = e.withColumns({"occurrence_weekdays": F.when(k % 2 == 0, F.array(F.lit("sat"), F.lit("sun"))), "latitude": F.lit(1.5), "longitude": F.lit(-2.5)})
    dates = roles.events(spark, d).where("id % 3 = 0").select(k.alias("event_id"), F.explode(F.array(F.lit(1), F.lit(0))).alias("sort_order"))
    n = F.col("sort_order").cast("string")
    dates = dates.select("event_id", "sort_order", F.concat(F.lit("Day "), n).alias("date_text"), F.when(F.col("event_id") % 2 == 0, F.lit("9 am")).alias("time_text"), F.when(F.col("sort_order") == 1, F.lit("£5")).alias("price_text"))
    tree = report.event_tree(e, roles.organisers(spark, d), roles.distances(spark, d), dates)
    return report.csv_rows(tree)


CSV_WORDS = {c: f"'{c} ' || o_orderkey" for c in "name sport invalid_reason date_text occurrence occurrence_time location start_location finish_location age_restriction_text registration_status registration_text lifecycle_status lifecycle_text summary summary_alt summary_short".split()}
CSV_VALUES = CSV_WORDS | {c: "'2024-01-01'" for c in "occurrence_starts_on occurrence_ends_on registration_opens_at registration_closes_at first_seen_at last_seen_at last_crawled_at".split()} | {
    "id": "o_orderkey", "organiser_id": "o_custkey", "organiser_name": "c_name", "status": "'valid'", "occurrence_weekdays": "CASE WHEN o_orderkey % 2 = 0 THEN 'sat, sun' END", "latitude": "CAST(1.5 AS DOUBLE)", "longitude": "CAST(-2.5 AS DOUBLE)",
    "distances": "coalesce(line, '')", "occurrences": "CASE WHEN o_orderkey % 3 <> 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'Day 0 9 am; Day 1 9 am: £5' ELSE 'Day 0; Day 1: £5' END", "url": "'https://events.example/' || o_orderkey || '/'",
}
CSV_LINES = """x AS (
  SELECT event_id, string_agg(distance_text || coalesce(' [' || label || ']', '') || coalesce(': ' || price_text, ''), '; ' ORDER BY sort_order) AS line FROM distances GROUP BY event_id)"""
CSV_SQL = f"WITH {roles.DISTANCES_SQL}, {CSV_LINES} SELECT " + ", ".join(f"{CSV_VALUES[c]} AS {c}" for c in report.CSV_COLUMNS) + " FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN x ON event_id = o_orderkey WHERE o_orderstatus <> 'P'"


def organiser_filter(spark, d):
    """One organiser's events, of every status."""
    return report.event_tree(roles.events(spark, d), roles.organisers(spark, d), roles.distances(spark, d), status=None, organiser_id=7).select("id", "organiser_id", "status")


def stored_columns(spark, d):
    """What is stored of extracted fields: defaults, dates that cannot be read, times that can."""
    rows = extract.event_rows(extracted(spark, d), F.when(F.col("url").cast("long") % 2 == 0, F.lit("person")).otherwise(F.lit("bot")))
    return rows.select("url", "name", "status", "registration_status", "lifecycle_status", "registration_opens_at", "registration_closes_at", "occurrence", "occurrence_time", "occurrence_starts_on", F.array_join("occurrence_weekdays", ",").alias("weekdays"), "registrator")


STORED_SQL = """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS url, doc_id AS k FROM documents WHERE doc_id % 31 <> 0 AND length(regexp_replace(text, '\\s+', '', 'g')) > 0)
SELECT url, CASE WHEN k % 2 = 0 THEN 'Known' ELSE 'Answer ' || k END AS name, CASE WHEN k % 5 <> 1 THEN 'valid' ELSE 'invalid' END AS status, CASE k % 3 WHEN 0 THEN 'open' ELSE 'unknown' END AS registration_status,
  CASE k % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'scheduled' ELSE 'postponed' END AS lifecycle_status, CAST(NULL AS TIMESTAMP) AS registration_opens_at, TIMESTAMP '2024-03-01 00:00:00' AS registration_closes_at,
  CASE k % 4 WHEN 0 THEN 'weekly' ELSE 'one_off' END AS occurrence, CAST(NULL AS VARCHAR) AS occurrence_time, CAST(NULL AS DATE) AS occurrence_starts_on, CASE k % 3 WHEN 0 THEN 'sat,sun' END AS weekdays, CASE WHEN k % 2 = 0 THEN 'person' ELSE 'bot' END AS registrator FROM a"""


def summary_rewrite(spark, d):
    """Alternatives of summaries: asked for those that are not blank, null where the answer is bad."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    fields = p.select(k.cast("string").alias("url"), F.when(k % 5 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("summary"))
    answer = F.when(k % 3 == 0, F.lit("{broken")).when(k % 3 == 1, F.concat(F.lit('{"summary_alt":"Alt '), k.cast("string"), F.lit('","summary_short":" "}'))).otherwise(F.lit('{"summary_alt":7,"summary_short":"s"}'))
    answers = p.select(F.lit("rewrite_summary").alias("task"), k.cast("string").alias("key"), answer.alias("answer"))
    return extract.with_summaries(fields, lookups.answered(fields.select("url"), answers, "rewrite_summary", "url"))


def listing_caps(spark, d):
    """Pagers of sixty pages, each with something new, end at the cap."""
    pages = table(spark, d, "region").select(F.col("r_name").alias("listing"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("page"))
    shown = listing.paginate(pages.withColumn("urls", F.array(F.concat("listing", F.col("page").cast("string")))))
    grown = pages.select("listing", (F.col("page") - 1).alias("round"), F.transform(F.sequence(F.lit(1), F.col("page")), lambda n: n.cast("string")).alias("urls"))
    return shown.select("listing", F.col("pages").cast("int").alias("pages"), F.size("urls").alias("urls")).join(listing.append(grown).select("listing", F.col("rounds").cast("int").alias("rounds")), "listing")


def main_text_rule(spark, d):
    """Main text of generated pages: furniture goes, a card's header stays."""
    p, k = store.spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey"), F.col("p_partkey").cast("string")
    page = F.concat(
        F.lit("<html><body><nav><a href='/'>Home</a></nav><header><h1>"), F.col("p_name"), F.lit("</h1></header><main><h2>Part "), k, F.lit("</h2><p>One  <b>bold</b>\n word</p><ul><li>a</li><li>b</li></ul><script>x()</script></main><aside>ads</aside><footer>end</footer></body></html>")
    )
    return p.select("p_partkey", markup.page_text(page).alias("markdown"))


def run_abort(spark, d):
    """Whether a run stops: for the connection's own error, not for a page's."""
    p = table(spark, d, "pages")
    errors = p.select("url", F.when(F.col("page_id") % 3 == 0, F.lit("Timeout")).alias("error"))
    broken = errors.withColumn("error", F.when(F.col("url") == p.agg(F.max("url")).first()[0], F.lit("ConnectionError")).otherwise(F.col("error")))
    return spark.createDataFrame([("pages", decide.aborted(errors)), ("connection", decide.aborted(broken))], "failed string, stops boolean")


def discovery_world(spark, d):
    """Organisers of suppliers: of every four one has a sitemap, one a listing of two pages, one nothing, one a growing list."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k")
    home = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example/"))
    at = lambda path: F.concat(home, F.lit(path))
    strings = lambda *xs: F.array(*xs).cast("array<string>")
    none = strings()
    organisers = s.select(
        k.alias("id"), home.alias("homepage_url"), F.when(k % 4 == 1, strings(at("list"))).when(k % 4 == 3, strings(at("grow"))).otherwise(none).alias("listing_urls"),
        F.when(k % 4 == 0, F.create_map(F.lit("sitemap_url"), at("map.xml"))).alias("handler_params"), F.lit("default").alias("handler"), F.lit("bot").alias("registrator"),
    )
    page = lambda rows, path, links, html="": rows.select(at(path).alias("url"), F.lit("m").alias("markdown"), strings(*[at(x) for x in links]).alias("links"), F.lit(html).alias("html"), at(path).alias("final_url"))
    one, two, three = s.where("k % 4 = 1"), s.where("k % 4 = 2"), s.where("k % 4 = 3")
    button = "<button>Load more</button>"
    pages = page(one, "list", ["e1", "about", "next"]).union(page(one, "next", ["e1", "e2", "list"])).union(page(two, "", ["found", "login"])).union(page(two, "found", ["e1"])).union(page(three, "grow", ["e1"], button))
    views = three.select(at("grow").alias("url"), F.lit(1).alias("press"), F.lit("m").alias("markdown"), strings(at("e1"), at("e2")).alias("links"), F.lit(button).alias("html"))
    views = views.union(three.select(at("grow"), F.lit(2), F.lit("m"), strings(at("e1"), at("e2")), F.lit(button)))
    answer = lambda rows, task, key, text_: rows.select(F.lit(task).alias("task"), key.alias("key"), text_.alias("answer"))
    answers = (
        answer(one, "analyze_listing", at("list"), F.lit('{"event_indices":[0],"next_page_index":2}'))
        .union(answer(one, "analyze_listing", at("next"), F.lit('{"event_indices":[0,1],"next_page_index":2}')))
        .union(answer(two, "discover_listings", home, F.concat(F.lit('{"listing_urls":["'), at("found"), F.lit('","https://else.test/"]}'))))
        .union(answer(two, "analyze_listing", at("found"), F.lit('{"event_indices":[0]}')))
        .union(answer(three, "detect_load_more", at("grow"), F.lit('{"interaction_type":"append"}')))
        .union(answer(three, "detect_load_more", F.concat(at("grow"), F.lit("#press=1")), F.lit('{"interaction_type":"append"}')))
        .union(answer(three, "analyze_listing", F.concat(at("grow"), F.lit("#press=1")), F.lit('{"event_indices":[0,1]}')))
    )
    loc = lambda path: F.concat(F.lit("<url><loc>"), at(path), F.lit("</loc></url>"))
    maps = s.where("k % 4 = 0").select(at("map.xml").alias("url"), F.when(k % 8 == 0, F.concat(F.lit("<urlset>"), loc("e1"), loc("e2"), F.lit("</urlset>"))).otherwise(F.lit("<other/>")).alias("xml"))
    robots = s.where("k % 5 = 0").select(F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example")).alias("site"), F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /list\nDisallow: /map.xml").alias("body"))
    found = plans.Lookups(pages, spark.createDataFrame([], lookups.PROBES), robots, answers, spark.createDataFrame([], lookups.PLACES), views, maps)
    stored = s.where("k % 3 = 0").select(at("e1").alias("url"))
    return discovery.discover(organisers, discovery.Request(found, stored, F.lit("2024-01-01 00:00:00").cast("timestamp")))


def discovered_events(spark, d):
    return discovery_world(spark, d).urls


def discovery_audit(spark, d):
    return discovery_world(spark, d).runs.select("url", "organiser_id", "status", "detail")


SITES = """WITH s AS (SELECT s_suppkey AS k, 'https://s' || s_suppkey || '.example/' AS home, s_suppkey % 4 AS kind, s_suppkey % 5 = 0 AS shut, s_suppkey % 3 = 0 AS known FROM supplier
), e AS (SELECT k, home, kind, shut, known, CASE WHEN kind = 0 AND k % 8 = 0 AND NOT shut THEN ['e1', 'e2'] WHEN kind = 1 AND NOT shut THEN ['e1', 'e2'] WHEN kind = 2 THEN ['e1'] WHEN kind = 3 THEN ['e1', 'e2'] ELSE [] END AS found FROM s
) """
EVENTS_SQL = SITES + "SELECT k AS organiser_id, home || x AS url FROM (SELECT k, home, known, unnest(found) AS x FROM e) WHERE NOT (known AND x = 'e1')"
AUDIT_SQL = SITES + """SELECT home || 'map.xml' AS url, k AS organiser_id, 'success' AS status, '2 urls from sitemap, ' || CASE WHEN known THEN 1 ELSE 2 END || ' new' AS detail FROM e WHERE kind = 0 AND len(found) > 0
UNION ALL SELECT home || 'list', k, CASE WHEN shut THEN 'skipped' ELSE 'success' END, CASE WHEN shut THEN 'disallowed by robots.txt' ELSE '3 candidate links, 1 confirmed events, ' || CASE WHEN known THEN 0 ELSE 1 END || ' new' END FROM e WHERE kind = 1
UNION ALL SELECT home || 'next', k, 'success', '3 candidate links, 2 confirmed events, 1 new' FROM e WHERE kind = 1 AND NOT shut
UNION ALL SELECT home || 'found', k, 'success', '1 candidate links, 1 confirmed events, ' || CASE WHEN known THEN 0 ELSE 1 END || ' new' FROM e WHERE kind = 2
UNION ALL SELECT home || 'grow', k, 'success', '2 candidate links, 2 confirmed events, ' || CASE WHEN known THEN 1 ELSE 2 END || ' new' FROM e WHERE kind = 3"""


def queue_fan_out(spark, d):
    """Listing messages as a stream: a message for each event of the organiser's listing, in its envelope and out again."""
    source = spark.readStream.schema(table(spark, d, "orders").schema).parquet(f"{d}/orders.parque[t]")
    order = F.to_json(F.struct(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("organiser_id")))
    messages = queue.listing_messages(source.select(queue.envelope(order).alias("body")))
    listings = table(spark, d, "customer").select(F.col("c_custkey").alias("organiser_id"), F.array(F.concat(F.lit("https://"), F.col("c_name")), F.lit("https://all/")).alias("urls"))
    sent = queue.publish(queue.fan_out(messages, listings), "events").select(queue.envelope(F.col("value")).alias("body"))
    got = queue.event_messages(store.drained(sent, "fan-out"))
    return got.groupBy("organiser_id", "event_url").agg(F.count(F.lit(1)).alias("n"))


def scheduled_batches(spark, d):
    """Events that arrive as a stream, upserted by user; a second run finds nothing new."""
    folder = f"{store.shared_folder(spark)}/startline-batch-{uuid.uuid4().hex}"
    found = store.SnapshotTable(spark, f"{folder}/table")
    found.replace(spark.createDataFrame([], "user_id long, first_seen_at string, last_seen_at string, events long"))

    def apply(batch, number):
        rows = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
        found.replace(store.upsert(found.read(), rows, "user_id", F.lit(f"batch {number}"), touch=("last_seen_at",)))

    for _ in range(2):
        source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
        queue.upserts(source, apply, f"{folder}/log").awaitTermination()
    return found.read()


QUERIES = {
    "seed_scan": (
        seed_scan,
        """SELECT 'The "best", ' || c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'https://a/' || c_custkey || ' https://b/' ELSE '' END AS listings, CASE WHEN c_custkey % 5 = 0 THEN 'own' ELSE 'default' END AS handler,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://s/' WHEN c_custkey % 7 = 0 THEN 'old' END AS sitemap, CASE WHEN c_custkey % 7 = 0 THEN '1' END AS x, CASE WHEN c_custkey % 4 = 0 THEN 'person' ELSE 'bot' END AS registrator FROM customer""",
    ),
    "feed_scan": (feed_scan, "SELECT 'ok' AS status, count(*) AS registered, 'Feed organiser' AS organiser FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 11 <> 0 UNION ALL SELECT 'unusable', 0, 'Nobody'"),
    "csv_column_rewrite": (csv_column_rewrite, "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'a \"' || s_suppkey || '\", b' END AS sitemap_url, count(*) FILTER (s_suppkey % 3 = 0) OVER () AS found, count(*) OVER () AS total FROM supplier"),
    "csv_all_columns": (csv_all_columns, CSV_SQL),
    "organiser_filter": (organiser_filter, "SELECT o_orderkey AS id, o_custkey AS organiser_id, CASE WHEN o_orderstatus = 'P' THEN 'invalid' ELSE 'valid' END AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 7"),
    "stored_columns": (stored_columns, STORED_SQL),
    "summary_rewrite": (
        summary_rewrite,
        """SELECT CAST(p_partkey AS VARCHAR) AS url, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS summary, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'Alt ' || p_partkey WHEN p_partkey % 3 = 2 THEN '7' END AS summary_alt,
  CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 2 THEN 's' END AS summary_short FROM part""",
    ),
    "listing_caps": (listing_caps, f"SELECT r_name AS listing, {listing.MOST_PAGES} AS pages, {listing.MOST_PAGES} AS urls, {listing.MOST_PAGES} AS rounds FROM region"),
    "main_text_rule": (main_text_rule, "SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || '## Part ' || p_partkey || chr(10) || chr(10) || 'One bold word' || chr(10) || chr(10) || '* a' || chr(10) || '* b' AS markdown FROM part"),
    "run_abort": (run_abort, "SELECT 'pages' AS failed, false AS stops UNION ALL SELECT 'connection', true"),
    "discovered_events": (discovered_events, EVENTS_SQL),
    "discovery_audit": (discovery_audit, AUDIT_SQL),
    "queue_fan_out": (
        queue_fan_out,
        "SELECT o_custkey AS organiser_id, x AS event_url, count(*) AS n FROM (SELECT o_custkey, unnest(['https://' || c_name, 'https://all/']) AS x FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0) GROUP BY ALL",
    ),
    "scheduled_batches": (scheduled_batches, "SELECT user_id, 'batch 0' AS first_seen_at, 'batch 0' AS last_seen_at, count(*) AS events FROM events GROUP BY user_id"),
}
