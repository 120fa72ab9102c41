"""Addresses, links, robots, decisions, pacing, listings, queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from startline.functions import coerce, urls
from startline.operators import decide, listing, robots, store
from startline.plans import roles
from startline.plans.roles import table
from startline.sources import files, lookups

HOST_SQL = "regexp_replace(lower(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '')"
JUNK_SQL = "regexp_matches(lower({0}), '(" + "|".join(j.replace(".", "\\.") for j in urls.JUNK) + ")')"
LINKS_SQL = """hrefs AS (
  SELECT url, unnest(h) AS href, generate_subscripts(h, 1) AS n FROM (SELECT url, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1) AS h FROM pages)
), links AS (
  SELECT url, n, CASE WHEN href[1] = '/' AND href[2] <> '/' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
                      WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href END AS link FROM hrefs WHERE href <> ''
)"""


def url_normalise(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", urls.normal_url(F.concat(F.lit(" "), "url", F.repeat(F.lit("/"), (F.col("page_id") % 3).cast("int")), F.lit("\n"))).alias("url"))


def domain_root(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.site_root(u).alias("site"), urls.host(u).alias("host"), urls.robots_url(u).alias("robots"), urls.path_and_query(u).alias("path"))


def page_links_resolved(spark, d):
    found = listing.page_links(table(spark, d, "pages")).select("url", F.explode("links").alias("link"))
    return found.groupBy("url", "link").agg(F.count(F.lit(1)).alias("n"))


def candidate_links(spark, d):
    """Candidates of every page; pages of one url share them."""
    found = listing.links_by_url(table(spark, d, "pages"), urls.candidate_links)
    return found.select("url", F.array_join("links", " ").alias("candidates"))


def junk_links(spark, d):
    p = table(spark, d, "pages")
    link = F.concat("url", F.get(F.array(*[F.lit(x) for x in ("/login", "", "?x=1", "/Terms-of-use", "/basket/")]), (F.col("page_id") % 5).cast("int")))
    return p.select("page_id", link.alias("link"), urls.is_junk(link).alias("junk"))


def same_site_pairs(spark, d):
    """Hosts of pages against five fixed home pages."""
    homes = spark.createDataFrame([(x,) for x in HOMES], "home string")
    hosts = table(spark, d, "pages").select(urls.site_root(F.col("url")).alias("site")).distinct()
    return hosts.join(F.broadcast(homes), urls.same_site(F.col("site"), F.col("home")))


HOMES = ("https://www.blog.example/", "https://m.elsewhere.org/x", "http://news.example.com", "https://shop.test:8080/", "https://docs.other.net")


def robots_match(spark, d):
    sites = table(spark, d, "pages").select(urls.site_root(F.col("url")).alias("site")).distinct().where("site IS NOT NULL")
    n = F.length("site") % 4
    body = F.when(n == 0, F.lit("User-agent: *\nDisallow: /\nAllow: /*1\nCrawl-delay: 2")).when(n == 1, F.lit("User-agent: *\nDisallow: /*2$\n\nUser-agent: other\nDisallow: /")).otherwise(F.lit("# nothing\n"))
    answers = sites.select("site", F.when(n == 2, F.lit(503)).when(n == 3, F.lit(404)).otherwise(F.lit(200)).alias("status"), body.alias("body"))
    found = robots.allowed(table(spark, d, "pages").select("page_id", "url"), robots.rules(answers, "startline"))
    return found.select("page_id", "allowed")


def crawl_pacing(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("site"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("arrival"), ((F.col("user_id") % 4) * 20).cast("double").alias("delay"))
    return robots.paced(e, order=("event_id",)).select("event_id", "starts")


def geocode_throttle(spark, d):
    """One request a second over all: a queue left at the end of a range of time is carried into the next."""
    e = table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("arrival"))
    return robots.paced_together(e, 1.0, order=("event_id",)).select("event_id", "starts")


def crawl_requests(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    fields = {
        "allowed": k % 13 != 0, "known": k % 2 == 0, "page_status": F.when(k % 17 == 0, 404).when(k % 19 == 0, 410).when(k % 5 == 0, 200),
        "fetched": k % 23 != 0, "old_hash": F.sha2(F.col("event_type"), 256), "new_hash": F.sha2(F.when(k % 3 == 0, F.col("event_type")).otherwise(F.lit("new")), 256),
        "extracted": k % 29 != 0, "is_valid": k % 7 != 0, "invalid_reason": F.when(k % 14 == 0, F.lit("redirect")),
    }
    return e.select("event_id", "event_type", *[c.alias(n) for n, c in fields.items()])


def crawl_decision(mode):
    def query(spark, d):
        return decide.decide(crawl_requests(spark, d), mode).select("event_id", "action", "run_status", "detail")

    return query


def decision_sql(mode):
    return f"""WITH r AS (
  SELECT event_id AS k, CASE WHEN event_id % 17 = 0 THEN 404 WHEN event_id % 19 = 0 THEN 410 WHEN event_id % 5 = 0 THEN 200 END AS page_status FROM events
), a AS (
  SELECT k, page_status, CASE WHEN k % 13 = 0 THEN 'robots-skip' WHEN '{mode}' = 'url-check' AND k % 2 = 0 THEN 'url-skip' WHEN page_status IN (404, 410) THEN 'dead-link'
    WHEN k % 23 = 0 THEN 'fetch-failed' WHEN '{mode}' = 'hash-check' AND k % 2 = 0 AND k % 3 = 0 THEN 'unchanged' WHEN k % 29 = 0 THEN 'extraction-failed' ELSE 'upsert' END AS action FROM r
) SELECT k AS event_id, action, CASE WHEN action IN ('robots-skip', 'url-skip') THEN 'skipped' WHEN action LIKE '%-failed' THEN 'failed' ELSE 'success' END AS run_status,
  CASE action WHEN 'robots-skip' THEN 'disallowed by robots.txt' WHEN 'url-skip' THEN 'url already exists, skipped (url-check)' WHEN 'dead-link' THEN 'confirmed dead link (HTTP ' || page_status || ')'
    WHEN 'fetch-failed' THEN 'page could not be fetched' WHEN 'unchanged' THEN 'unchanged, skipped extraction' WHEN 'extraction-failed' THEN 'extraction returned no fields'
    ELSE CASE WHEN k % 7 <> 0 THEN 'extracted' WHEN k % 14 = 0 THEN 'extracted (invalid event: redirect)' ELSE 'extracted (invalid event: None)' END END AS detail FROM a"""


def crawl_audit_summary(spark, d):
    return decide.decide(crawl_requests(spark, d)).groupBy("run_status", "action").agg(F.count(F.lit(1)).alias("runs"))


def new_urls_anti_join(force):
    def query(spark, d):
        e = roles.events(spark, d)
        found = e.select("url", "organiser_id").unionByName(e.where("id % 5 = 0").select("url", "organiser_id"))
        return listing.new_urls(found, e.where("id % 3 = 0"), force)

    return query


def listing_run_summary(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("listing"), (F.col("value") > 10).alias("confirmed"), (F.col("event_id") % 3 == 0).alias("stored"))
    return listing.listing_summary(rows)


def snapshots(spark, d, name):
    """Every user's events as a listing: what it showed on each day of the month."""
    e = table(spark, d, "events").select(F.col("user_id").alias("listing"), (F.dayofmonth("ts") - 1).alias(name), (F.col("event_id") % 37).cast("string").alias("url"))
    return e.groupBy("listing", name).agg(F.collect_set("url").alias("urls"))


def pagination_stop(spark, d):
    s = snapshots(spark, d, "page").withColumn("page", F.col("page") + 1)
    return listing.paginate(s).select("listing", F.array_join("urls", ",").alias("urls"), F.col("pages").cast("int").alias("pages"))


PAGINATION_SQL = """WITH s AS (
  SELECT DISTINCT user_id AS listing, day(ts) AS page, CAST(event_id % 37 AS VARCHAR) AS url FROM events
), f AS (SELECT listing, url, min(page) AS first FROM s GROUP BY ALL
), p AS (SELECT DISTINCT listing, page, row_number() OVER (PARTITION BY listing ORDER BY page) AS n FROM (SELECT DISTINCT listing, page FROM s)
), g AS (SELECT p.listing, p.page, p.page <> p.n OR (p.page > 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.listing = p.listing AND f.first = p.page)) AS gap FROM p
), x AS (SELECT listing, min(CASE WHEN gap THEN page END) AS stop FROM g GROUP BY listing
), e AS (SELECT g.listing, max(g.page) AS pages FROM g JOIN x USING (listing) WHERE x.stop IS NULL OR g.page < x.stop GROUP BY g.listing)
SELECT e.listing, string_agg(f.url, ',' ORDER BY f.url) AS urls, CAST(e.pages AS INTEGER) AS pages FROM e JOIN f ON f.listing = e.listing AND f.first <= e.pages GROUP BY e.listing, e.pages"""


def append_stop(spark, d):
    return listing.append(snapshots(spark, d, "round")).select("listing", F.array_join(F.array_sort("urls"), ",").alias("urls"), F.col("rounds").cast("int").alias("rounds"))


APPEND_SQL = """WITH s AS (
  SELECT DISTINCT user_id AS listing, day(ts) - 1 AS round, CAST(event_id % 37 AS VARCHAR) AS url FROM events
), f AS (SELECT listing, url, min(round) AS first FROM s GROUP BY ALL
), g AS (SELECT DISTINCT s.listing, s.round, s.round > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.listing = s.listing AND f.first = s.round) AS gap FROM s
), x AS (SELECT listing, min(CASE WHEN gap THEN round END) AS stop FROM g GROUP BY listing
), e AS (SELECT g.listing, max(g.round) AS rounds FROM g JOIN x USING (listing) WHERE x.stop IS NULL OR g.round < x.stop GROUP BY g.listing)
SELECT e.listing, string_agg(s.url, ',' ORDER BY s.url) AS urls, CAST(e.rounds AS INTEGER) AS rounds FROM e JOIN s ON s.listing = e.listing AND s.round = e.rounds GROUP BY e.listing, e.rounds"""


def recursive_pagination(spark, d):
    n = table(spark, d, "nation")
    links = n.select(F.col("n_name").alias("url"), F.col("n_nationkey").alias("k")).alias("a")
    following = n.select(F.col("n_name").alias("next_url"), F.col("n_nationkey").alias("k2")).alias("b")
    chain = links.join(following, (F.col("k") * 2 + 1) % 25 == F.col("k2")).select("url", "next_url")
    return listing.follow(chain, n.select(F.col("n_name").alias("url")))


RECURSIVE_SQL = """WITH RECURSIVE links AS (SELECT a.n_name AS url, b.n_name AS next_url FROM nation a JOIN nation b ON (a.n_nationkey * 2 + 1) % 25 = b.n_nationkey
), walk AS (SELECT n_name AS start_url, n_name AS url, 1 AS step, [n_name] AS seen FROM nation
  UNION ALL SELECT w.start_url, l.next_url, w.step + 1, list_append(w.seen, l.next_url) FROM walk w JOIN links l ON l.url = w.url WHERE w.step < 50 AND NOT list_contains(w.seen, l.next_url))
SELECT start_url, url, step FROM walk"""


def sanity_first_per_organiser(spark, d):
    return decide.planned(roles.events(spark, d).select("organiser_id", "url"), "sanity-check")


def listing_source_ladder(spark, d):
    c = table(spark, d, "customer")
    none, k = F.array().cast("array<string>"), F.col("c_custkey")
    one = lambda x: F.array(F.concat(F.lit(x), k.cast("string")))
    o = c.select(k.alias("id"), F.when(k % 3 == 0, F.when(k % 2 == 0, none).otherwise(one("s"))).alias("sitemap_urls"), F.when(k % 5 == 0, one("l")).otherwise(none).alias("listing_urls"), F.when(k % 7 == 0, one("d")).alias("discovered_urls"))
    return listing.listing_source(o).select("id", "source", F.array_join("listing", ",").alias("listing"))


def handler_registry(spark, d):
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("handler"))
    return decide.pick_handler(o, ["default", "building", "machinery"])


def fetch_fallback(spark, d):
    """Each page asked for by its own id: pages may share an address."""
    p = table(spark, d, "pages")
    page = lambda rows, name: rows.select("page_id", F.lit(name).alias("markdown"), F.array().cast("array<string>").alias("links"), F.col("html"), F.col("url").alias("final_url"))
    out = lookups.fetch(p.select("page_id", "url"), page(p.where("page_id % 3 = 0"), "first"), page(p.where("page_id % 2 = 0"), "second"), key="page_id")
    return out.select("page_id", "markdown", F.length("html").cast("long").alias("size"), "fetched")


def liveness_probe(spark, d):
    """Each page probed by its own id: pages may share an address."""
    p = table(spark, d, "pages")
    k = F.col("page_id")
    probes = p.where("page_id % 4 <> 0").select("page_id", F.when(k % 3 == 0, 405).when(k % 5 == 0, 404).otherwise(200).alias("head_status"), F.when(k % 2 == 0, 410).otherwise(200).alias("get_status"))
    out = lookups.liveness(p.select("page_id", "url"), probes, key="page_id")
    return out.select("page_id", "page_status", F.coalesce(F.col("page_status").isin(*coerce.GONE), F.lit(False)).alias("dead"))


def props_json(spark, d):
    """Queue envelopes built from events and decoded again."""
    e = table(spark, d, "events")
    inner = F.to_json(F.struct(F.col("user_id").alias("organiser_id"), F.concat(F.lit("https://e/"), F.col("event_id").cast("string")).alias("event_url")))
    key = F.when(F.col("event_id") % 10 == 0, F.lit("messages")).otherwise(F.lit("message"))
    body = F.concat(F.lit('{"'), key, F.lit('":{"data":"'), F.base64(F.encode(inner, "UTF-8")), F.lit('"}}'))
    m = files.decode_message(F.regexp_replace(body, r"\r?\n", ""), "organiser_id long, event_url string")
    return e.select("event_id", m["organiser_id"].alias("organiser_id"), m["event_url"].alias("event_url"))


def queue_dedupe(spark, d):
    """What repeated delivery leaves after an upsert by key: the last message of each user and type."""
    e = table(spark, d, "events")
    last = store.latest(e.withColumns({"key": F.concat_ws("/", F.col("user_id").cast("string"), "event_type"), "at": F.struct("ts", "event_id")}), "key", "at")
    return last.select("key", "event_id")


def queue_stream(spark, d):
    """A stream of the events file, repeats within a year's watermark dropped, drained into a shared folder."""
    from startline.streaming import queue

    # a file source takes folders or globs; the glob names one file and works in any store
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = queue.once(source, "ts", ["user_id", "event_type"], "365 days").select("user_id", "event_type")
    return store.drained(rows, "queue")


def windowed_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def catalog_columns(spark, d):
    return files.columns_of({n: table(spark, d, n) for n in ("region", "nation", "customer")}).select("table_name", "column_name", F.col("position").cast("int").alias("position"))


def registrator_scan(spark, d):
    c = table(spark, d, "customer")
    own = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    return c.select("c_custkey", files.registrator(own).alias("registrator"))


def weekly_rule_expand(spark, d):
    """Every date of weekly events in the four weeks from their start; each event's weekday follows its id."""
    e = roles.events(spark, d)
    first = F.expr("date_add(starts, cast(pmod(id - weekday(starts), 7) as int))")
    return e.withColumn("first", first).select("id", F.explode(F.expr("sequence(first, date_add(first, 27), interval 7 days)")).alias("day"))


def near_me(spark, d):
    """Venues within 2 000 km of a point, by the haversine formula; a box on the latitude comes first."""
    s = table(spark, d, "supplier")
    lat, lon = F.col("s_suppkey") % 120 - 60, (F.col("s_suppkey") * 7) % 360 - 180
    a = F.pow(F.sin(F.radians(lat - 10) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(10))) * F.pow(F.sin(F.radians(lon - 20) / 2), 2)
    km = 2 * 6371.0 * F.asin(F.sqrt(a))
    return s.withColumn("km", km).where(lat.between(-10, 30) & (F.col("km") <= 2000)).select("s_suppkey", F.round("km", 3).alias("km"))


def wide_union_sets(spark, d):
    """Union, intersection and difference of address sets."""
    e = roles.events(spark, d)
    a, b = e.where("id % 2 = 0").select("url"), e.where("id % 3 = 0").select("url")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
    return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "both")).union(n(a.exceptAll(b), "only first"))


def missing_links(spark, d):
    """Links of every page that are not confirmed; pages of one url share them."""
    confirmed = lambda links: F.filter(links, lambda u: F.length(u) % 2 == 0)
    found = listing.links_by_url(table(spark, d, "pages"), lambda links, _: F.array_except(links, confirmed(links)))
    return found.select("url", F.array_join("links", " ").alias("missing"))


QUERIES = {
    "url_normalise": (url_normalise, "SELECT page_id, regexp_replace(url, '/+$', '') || '/' AS url FROM pages"),
    "domain_root": (
        domain_root,
        f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, {HOST_SQL.format("url")} AS host,
  regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS rest FROM pages)
SELECT page_id, site, host, site || '/robots.txt' AS robots, CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS path FROM p""",
    ),
    "page_links_resolved": (page_links_resolved, f"WITH {LINKS_SQL} SELECT url, link, count(*) AS n FROM links GROUP BY ALL"),
    "candidate_links": (
        candidate_links,
        f"""WITH {LINKS_SQL}, h AS (SELECT *, {HOST_SQL.format("link")} AS a, {HOST_SQL.format("url")} AS b FROM links),
x AS (SELECT url, string_agg(DISTINCT link, ' ' ORDER BY link) AS candidates FROM h WHERE NOT {JUNK_SQL.format("link")} AND (a = b OR ends_with(a, '.' || b) OR split_part(a, '.', 1) = split_part(b, '.', 1)) GROUP BY url)
SELECT url, coalesce(candidates, '') AS candidates FROM pages LEFT JOIN x USING (url)""",
    ),
    "junk_links": (junk_links, f"WITH p AS (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/login' WHEN 1 THEN '' WHEN 2 THEN '?x=1' WHEN 3 THEN '/Terms-of-use' ELSE '/basket/' END AS link FROM pages) SELECT page_id, link, {JUNK_SQL.format('link')} AS junk FROM p"),
    "same_site_pairs": (
        same_site_pairs,
        f"""WITH s AS (SELECT DISTINCT regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site FROM pages), h AS (SELECT unnest({list(HOMES)}) AS home),
x AS (SELECT site, home, {HOST_SQL.format("site")} AS a, {HOST_SQL.format("home")} AS b FROM s, h) SELECT site, home FROM x WHERE a = b OR ends_with(a, '.' || b) OR split_part(a, '.', 1) = split_part(b, '.', 1)""",
    ),
    "robots_match": (
        robots_match,
        """WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS path FROM pages)
SELECT page_id, CASE length(site) % 4 WHEN 0 THEN contains(path, '1') WHEN 1 THEN NOT ends_with(path, '2') WHEN 2 THEN false ELSE true END AS allowed FROM p""",
    ),
    "crawl_pacing": (
        crawl_pacing,
        """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS a, CAST(least(30, user_id % 4 * 20) AS DOUBLE) AS d, CAST(row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) - 1 AS DOUBLE) AS n FROM events)
SELECT event_id, CASE WHEN d > 0 THEN n * d + max(a - n * d) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) ELSE a END AS starts FROM e""",
    ),
    "geocode_throttle": (
        geocode_throttle,
        """WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS a, CAST(row_number() OVER (ORDER BY floor(epoch(ts)), event_id) - 1 AS DOUBLE) AS n FROM events)
SELECT event_id, n + max(a - n) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS starts FROM e""",
    ),
    "crawl_decision": (crawl_decision("hash-check"), decision_sql("hash-check")),
    "crawl_decision_url_check": (crawl_decision("url-check"), decision_sql("url-check")),
    "crawl_decision_force": (crawl_decision("force"), decision_sql("force")),
    "crawl_audit_summary": (crawl_audit_summary, f"SELECT run_status, action, count(*) AS runs FROM ({decision_sql('hash-check')}) GROUP BY ALL"),
    "new_urls_anti_join": (new_urls_anti_join(False), "SELECT 'https://events.example/' || o_orderkey || '/' AS url, o_custkey AS organiser_id FROM orders WHERE o_orderkey % 3 <> 0"),
    "force_all": (new_urls_anti_join(True), "SELECT 'https://events.example/' || o_orderkey || '/' AS url, o_custkey AS organiser_id FROM orders"),
    "listing_run_summary": (listing_run_summary, "SELECT user_id AS listing, count(*) AS candidates, count(*) FILTER (value > 10) AS confirmed, count(*) FILTER (value > 10 AND event_id % 3 <> 0) AS new FROM events GROUP BY user_id"),
    "pagination_stop": (pagination_stop, PAGINATION_SQL),
    "append_stop": (append_stop, APPEND_SQL),
    "recursive_pagination": (recursive_pagination, RECURSIVE_SQL),
    "sanity_first_per_organiser": (sanity_first_per_organiser, "SELECT o_custkey AS organiser_id, min('https://events.example/' || o_orderkey || '/') AS url FROM orders GROUP BY o_custkey"),
    "listing_source_ladder": (
        listing_source_ladder,
        """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'sitemap' WHEN c_custkey % 5 = 0 THEN 'stored' ELSE 'discovered' END AS source,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 's' || c_custkey END WHEN c_custkey % 5 = 0 THEN 'l' || c_custkey WHEN c_custkey % 7 = 0 THEN 'd' || c_custkey ELSE '' END AS listing FROM customer""",
    ),
    "handler_registry": (
        handler_registry,
        """SELECT c_custkey AS id, lower(c_mktsegment) AS handler, lower(c_mktsegment) IN ('default', 'building', 'machinery') AS handler_known,
  CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN lower(c_mktsegment) ELSE 'default' END AS handler_used FROM customer""",
    ),
    "fetch_fallback": (
        fetch_fallback,
        "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'first' WHEN page_id % 2 = 0 THEN 'second' END AS markdown, CASE WHEN page_id % 3 = 0 OR page_id % 2 = 0 THEN length(html) END AS size, page_id % 3 = 0 OR page_id % 2 = 0 AS fetched FROM pages",
    ),
    "liveness_probe": (
        liveness_probe,
        """WITH p AS (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 410 ELSE 200 END WHEN page_id % 5 = 0 THEN 404 ELSE 200 END END AS page_status FROM pages)
SELECT page_id, page_status, coalesce(page_status IN (404, 410), false) AS dead FROM p""",
    ),
    "props_json": (props_json, "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS organiser_id, CASE WHEN event_id % 10 <> 0 THEN 'https://e/' || event_id END AS event_url FROM events"),
    "queue_dedupe": (queue_dedupe, "SELECT user_id || '/' || event_type AS key, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type"),
    "queue_stream": (queue_stream, "SELECT DISTINCT user_id, event_type FROM events"),
    "windowed_counts": (windowed_counts, "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "catalog_columns": (catalog_columns, "SELECT * FROM (VALUES ('region', 'r_regionkey', 0), ('region', 'r_name', 1), ('nation', 'n_nationkey', 0), ('nation', 'n_name', 1), ('nation', 'n_regionkey', 2), ('customer', 'c_custkey', 0), ('customer', 'c_name', 1), ('customer', 'c_nationkey', 2), ('customer', 'c_acctbal', 3), ('customer', 'c_mktsegment', 4)) t(table_name, column_name, position)"),
    "registrator_scan": (registrator_scan, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'bot' END AS registrator FROM customer"),
    "weekly_rule_expand": (
        weekly_rule_expand,
        """WITH e AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS starts FROM orders),
f AS (SELECT id, starts + CAST(((id - (isodow(starts) - 1)) % 7 + 7) % 7 AS INTEGER) AS first FROM e)
SELECT id, CAST(first + CAST(w * 7 AS INTEGER) AS DATE) AS day FROM f, range(4) r(w)""",
    ),
    "near_me": (
        near_me,
        """WITH s AS (SELECT s_suppkey, s_suppkey % 120 - 60 AS lat, (s_suppkey * 7) % 360 - 180 AS lon FROM supplier),
k AS (SELECT s_suppkey, lat, 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2))) AS km FROM s)
SELECT s_suppkey, round(km, 3) AS km FROM k WHERE lat BETWEEN -10 AND 30 AND km <= 2000""",
    ),
    "wide_union_sets": (wide_union_sets, "SELECT 'union' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 UNION ALL SELECT 'both', count(*) FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'only first', count(*) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0"),
    "missing_links": (missing_links, f"WITH {LINKS_SQL}, x AS (SELECT url, string_agg(DISTINCT link, ' ' ORDER BY link) AS missing FROM links WHERE length(link) % 2 <> 0 GROUP BY url) SELECT url, coalesce(missing, '') AS missing FROM pages LEFT JOIN x USING (url)"),
}
