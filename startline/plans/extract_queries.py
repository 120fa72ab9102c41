"""Structured data, model answers, places, dates, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from startline.functions import coerce, dates, markup, text
from startline.operators import extract, feed, store
from startline.plans import roles
from startline.plans.roles import table
from startline.sources import lookups


def location_text(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    county = F.when(F.col("s_suppkey") % 3 == 0, F.lit("-Unknown-")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" "), "s_name", F.lit("\t")))
    state = F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.lit("  "))
    return s.select("s_suppkey", feed.location_text(county, state, F.col("r_name")).alias("location"))


def feed_rows(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    cells = {
        "Event": F.when(k % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "s_name")), "Latitude": F.when(k % 5 == 0, F.lit("north")).when(k % 7 == 0, F.lit("")).otherwise(k.cast("string")),
        "Longitude": (k * 2).cast("string"), "Country": F.when(k % 2 == 0, F.lit(feed.DEFAULT_COUNTRY)).otherwise(F.col("n_name")), "State": F.lit(feed.UNKNOWN), "County": F.col("n_name"),
        "Status": F.when(k % 3 == 0, F.lit(" Junior Parkrunning")).otherwise(F.lit("running")), "Cancellations": F.lit(""), "Website": F.concat(F.lit("https://f.example/"), k.cast("string"), F.lit("//")),
    }
    return s.select(*[c.alias(n) for n, c in cells.items()])


def feed_import(spark, d):
    e = feed.feed_events(feed_rows(spark, d), "2024-05-01")
    d1 = F.get("distances", F.lit(0))
    return e.select("url", "name", "date_text", "location", "age_restriction_text", d1["distance_text"].alias("distance"), d1["distance_category"].alias("category"), F.array_join("occurrence_weekdays", ",").alias("weekdays"), "latitude", "longitude")


def feed_to_store(spark, d):
    """The feed's events as stored rows with their race types, registered twice: the second changes nothing but times."""
    e = feed.feed_events(feed_rows(spark, d), "2024-05-01")
    rows = extract.event_rows(e, F.lit("bot")).select("url", "name", "status", "occurrence", "occurrence_time", "occurrence_starts_on")
    empty = rows.limit(0).withColumns({"first_seen_at": F.lit("").cast("string"), "last_seen_at": F.lit("").cast("string")})
    once = store.upsert(empty, rows, "url", F.lit("day 1"), touch=("last_seen_at",))
    return store.upsert(once, rows, "url", F.lit("day 2"), touch=("last_seen_at",))


def ld_pages(spark, d):
    """Pages built from orders, in every shape that structured data comes in."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    address = F.to_json(F.struct(F.col("c_mktsegment").alias("streetAddress"), F.concat(F.lit("Town "), k.cast("string")).alias("addressLocality")))
    body = F.concat(
        F.lit('{"@context":"https://schema.org","@type":'), F.when(k % 3 == 0, F.lit('["Thing","SportsEvent"]')).when(k % 7 == 0, F.lit('"Person"')).otherwise(F.lit('"Event"')),
        F.lit(',"name":"'), F.col("c_name"), F.lit(' &amp; friends","sport":" RUNNING ","startDate":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"'),
        F.when(k % 4 == 0, F.lit(',"endDate":"2030-01-01"')).otherwise(F.lit("")), F.lit(',"location":{"@type":"Place","name":"Hall","address":'),
        F.when(k % 5 == 0, F.lit('"1 Plain Street"')).otherwise(address), F.lit("}}"),
    )
    shaped = F.when(k % 11 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(k % 13 == 0, F.concat(F.lit('{"@graph":[{"@type":"WebSite"},'), body, F.lit("]}"))).when(k % 17 == 0, F.concat(body, F.lit("}"))).otherwise(body)
    return o.select("o_orderkey", F.concat(F.lit("<html><script type=\"text/javascript\">x</script><script type='application/ld+json'>not json</script><SCRIPT type=\"application/ld+json\">"), shaped, F.lit("</script></html>")).alias("html"))


def jsonld_extract(spark, d):
    return markup.with_structured_fields(ld_pages(spark, d).withColumn("event", markup.first_event(F.col("html"))), "event", "found").select("o_orderkey", "found.*")


JSONLD_SQL = """WITH o AS (SELECT o_orderkey, o_orderkey AS k, c_name, c_mktsegment, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON o_custkey = c_custkey),
x AS (SELECT *, (k % 3 = 0 OR k % 7 <> 0) AND (k % 11 = 0 OR k % 13 = 0 OR k % 17 <> 0) AS ok FROM o)
SELECT o_orderkey, CASE WHEN ok THEN c_name || ' & friends' END AS name, CASE WHEN ok THEN 'running' END AS sport, CAST(NULL AS VARCHAR) AS summary,
  CASE WHEN ok THEN day || CASE WHEN k % 4 = 0 THEN ' to 2030-01-01' ELSE '' END END AS date_text,
  CASE WHEN ok THEN 'Hall, ' || CASE WHEN k % 5 = 0 THEN '1 Plain Street' ELSE c_mktsegment || ', Town ' || k END END AS location FROM x"""


def answers(spark, d):
    """Model answers of uneven quality, one for each document."""
    k = F.col("doc_id")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    text_ = F.concat(
        F.lit('{"name":"Answer '), k.cast("string"), F.lit('","date_text":'), pick('"Sundays"', '""', "null"), F.lit(',"occurrence":'), pick('" Weekly "', '"one_off"', '"fortnightly"', "7"),
        F.lit(',"is_valid_event":'), pick("true", "false", '"false"', "null", "0"), F.lit(',"invalid_reason":" gone "'), F.lit(',"registration_status":'), pick('"OPEN"', '"maybe"', "null"),
        F.lit(',"lifecycle_status":'), pick('"cancelled"', "[]", '"Postponed "'), F.lit(',"occurrence_weekdays":'), pick('["SUN","sat","noday",3,"sat"]', '"mon"', "[]"),
        F.lit(',"distances":[{"distance_text":"5k","price_text":"","distance_category":" 5_K "},{"price_text":"x"},"10k",{"distance_text":10,"price_text":12.5}]'),
        F.lit(',"occurrences":[{"date_text":"1 May","date_iso":"2024-05-01","time_24h":"9:5"},{"date_text":"2 May"},{"date_text":"3 May","date_iso":"soon"},{"date_text":"again","date_iso":"2024-05-01","time_24h":"09:05"}]'),
        F.lit(',"registration_opens_date_iso":"2024-02-30","registration_closes_date_iso":"20240301","registration_closes_time_24h":"25:00"}'),
    )
    return table(spark, d, "documents").select(k.cast("string").alias("url"), F.col("text").alias("markdown"), k, F.when(k % 31 == 0, F.lit("{bad")).otherwise(text_).alias("text_"))


def extracted(spark, d):
    a = answers(spark, d)
    k = F.col("doc_id")
    known = F.struct(F.when(k % 2 == 0, F.lit("Known")).alias("name"), F.lit(None).cast("string").alias("sport"), F.lit(None).cast("string").alias("summary"), F.when(k % 4 != 0, F.lit("2023-04-30")).alias("date_text"), F.lit("Park").alias("location"))
    asked = lookups.answered(a.select("url", "markdown", known.alias("known")), a.select(F.lit("extract_event").alias("task"), F.col("url").alias("key"), F.col("text_").alias("answer")), "extract_event", "url")
    return extract.event_fields(asked)


def known_vs_llm_merge(spark, d):
    return extracted(spark, d).select("url", "name", "date_text", "location", "occurrence")


def answer_coercion(spark, d):
    return extracted(spark, d).select(
        "url", "occurrence", "registration_status", "lifecycle_status", "is_valid_event", "invalid_reason", F.array_join("occurrence_weekdays", ",").alias("weekdays"),
        F.array_join(F.transform("distances", lambda x: F.concat_ws("|", x["distance_text"], F.coalesce(x["price_text"], F.lit("-")), F.coalesce(x["distance_category"], F.lit("-")))), ";").alias("distances"),
    )


def occurrence_explode(spark, d):
    return store.occurrence_rows(extracted(spark, d)).select("url", "sort_order", "starts_at", "date_text")


def date_parse(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.when(k % 5 == 0, F.lit("2024-02-30")).when(k % 5 == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 5 == 2, F.lit("2024-8-18")).otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n")))
    time = F.when(k % 4 == 0, F.lit("9:5")).when(k % 4 == 1, F.lit("25:00")).when(k % 4 == 2, F.lit("18:30"))
    return o.select("o_orderkey", dates.iso_date(day).alias("day"), dates.clock(time).alias("clock"), dates.moment(day, time).alias("at"))


DATE_SQL = """WITH o AS (SELECT o_orderkey, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
x AS (SELECT o_orderkey, CASE WHEN k % 5 IN (1, 3, 4) THEN d END AS day, CASE k % 4 WHEN 0 THEN '09:05' WHEN 2 THEN '18:30' END AS clock FROM o)
SELECT o_orderkey, day, clock, CAST(CAST(day AS VARCHAR) || ' ' || coalesce(clock, '00:00') || ':00' AS TIMESTAMP) AS at FROM x"""


def postcode_extract(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    place = F.when(k % 4 == 0, F.concat(F.lit("Hall, Town. de"), (k % 90 + 10).cast("string"), F.lit(" 1ah"))).when(k % 4 == 1, F.lit("SW1A1AA and M1 1AE")).when(k % 4 == 2, F.lit("no code 12345")).otherwise(F.col("s_name"))
    return s.select("s_suppkey", text.uk_postcode(place).alias("postcode"))


def geocode_ladder(spark, d):
    """Places known only by postcode, by start, or not at all; what was known before stays."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    fields = s.select(
        k.cast("string").alias("url"), F.when(k % 3 == 0, F.concat(F.lit("Unlisted Hall, DE45 1AH"))).when(k % 3 == 1, F.lit("  ")).otherwise(F.lit("Nowhere")).alias("location"),
        F.when(k % 3 == 1, F.lit("Start Field")).alias("start_location"), F.lit(None).cast("string").alias("finish_location"), F.when(k % 10 == 0, F.lit(1.0)).alias("latitude"), F.when(k % 10 == 0, F.lit(2.0)).alias("longitude"),
    )
    places = spark.createDataFrame([("DE45 1AH", 1, 53.2, -1.6), ("DE45 1AH", 2, 0.0, 0.0), ("Start Field", 1, 10.0, 20.0)], lookups.PLACES)
    before = s.where("s_suppkey % 2 = 0").select(k.cast("string").alias("url"), F.lit(5.0).alias("latitude"), F.lit(6.0).alias("longitude"))
    return extract.with_coordinates(fields, places, before).select("url", "latitude", "longitude")


def maps_url(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    return s.select("s_suppkey", text.maps_url(F.when(k % 3 == 0, (k % 90).cast("int")), F.when(k % 2 == 0, (k % 180).cast("int")), F.when(k % 5 != 0, F.concat("n_name", F.lit(" ~ & * é"))), F.lit(""), F.when(k % 7 == 0, F.col("s_name"))).alias("url"))


MAPS_SQL = """WITH s AS (SELECT s_suppkey AS k, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
q AS (SELECT k, CASE WHEN k % 6 = 0 THEN (k % 90) || ',' || (k % 180) WHEN k % 5 <> 0 THEN replace(n_name, ' ', '+') || '+~+%26+%2A+%C3%A9' WHEN k % 7 = 0 THEN replace(replace(s_name, '#', '%23'), ' ', '+') END AS q FROM s)
SELECT k AS s_suppkey, 'https://www.google.com/maps/search/?api=1&query=' || q AS url FROM q"""


def model_indices(spark, d):
    """Index answers against a page's five candidates: booleans, text, repeats and what is out of range go."""
    p = table(spark, d, "pages")
    k = F.col("page_id")
    candidates = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("https://c/"), k.cast("string"), F.lit("/"), i.cast("string")))
    answer = F.parse_json(F.concat(F.lit('{"event_indices":[3,99,-1,"2",true,3,'), (k % 5).cast("string"), F.lit('],"next_page_index":'), F.when(k % 2 == 0, (k % 7).cast("string")).otherwise(F.lit("null")), F.lit("}")))
    out = extract.listing_answer(p.select("page_id", candidates.alias("candidates"), answer.alias("answer")))
    return out.select("page_id", F.array_join("event_urls", " ").alias("event_urls"), "next_page", coerce.answer_budget(k * 10).alias("budget"))


def interaction_kinds(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id")
    answer = F.parse_json(F.concat(F.lit('{"interaction_type":"'), F.get(F.array(*[F.lit(x) for x in (" Append", "paginate", "PAGINATE", "scroll")]), (k % 4).cast("int")), F.lit('","selector":'), F.when(k % 3 == 0, F.lit('" "')).otherwise(F.lit('"#more"')), F.lit("}")))
    return extract.more_control(p.select("page_id", answer.alias("answer"))).select("page_id", "interaction", "selector")


def listing_guard(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id").cast("string")
    answer = F.parse_json(F.concat(F.lit('{"listing_urls":["https://a/'), k, F.lit('","https://evil/","https://home/",5,"https://a/'), k, F.lit('"]}')))
    out = extract.discovered_listings(p.select("page_id", F.array(F.concat(F.lit("https://a/"), k), F.lit("https://b/")).alias("candidates"), F.lit("https://home/").alias("homepage_url"), answer.alias("answer")))
    return out.select("page_id", F.array_join("listing_urls", " ").alias("listing_urls"))


def sitemap_locations(spark, d):
    """Url sets and indexes built from pages, gone through with one picked part."""
    from startline.operators import listing

    p = table(spark, d, "pages")
    k = F.col("page_id")
    urlset = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://s.example/e/'), k.cast("string"), F.lit("</loc></url><url><loc>https://s.example/login</loc></url><url><loc>https://off.test/</loc></url><other><loc>https://s.example/no</loc></other></urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>https://s.example/none.xml</loc></sitemap><sitemap><loc>https://s.example/"), (k + 1 - k % 3).cast("string"), F.lit(".xml</loc></sitemap></sitemapindex>"))
    files = p.select(F.concat(F.lit("https://s.example/"), k.cast("string"), F.lit(".xml")).alias("url"), F.when(k % 3 == 0, index).when(k % 3 == 1, urlset).otherwise(F.lit("<rss/>")).alias("xml"))
    picked = files.select(F.col("url").alias("sitemap_url"), F.parse_json(F.lit("[1]")).alias("picked"))
    found = listing.sitemap_events(files.select(F.col("url").alias("sitemap_url"), F.lit("https://s.example").alias("homepage_url")), files, picked)
    return found.select("sitemap_url", F.array_join("event_urls", " ").alias("event_urls"))


def seed_params(spark, d):
    from startline.sources.files import handler_params

    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    m = handler_params(F.when(k % 2 == 0, F.lit('{"a":"1","sitemap_url":"old"}')).otherwise(F.lit("")), F.when(k % 3 == 0, F.concat(F.lit("s"), k.cast("string"))).otherwise(F.lit("")))
    return c.select("c_custkey", m["a"].alias("a"), m["sitemap_url"].alias("sitemap_url"), m.isNull().alias("none"))


def robots_sitemap(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id")
    body = F.concat(F.lit("User-agent: *\n"), F.when(k % 3 != 0, F.concat(F.lit("  SiteMap:\t https://s/"), k.cast("string"), F.lit(" \nsitemap: second"))).otherwise(F.lit("Sitemap:\nDisallow: /")))
    url = text.sitemap_directive(body)
    return p.agg(F.count_if(url.isNotNull()).alias("found"), F.count(F.lit(1)).alias("total"), F.min(url).alias("first"))


def main_content_text(spark, d):
    return table(spark, d, "pages").select("page_id", markup.page_text("html").alias("markdown"))


def dense_content(spark, d):
    """Main content of pages by text density; tests hold a plain version beside it."""
    return table(spark, d, "pages").select("page_id", markup.page_content("html").alias("markdown"))


def load_more_excerpt(spark, d):
    """Excerpts of documents grown past the limit, with keywords at known places."""
    k = F.col("doc_id")
    pad = lambda n: F.repeat(F.lit("x"), n)
    html = F.when(k % 2 == 0, F.concat(pad(20_000), F.lit("LOAD MORE"), pad(F.lit(500) + (k % 3 * 900).cast("int")), F.lit("pagination"), pad(50_000))).otherwise(F.lit("<button>load more</button>"))
    cut = text.let(text.excerpt(html), lambda e: F.struct(F.length(e).cast("long").alias("size"), F.sha2(e, 256).alias("sha")))
    return table(spark, d, "documents").select("doc_id", cut.alias("e")).select("doc_id", "e.*")


EXCERPT_SQL = """WITH h AS (SELECT doc_id, doc_id % 2 = 0 AS long, repeat('x', 20000) || 'LOAD MORE' || repeat('x', CAST(500 + doc_id % 3 * 900 AS BIGINT)) || 'pagination' || repeat('x', 50000) AS html, 20009 + 500 + doc_id % 3 * 900 AS p FROM documents),
e AS (SELECT doc_id, CASE WHEN NOT long THEN '<button>load more</button>' WHEN p - 300 <= 21500 THEN html[1:4000] || chr(10) || '...' || chr(10) || html[19701:p + 1500]
  ELSE html[1:4000] || chr(10) || '...' || chr(10) || html[19701:21500] || chr(10) || '...' || chr(10) || html[p - 300 + 1:p + 1500] END AS e FROM h)
SELECT doc_id, length(e) AS size, sha256(e) AS sha FROM e"""


def click_selectors(spark, d):
    """The control of generated listings: unique by text, by ancestor, or by a checked guess."""
    p = table(spark, d, "pages")
    k = F.col("page_id")
    html = F.when(k % 3 == 0, F.lit('<div id="a"><button class="b c">Book</button></div><div id="m"><button class="b c">Load more</button></div>')).when(k % 3 == 1, F.lit('<a id="go" title="Next page">&raquo;</a>')).otherwise(F.lit("<i class='x'>1</i><a>load more</a><a>load more</a>"))
    kind = F.when(k % 3 == 1, F.lit("paginate")).otherwise(F.lit("append"))
    return p.select("page_id", markup.click_selector(html, kind, F.lit("i.x")).alias("selector"), markup.selector_count(html, F.lit("button.b")).alias("n"))


def price_repair(spark, d):
    p = store.spread(table(spark, d, "part").select("p_partkey"), "p_partkey")
    k = F.col("p_partkey")
    page = F.concat(F.lit("Race\nSelect Distance 5K  10K  Half Marathon\n"), F.when(k % 2 == 0, F.lit("5K\n")).otherwise(F.lit("")), F.lit("£28\n10K\n£"), (k % 40).cast("string"), F.lit("\nHalf Marathon\n£36"))
    return p.select("p_partkey", F.sha2(markup.prices_repaired(page), 256).alias("sha"))


def browser_script(spark, d):
    from startline.operators import listing

    p = table(spark, d, "region")
    acts = F.concat(listing.actions("click", 2, 'a[x="1"]'), listing.actions("scroll", 1))
    return p.select("r_regionkey", listing.script(acts).alias("script"), F.size(acts).alias("n"))


def dispatch_params(spark, d):
    p = table(spark, d, "part")
    m = text.key_values(F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("q=a=b"), F.col("p_size").cast("string")), F.lit("flag"), F.lit("brand=last")))
    return p.select("p_partkey", m["brand"].alias("brand"), m["q"].alias("q"), m["flag"].alias("flag"), F.size(m).alias("n"))


def prompt_pruning(spark, d):
    k = F.col("r_regionkey")
    known = F.struct(F.when(k % 2 == 0, F.lit("n")).alias("name"), F.lit("run").alias("sport"), F.lit("").alias("summary"), F.lit("d").alias("date_text"), F.lit(None).cast("string").alias("location"))
    asked = extract.asked_fields(known)
    return table(spark, d, "region").select("r_regionkey", F.size(asked).alias("n"), F.array_contains(asked, "name").alias("name"), F.array_contains(asked, "sport").alias("sport"), F.array_contains(asked, "date_text").alias("date_text"))


ANSWER_SQL = """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS url, doc_id AS k FROM documents WHERE doc_id % 31 <> 0 AND length(regexp_replace(text, '\\s+', '', 'g')) > 0),
b AS (SELECT url, k, CASE k % 4 WHEN 0 THEN 'weekly' ELSE 'one_off' END AS occurrence, k % 5 <> 1 AS is_valid_event FROM a)"""
QUERIES = {
    "location_text": (location_text, "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN s_name || ', ' ELSE '' END || CASE WHEN s_suppkey % 2 = 0 THEN n_name || ', ' ELSE '' END || r_name AS location FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "feed_import": (
        feed_import,
        """SELECT 'https://f.example/' || s_suppkey || '/' AS url, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Every Sunday, 9:00am' ELSE 'Every Saturday, 9:00am' END AS date_text, n_name || ', United Kingdom' AS location,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Ages 4-14' END AS age_restriction_text, CASE WHEN s_suppkey % 3 = 0 THEN '2k' ELSE '5k' END AS distance, CASE WHEN s_suppkey % 3 = 0 THEN '2_k' ELSE '5k' END AS category,
  CASE WHEN s_suppkey % 3 = 0 THEN 'sun' ELSE 'sat' END AS weekdays, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS DOUBLE) END AS latitude, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey * 2 AS DOUBLE) END AS longitude
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0 AND s_suppkey % 11 <> 0""",
    ),
    "feed_to_store": (
        feed_to_store,
        """SELECT 'https://f.example/' || s_suppkey || '/' AS url, s_name AS name, 'valid' AS status, 'weekly' AS occurrence, '09:00' AS occurrence_time, DATE '2024-05-01' AS occurrence_starts_on, 'day 1' AS first_seen_at, 'day 2' AS last_seen_at
FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 11 <> 0""",
    ),
    "jsonld_extract": (jsonld_extract, JSONLD_SQL),
    "known_vs_llm_merge": (
        known_vs_llm_merge,
        ANSWER_SQL + """ SELECT url, CASE WHEN k % 2 = 0 THEN 'Known' ELSE 'Answer ' || k END AS name,
  CASE WHEN k % 4 = 0 THEN CASE WHEN k % 3 = 0 THEN 'Sundays' END ELSE '2023-04-30' END AS date_text, 'Park' AS location, occurrence FROM b""",
    ),
    "answer_coercion": (
        answer_coercion,
        ANSWER_SQL + """ SELECT url, occurrence, CASE k % 3 WHEN 0 THEN 'open' ELSE 'unknown' END AS registration_status, CASE k % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'scheduled' ELSE 'postponed' END AS lifecycle_status,
  is_valid_event, CASE WHEN NOT is_valid_event THEN 'gone' END AS invalid_reason, CASE k % 3 WHEN 0 THEN 'sat,sun' ELSE '' END AS weekdays, '5k|-|5_k;10|12.5|-' AS distances FROM b""",
    ),
    "occurrence_explode": (occurrence_explode, ANSWER_SQL + " SELECT url, 0 AS sort_order, TIMESTAMP '2024-05-01 09:05:00' AS starts_at, '1 May' AS date_text FROM b"),
    "date_parse": (date_parse, DATE_SQL),
    "postcode_extract": (postcode_extract, "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'de' || (s_suppkey % 90 + 10) || ' 1ah' WHEN 1 THEN 'SW1A1AA' END AS postcode FROM supplier"),
    "geocode_ladder": (
        geocode_ladder,
        """WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT CAST(k AS VARCHAR) AS url,
  CAST(CASE WHEN k % 10 = 0 THEN 1.0 WHEN k % 3 = 0 THEN 53.2 WHEN k % 3 = 1 THEN 10.0 WHEN k % 2 = 0 THEN 5.0 END AS DOUBLE) AS latitude,
  CAST(CASE WHEN k % 10 = 0 THEN 2.0 WHEN k % 3 = 0 THEN -1.6 WHEN k % 3 = 1 THEN 20.0 WHEN k % 2 = 0 THEN 6.0 END AS DOUBLE) AS longitude FROM s""",
    ),
    "maps_url": (maps_url, MAPS_SQL),
    "model_indices": (
        model_indices,
        """SELECT page_id, 'https://c/' || page_id || '/3' || CASE WHEN page_id % 5 <> 3 THEN ' https://c/' || page_id || '/' || (page_id % 5) ELSE '' END AS event_urls,
  CASE WHEN page_id % 2 = 0 AND page_id % 7 < 5 THEN 'https://c/' || page_id || '/' || (page_id % 7) END AS next_page, least(4000, 1000 + 8 * page_id * 10) AS budget FROM pages""",
    ),
    "interaction_kinds": (
        interaction_kinds,
        """WITH p AS (SELECT page_id, page_id % 3 <> 0 AS has, CASE page_id % 4 WHEN 0 THEN 'append' WHEN 3 THEN 'none' ELSE 'paginate' END AS kind FROM pages),
x AS (SELECT page_id, has, CASE WHEN kind = 'paginate' AND NOT has THEN 'none' ELSE kind END AS interaction FROM p) SELECT page_id, interaction, CASE WHEN interaction <> 'none' AND has THEN '#more' END AS selector FROM x""",
    ),
    "listing_guard": (listing_guard, "SELECT page_id, 'https://a/' || page_id || ' https://home/ https://a/' || page_id AS listing_urls FROM pages"),
    "sitemap_locations": (
        sitemap_locations,
        """SELECT 'https://s.example/' || page_id || '.xml' AS sitemap_url, CASE WHEN page_id % 3 = 1 THEN 'https://s.example/e/' || page_id
  WHEN page_id % 3 = 0 AND page_id + 1 IN (SELECT page_id FROM pages) THEN 'https://s.example/e/' || (page_id + 1) END AS event_urls FROM pages""",
    ),
    "seed_params": (
        seed_params,
        """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '1' END AS a, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey WHEN c_custkey % 2 = 0 THEN 'old' END AS sitemap_url,
  c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AS none FROM customer""",
    ),
    "robots_sitemap": (robots_sitemap, "SELECT count(*) FILTER (page_id % 3 <> 0) AS found, count(*) AS total, min('https://s/' || page_id) FILTER (page_id % 3 <> 0) AS first FROM pages"),
    "main_content_text": (main_content_text, None),
    "dense_content": (dense_content, None),
    "load_more_excerpt": (load_more_excerpt, EXCERPT_SQL),
    "click_selectors": (click_selectors, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '#m button.b.c' WHEN 1 THEN '#go' ELSE 'i.x' END AS selector, CASE page_id % 3 WHEN 0 THEN 2 ELSE 0 END AS n FROM pages"),
    "price_repair": (price_repair, "SELECT p_partkey, sha256('Race' || chr(10) || 'Select Distance 5K  10K  Half Marathon' || chr(10) || '5K' || chr(10) || '£28' || chr(10) || '10K' || chr(10) || '£' || (p_partkey % 40) || chr(10) || 'Half Marathon' || chr(10) || '£36') AS sha FROM part"),
    "browser_script": (
        browser_script,
        """SELECT r_regionkey, '(async () => {' || chr(10) || '  ' || array_to_string(['{ const el = document.querySelector("a[x=\\"1\\"]"); if (el) el.click(); }', 'await new Promise(r => setTimeout(r, 4000));',
  '{ const el = document.querySelector("a[x=\\"1\\"]"); if (el) el.click(); }', 'await new Promise(r => setTimeout(r, 4000));', 'window.scrollTo(0, document.body.scrollHeight);', 'await new Promise(r => setTimeout(r, 4000));'], chr(10) || '  ')
  || chr(10) || '})();' AS script, 6 AS n FROM region""",
    ),
    "dispatch_params": (dispatch_params, "SELECT p_partkey, 'last' AS brand, 'a=b' || p_size AS q, '' AS flag, 3 AS n FROM part"),
    "prompt_pruning": (prompt_pruning, "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 23 ELSE 24 END AS n, r_regionkey % 2 <> 0 AS name, false AS sport, true AS date_text FROM region"),
}
