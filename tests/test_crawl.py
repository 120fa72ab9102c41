"""Whole crawls, and the commands over a folder of tables."""

import base64
import datetime
import json

import pytest
from pyspark.sql import functions as F

from startline import __main__ as cli
from startline.operators import decide
from startline.plans import crawl as plans
from startline.plans import discovery
from startline.sources import files, lookups

DAY = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
EVENT = '{"name":"%s","summary":"long","occurrence":"one_off","distances":[{"distance_text":"5k","distance_category":"5 K"}],"occurrences":[{"date_text":"1 May","date_iso":"2024-05-01"}],"sport":"running","location":"Hall, DE45 1AH"%s}'


def world(spark, markdown="text", name="Race", extra="", status=200):
    p = lambda *u: [(f"https://s.example/{x}", f"{markdown} {x}", [], "<p></p>", "") for x in u]
    return plans.Lookups(
        spark.createDataFrame(p("a", "b", "gone", "quiet"), lookups.PAGES),
        spark.createDataFrame([("https://s.example/gone", 404, None), ("https://s.example/a", status, None)], lookups.PROBES),
        spark.createDataFrame([("https://s.example", 200, "User-agent: *\nDisallow: /private")], lookups.ROBOTS),
        spark.createDataFrame([("extract_event", f"https://s.example/{x}", EVENT % (name, extra)) for x in "ab"] + [("rewrite_summary", "https://s.example/a", '{"summary_alt":"alt","summary_short":"short"}')], lookups.ANSWERS),
        spark.createDataFrame([("DE45 1AH", 1, 53.0, -1.0)], lookups.PLACES),
    )


def requests(spark, *names):
    return spark.createDataFrame([(1, f"https://s.example/{x}", "bot") for x in names], "organiser_id long, url string, registrator string")


def run(spark, tables, names, found, day):
    after, runs = plans.crawl(tables, requests(spark, *names), found, F.lit(DAY[day]))
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    audit = {r["url"].rsplit("/", 1)[1]: (r["status"], r["detail"]) for r in runs.collect()}
    return plans.Tables(*(keep(getattr(after, n)) for n in ("events", "distances", "occurrences", "race_types"))), audit


def test_crawl_recrawl_and_change(spark):
    names = ("a", "b", "gone", "private", "quiet", "absent")
    tables, audit = run(spark, plans.Tables.empty(spark), names, world(spark), 0)
    assert audit == {
        "a": ("success", "extracted"), "b": ("success", "extracted"), "gone": ("success", "confirmed dead link (HTTP 404)"), "private": ("skipped", "disallowed by robots.txt"),
        "quiet": ("failed", "extraction returned no fields"), "absent": ("failed", "page could not be fetched"),
    }
    events = {r["url"].rsplit("/", 1)[1]: r for r in tables.events.collect()}
    assert set(events) == {"a", "b", "gone"}
    assert (events["a"]["summary_alt"], events["b"]["summary_alt"], events["a"]["latitude"]) == ("alt", None, 53.0)
    assert (events["gone"]["status"], events["gone"]["invalid_reason"]) == ("invalid", "HTTP 404 fetching the page")
    assert [r["label"] for r in tables.race_types.collect()] == ["running_5k"]
    again, audit = run(spark, tables, ("a", "b"), world(spark), 1)
    assert audit["a"] == ("success", "unchanged, skipped extraction")
    assert again.distances.count() == again.occurrences.count() == 2
    first = {r["url"].rsplit("/", 1)[1]: (r["first_seen_at"], r["last_crawled_at"]) for r in again.events.collect()}
    assert first["a"] == (DAY[0], DAY[1]) and first["gone"] == (DAY[0], DAY[0])
    changed, audit = run(spark, again, ("a",), world(spark, "new", "Renamed", ',"is_valid_event":false,"invalid_reason":"moved"'), 2)
    assert audit["a"] == ("success", "extracted (invalid event: moved)")
    now = {r["url"].rsplit("/", 1)[1]: r for r in changed.events.collect()}
    assert (now["a"]["name"], now["a"]["status"], now["a"]["first_seen_at"], now["b"]["name"]) == ("Renamed", "invalid", DAY[0], "Race")
    dead, audit = run(spark, changed, ("a",), world(spark, status=410), 2)
    row = dead.events.where("url LIKE '%/a'").first()
    assert (row["status"], row["invalid_reason"], row["name"]) == ("invalid", "HTTP 410 fetching the page", "Renamed")


def test_commands(spark, tmp_path):
    t, k = f"file://{tmp_path}/tables", f"file://{tmp_path}/lookups"
    (tmp_path / "seed.csv").write_text('name,listing_urls,homepage_url,discovered_via,sitemap_url,handler,handler_params,registrator\nOrg,"[""https://s.example/list""]",https://s.example/,x,,strange,,\n')
    assert cli.main(["--tables", t, "seed", f"file://{tmp_path}/seed.csv"]) == {"organisers": 1}
    found = world(spark)
    pages = found.pages.unionByName(spark.createDataFrame([("https://s.example/list", "m", ["https://s.example/a", "https://s.example/gone", "https://off.test/"], "", "")], lookups.PAGES))
    answers = found.answers.unionByName(spark.createDataFrame([("analyze_listing", "https://s.example/list", '{"event_indices":[0,1]}')], lookups.ANSWERS))
    for name, df in (("pages", pages), ("probes", found.probes), ("robots", found.robots), ("answers", answers), ("places", found.places)):
        df.write.parquet(f"{k}/{name}")
    assert cli.main(["--tables", t, "--lookups", k, "crawl", "--mode", "dry-run"]) == {"listing success": 1, "unknown handlers": 1}
    assert cli.main(["--tables", t, "--lookups", k, "crawl"]) == {"success": 2, "listing success": 1, "unknown handlers": 1}
    assert cli.main(["--tables", t, "--lookups", k, "crawl"]) == {"listing success": 1, "unknown handlers": 1}  # nothing new
    head = "\t".join(files.FEED_COLUMNS)
    (tmp_path / "feed.tsv").write_text(f"{head}\nPark\t51\t-1\tUnited Kingdom\t\t\t\t\thttps://f/x\n")
    assert cli.main(["--tables", t, "import-feed", f"file://{tmp_path}/feed.tsv", "--param", "today=2024-01-01"]) == {"status": "ok", "registered": 1, "organiser": "Feed organiser"}
    assert cli.main(["--tables", t, "import-feed", f"file://{tmp_path}/none.tsv"])["status"] == "unusable"
    assert cli.main(["--tables", t, "export", "--output", f"file://{tmp_path}/csv"]) == {"rows": 2}
    assert cli.main(["--tables", t, "export", "--format", "html-invalid", "--output", f"{tmp_path}/i.html"]) == {"events": 1}
    assert cli.main(["--tables", t, "--lookups", k, "discover-sitemaps", f"file://{tmp_path}/seed.csv", "--output", f"file://{tmp_path}/seed2"]) == {"found": 0, "total": 1}
    audit = [r["detail"] for r in cli.table(spark, t, "runs").where("run_type = 'listing'").orderBy("finished_at").collect()]
    assert audit == ["2 candidate links, 2 confirmed events, 2 new"] * 2 + ["2 candidate links, 2 confirmed events, 0 new"]
    assert cli.table(spark, t, "runs").where("run_type = 'event'").count() == 2


def listing_world(spark):
    """Organisers like seed rows, most without listings, and the sites that they name."""
    e = lambda n: f"https://{n}"
    page = lambda url, links=(), html="", markdown="m": (url, markdown, list(links), html, url)
    button = "<button id='more'>Load more</button>"
    pages = [
        page("https://home.a/", [e("home.a/list"), e("home.a/about")]),
        page("https://home.a/list", [e("home.a/e1"), e("home.a/e2"), e("home.a/list?p=2"), e("other.test/x")]),
        page("https://home.a/list?p=2", [e("home.a/e2"), e("home.a/e3"), e("home.a/list")]),
        page("https://grow.a/list", [e("grow.a/1")], button),
        page("https://page.a/list", [e("page.a/1")], "<a id='n' title='Next page'>&raquo;</a>"),
        page("https://part.a/list", [e("part.a/9")]),
        page("https://void.a/list", []),
    ]
    views = [
        ("https://grow.a/list", 1, "m", [e("grow.a/1"), e("grow.a/2")], button),
        ("https://grow.a/list", 2, "m", [e("grow.a/1"), e("grow.a/2"), e("grow.a/3")], ""),
        ("https://grow.a/list", 3, "m", [e("grow.a/never")], ""),
        ("https://page.a/list", 1, "m", [e("page.a/2"), e("page.a/3")], ""),
        ("https://page.a/list", 2, "m", [e("page.a/3")], ""),
        ("https://page.a/list", 3, "m", [e("page.a/4")], ""),
    ]
    answers = [
        ("discover_listings", "https://home.a/", '{"listing_urls":["https://home.a/list","https://invented.test/"]}'),
        ("analyze_listing", "https://home.a/list", '{"event_indices":[0,1],"next_page_index":2}'),
        ("analyze_listing", "https://home.a/list?p=2", '{"event_indices":[0,1],"next_page_index":2}'),  # back to the first
        ("detect_load_more", "https://grow.a/list", '{"interaction_type":"append"}'),
        ("detect_load_more", "https://grow.a/list#press=1", '{"interaction_type":"append"}'),
        ("detect_load_more", "https://grow.a/list#press=2", '{"interaction_type":"none"}'),
        ("analyze_listing", "https://grow.a/list", '{"event_indices":[0]}'),
        ("analyze_listing", "https://grow.a/list#press=2", '{"event_indices":[0,2]}'),
        ("detect_load_more", "https://page.a/list", '{"interaction_type":"paginate"}'),
        ("analyze_listing", "https://page.a/list", '{"event_indices":[0]}'),
        ("analyze_listing", "https://page.a/list#press=1", '{"event_indices":[0,1]}'),
        ("analyze_listing", "https://page.a/list#press=2", '{"event_indices":[0]}'),
        ("analyze_listing", "https://page.a/list#press=3", '{"event_indices":[0]}'),
        ("select_sitemap", "https://index.a/s.xml", '{"events_sitemap_index":1}'),
        ("analyze_listing", "https://part.a/list", '{"event_indices":[0]}'),
    ]
    locs = lambda tag, entry, *u: f"<{tag}>" + "".join(f"<{entry}><loc>{x}</loc></{entry}>" for x in u) + f"</{tag}>"
    sitemaps = [
        ("https://map.a/s.xml", locs("urlset", "url", e("map.a/1"), e("map.a/2"), e("off.test/"))),
        ("https://index.a/s.xml", locs("sitemapindex", "sitemap", e("index.a/blog.xml"), e("index.a/events.xml"))),
        ("https://index.a/events.xml", locs("urlset", "url", e("index.a/7"))),
        ("https://part.a/s.xml", "<html/>"),
        ("https://shut.a/s.xml", locs("urlset", "url", e("shut.a/1"))),
    ]
    robots = [("https://shut.a", 200, "User-agent: *\nDisallow: /")]
    organisers = [
        (1, "https://home.a/", [], None, "default", "bot"), (2, "https://grow.a/", ["https://grow.a/list"], None, "default", "bot"), (3, "https://page.a/", ["https://page.a/list"], None, "nobody knows", "bot"),
        (4, "https://map.a/", ["https://map.a/unused"], {"sitemap_url": "https://map.a/s.xml"}, "default", "bot"), (5, "https://index.a/", [], {"sitemap_url": "https://index.a/s.xml"}, "default", "bot"),
        (6, "https://part.a/", ["https://part.a/list"], {"sitemap_url": "https://part.a/s.xml"}, "default", "bot"), (7, "https://shut.a/", [], {"sitemap_url": "https://shut.a/s.xml"}, "default", "bot"),
        (8, "https://shut.a/", [], {"sitemap_url": "https://shut.a/s.xml"}, "default", "friend"), (9, "https://void.a/", ["https://void.a/list", "https://void.a/gone"], None, None, "bot"),
    ]
    found = plans.Lookups(
        spark.createDataFrame(pages, lookups.PAGES), spark.createDataFrame([], lookups.PROBES), spark.createDataFrame(robots, lookups.ROBOTS), spark.createDataFrame(answers, lookups.ANSWERS),
        spark.createDataFrame([], lookups.PLACES), spark.createDataFrame(views, lookups.VIEWS), spark.createDataFrame(sitemaps, lookups.SITEMAPS),
    )
    schema = "id long, homepage_url string, listing_urls array<string>, handler_params map<string,string>, handler string, registrator string"
    return spark.createDataFrame(organisers, schema), found


@pytest.mark.parametrize("force", [False, True])
def test_discovery_of_seed_like_organisers(spark, force):
    organisers, found = listing_world(spark)
    stored = spark.createDataFrame([("https://map.a/2",), ("https://grow.a/1",)], "url string")
    new = discovery.discover(organisers, discovery.Request(found, stored, F.lit(DAY[0]), force))
    urls: dict = {}
    for r in new.urls.collect():
        urls.setdefault(r["organiser_id"], []).append(r["url"].split("//")[1])
    assert {k: sorted(v) for k, v in urls.items()} == {
        1: ["home.a/e1", "home.a/e2", "home.a/e3"], 2: ["grow.a/1"] * force + ["grow.a/3"], 3: ["page.a/1", "page.a/2", "page.a/3"],
        4: ["map.a/1"] + ["map.a/2"] * force, 5: ["index.a/7"], 6: ["part.a/9"], 8: ["shut.a/1"],
    }
    what = "to refresh (force)" if force else "new"
    audit = sorted((r["organiser_id"], r["url"].split("//")[1], r["status"], r["detail"]) for r in new.runs.collect())
    assert audit == [
        (1, "home.a/list", "success", f"3 candidate links, 2 confirmed events, 2 {what}"), (1, "home.a/list?p=2", "success", f"3 candidate links, 2 confirmed events, 1 {what}"),
        (2, "grow.a/list", "success", f"3 candidate links, 2 confirmed events, {1 + force} {what}"), (3, "page.a/list", "success", f"3 candidate links, 3 confirmed events, 3 {what}"),
        (4, "map.a/s.xml", "success", "2 urls from sitemap, 2 new (force refresh: returning all)" if force else "2 urls from sitemap, 1 new"),
        (5, "index.a/s.xml", "success", "1 urls from sitemap, 1 new" + " (force refresh: returning all)" * force), (6, "part.a/list", "success", f"1 candidate links, 1 confirmed events, 1 {what}"),
        (8, "shut.a/s.xml", "success", "1 urls from sitemap, 1 new" + " (force refresh: returning all)" * force),
        (9, "void.a/gone", "failed", "page could not be fetched"), (9, "void.a/list", "success", f"0 candidate links, 0 confirmed events, 0 {what}"),
    ]
    assert {r["organiser_id"]: r["listing_urls"] for r in new.listings.collect()} == {1: ["https://home.a/list"]}


def test_handlers_are_dispatched(spark):
    organisers, found = listing_world(spark)

    def own(rows, request):
        urls = rows.select(F.col("id").alias("organiser_id"), F.lit("https://own/").alias("url"))
        none = discovery.default(rows.limit(0), request)
        return discovery.Found(urls, none.runs, none.listings)

    decide.handlers.register("own", own)
    try:
        rows = organisers.where("id = 5").withColumn("handler", F.lit("own")).unionByName(organisers.where("id = 6"))
        new = discovery.discover(rows, discovery.Request(found, spark.createDataFrame([], "url string"), F.lit(DAY[0])))
        assert sorted((r["organiser_id"], r["url"]) for r in new.urls.collect()) == [(5, "https://own/"), (6, "https://part.a/9")]
    finally:
        decide.handlers._found.pop("own")


def body(**message):
    return json.dumps({"message": {"data": base64.b64encode(json.dumps(message).encode()).decode()}})


def test_queues_and_unreachable_pages(spark, tmp_path):
    t, k = f"file://{tmp_path}/tables", f"file://{tmp_path}/lookups"
    organisers, found = listing_world(spark)
    event = spark.createDataFrame([("extract_event", "https://home.a/e1", EVENT % ("One", ""))], lookups.ANSWERS)
    shown = spark.createDataFrame([("https://home.a/e1", "text", [], "", "")], lookups.PAGES)
    found.answers, found.pages = found.answers.unionByName(event), found.pages.unionByName(shown)
    for name in cli.LOOKUPS:
        getattr(found, name).write.parquet(f"{k}/{name}")
    more = {"name": F.lit("n"), "source_type": F.lit("organiser"), "active": F.lit(True)}
    cli.save(spark, t, organisers=organisers.withColumns(more))
    (tmp_path / "in").mkdir()
    for n, text in enumerate((body(organiser_id=1), body(organiser_id=77), "junk", body(organiser_id=1))):
        (tmp_path / "in" / f"{n}.json").write_text(text)
    listing = ["--tables", t, "--lookups", k, "listing-queue", f"file://{tmp_path}/in", "--checkpoint", f"file://{tmp_path}/c1", "--output", f"file://{tmp_path}/out"]
    assert cli.main(listing) == {"messages": 4}
    assert cli.main(listing) == {"messages": 0}  # nothing new has arrived
    sent = sorted(json.loads(base64.b64decode(json.loads(x)["message"]["data"]))["event_url"] for f in (tmp_path / "out").glob("batch-*/part-*") for x in f.read_text().splitlines())
    assert sent == ["https://home.a/e1", "https://home.a/e2", "https://home.a/e3"]
    assert cli.table(spark, t, "organisers").where("id = 1").first()["listing_urls"] == ["https://home.a/list"]
    (tmp_path / "events").mkdir()
    for n, text in enumerate((body(organiser_id=1, event_url="https://home.a/e1"), body(organiser_id=1, event_url="https://home.a/absent"), body(organiser_id=1))):
        (tmp_path / "events" / f"{n}.json").write_text(text)
    crawled = ["--tables", t, "--lookups", k, "event-queue", f"file://{tmp_path}/events", "--checkpoint", f"file://{tmp_path}/c2"]
    assert cli.main(crawled) == {"messages": 3}
    version = cli.log_of(spark, t).versions()[-1]
    for name in ("0", ".0.crc"):  # as after an end between the commit and the stream's note of it
        (tmp_path / "c2" / "commits" / name).unlink(missing_ok=True)
    assert cli.main(crawled) == {"messages": 3} and cli.log_of(spark, t).versions()[-1] == version
    assert [r["name"] for r in cli.table(spark, t, "events").collect()] == ["One"]
    assert sorted(r["detail"] for r in cli.table(spark, t, "runs").where("run_type = 'event'").collect()) == ["extracted", "page could not be fetched"]

    before = cli.log_of(spark, t).snapshot().tables
    broken = spark.read.parquet(f"{k}/pages").withColumn("error", F.when(F.col("url") == "https://grow.a/list", F.lit("ConnectionError")))
    broken.write.parquet(f"{k}/broken")
    import shutil

    shutil.rmtree(tmp_path / "lookups" / "pages")
    (tmp_path / "lookups" / "broken").rename(tmp_path / "lookups" / "pages")
    with pytest.raises(ConnectionError):
        cli.main(["--tables", t, "--lookups", k, "crawl"])
    assert cli.log_of(spark, t).snapshot().tables == before  # nothing was stored
