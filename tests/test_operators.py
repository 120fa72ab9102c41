"""Operators against plain loops and small tables."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from startline.operators import decide, extract, feed, listing, report, robots, store
from startline.sources import files, lookups


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("body", "allowed", "blocked"),
    [
        ("User-agent: *\nDisallow: /private/\n", ["/public", "/"], ["/private/x"]),
        ("User-agent: *\nDisallow: /*.pdf$\n", ["/a.pdf?ref=1", "/a"], ["/a.pdf"]),
        ("User-agent: *\nDisallow: /\nUser-agent: startline\nDisallow:\n", ["/x"], []),
        ("User-agent: *\nDisallow: /a\nAllow: /a/b\n", ["/a/b/c", "/c"], ["/a/c"]),
        ("User-agent: a\nUser-agent: *\nDisallow: /x # note\n", ["/y"], ["/x"]),
        ("Disallow: /nobody", ["/nobody"], []),
    ],
)
def test_robots(spark, body, allowed, blocked):
    site = spark.createDataFrame([("https://s.example", 200, body)], lookups.ROBOTS)
    asked = spark.createDataFrame([(f"https://s.example{p}",) for p in allowed + blocked], "url string")
    got = {r["url"].removeprefix("https://s.example"): r["allowed"] for r in robots.allowed(asked, robots.rules(site, "startline")).collect()}
    assert got == dict.fromkeys(allowed, True) | dict.fromkeys(blocked, False)


def test_robots_policy_and_registrator(spark):
    site = spark.createDataFrame([("https://a", 503, None), ("https://b", 403, None), ("https://c", None, None)], lookups.ROBOTS)
    asked = spark.createDataFrame([("https://a/x", "bot"), ("https://a/x", "Ann"), ("https://a/x", ""), ("https://b/x", None), ("https://c/x", "bot")], "url string, who string")
    got = robots.allowed(asked, robots.rules(site, "startline"), F.col("who")).select("url", F.coalesce("who", F.lit("-")), "allowed")
    assert rows(got) == [("https://a/x", "", False), ("https://a/x", "Ann", True), ("https://a/x", "bot", False), ("https://b/x", "-", True), ("https://c/x", "bot", True)]
    assert robots.allowed(asked, robots.rules(site, "startline"), respect=False).where("NOT allowed").isEmpty()


def test_pacing_against_a_loop(spark):
    rnd = random.Random(1)
    asked = [(f"s{rnd.randrange(4)}", float(rnd.randrange(200))) for _ in range(120)]
    delays = {"s0": 0.0, "s1": 2.0, "s2": 7.5, "s3": 99.0}
    want, last = [], {}
    for site, at in sorted(asked, key=lambda x: x[1]):
        d = min(delays[site], 30.0)
        start = at if site not in last or not d else max(at, last[site] + d)
        last[site] = start
        want.append((site, at, start))
    df = spark.createDataFrame([(s, a, delays[s]) for s, a in asked], "site string, arrival double, delay double")
    assert rows(robots.paced(df).select("site", "arrival", "starts")) == sorted(want)


def test_pagination_against_a_loop(spark):
    rnd = random.Random(2)
    pages = {k: [[f"u{rnd.randrange(6 + 6 * k)}" for _ in range(rnd.randrange(4))] for _ in range(8)] for k in range(12)}
    data = [(k, n + 1, u) for k, ps in pages.items() for n, u in enumerate(ps)]
    got = {r["listing"]: (r["urls"], r["pages"]) for r in listing.paginate(spark.createDataFrame(data, "listing int, page int, urls array<string>")).collect()}
    for k, ps in pages.items():
        seen, n = set(ps[0]), 1
        for p in ps[1:]:
            if not set(p) - seen:
                break
            seen |= set(p)
            n += 1
        assert got[k] == (sorted(seen), n)


def test_append_stops_at_the_first_round_that_adds_nothing(spark):
    data = [(1, 0, ["a"]), (1, 1, ["a", "b"]), (1, 2, ["a", "b"]), (1, 3, ["a", "b", "c"]), (2, 0, ["x"])]
    got = listing.append(spark.createDataFrame(data, "listing int, round int, urls array<string>"))
    assert rows(got.select("listing", F.array_join("urls", ","), "rounds")) == [(1, "a,b", 1), (2, "x", 0)]


def test_decisions_hold_in_order(spark):
    base = {"allowed": True, "known": True, "page_status": 200, "fetched": True, "old_hash": "h", "new_hash": "h", "extracted": True, "is_valid": True, "invalid_reason": None}
    cases = [
        ({"allowed": False, "page_status": 404}, "robots-skip", "skipped"), ({"page_status": 404}, "dead-link", "success"), ({"page_status": None, "fetched": False}, "fetch-failed", "failed"),
        ({}, "unchanged", "success"), ({"new_hash": "i", "extracted": False}, "extraction-failed", "failed"), ({"known": False}, "upsert", "success"), ({"new_hash": "i", "is_valid": False}, "upsert", "success"),
    ]
    schema = "n int, allowed boolean, known boolean, page_status int, fetched boolean, old_hash string, new_hash string, extracted boolean, is_valid boolean, invalid_reason string"
    df = spark.createDataFrame([(n, *(base | c).values()) for n, (c, _, _) in enumerate(cases)], schema)
    got = rows(decide.decide(df).select("n", "action", "run_status"))
    assert got == [(n, a, s) for n, (_, a, s) in enumerate(cases)]
    assert decide.decide(df, "url-check").where("n = 1").first()["action"] == "url-skip"
    assert decide.decide(df, "force").where("n = 3").first()["action"] == "upsert"
    with pytest.raises(ValueError, match="check mode"):
        decide.decide(df, "sometimes")


def test_upsert_is_idempotent_and_freezes_first_seen(spark):
    empty = spark.createDataFrame([], "url string, name string, first_seen_at string, last_seen_at string")
    new = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "b", 1)], "url string, name string, at int")
    once = store.upsert(empty, new, "url", F.lit("d1"), touch=("last_seen_at",), order="at")
    assert rows(once) == [("a", "new", "d1", "d1"), ("b", "b", "d1", "d1")]
    twice = store.upsert(once, new.where("url = 'a'"), "url", F.lit("d2"), touch=("last_seen_at",), order="at")
    assert rows(twice) == [("a", "new", "d1", "d2"), ("b", "b", "d1", "d1")]


def test_children_and_occurrences(spark):
    old = spark.createDataFrame([("a", 0), ("b", 0)], "url string, sort_order int")
    touched = spark.createDataFrame([("a",)], "url string")
    assert rows(store.replace_children(old, touched, old.limit(0), "url")) == [("b", 0)]
    kind = "url string, occurrences array<struct<date_text:string,date_iso:string,time_text:string,time_24h:string,price_text:string>>"
    e = spark.createDataFrame([("a", [("x", "2024-01-01", None, "9:00", None), ("y", "bad", None, None, None), ("z", "2024-01-01", None, "09:00", None), ("w", "2024-01-02", None, None, None)])], kind)
    assert [(r["sort_order"], r["date_text"]) for r in store.occurrence_rows(e).orderBy("sort_order").collect()] == [(0, "x"), (3, "w")]


def test_dimension_and_umbrella_are_get_or_create(spark):
    d = spark.createDataFrame([("running", "5 K"), ("Running", "5k"), ("x", None)], "sport string, distance_category string")
    once = store.race_types(d)
    assert rows(once) == [("running_5k", "running", "5k")]
    assert rows(store.race_types(d, once)) == rows(once)
    o = spark.createDataFrame([("Feed", "h", "d", "organiser")], "name string, homepage_url string, discovered_via string, source_type string")
    assert rows(store.umbrella_organiser(o, "Feed", "x", "y")) == [("Feed", "h", "d", "platform")]
    assert store.umbrella_organiser(o, "Other", "x", "y").count() == 2


def test_schema_growth(spark):
    old = spark.createDataFrame([(1,)], "id int")
    wanted = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType(), False), T.StructField("c", T.IntegerType(), False)])
    grown, left_out = store.grow_schema(old, wanted, {"b": 7})
    assert rows(grown) == [(1, None, 7)] and left_out == ["c"]


def test_snapshots_swap_whole(spark, tmp_path):
    t = store.SnapshotTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.replace(spark.range(3).toDF("id"))
    t.replace(t.read().where("id > 0"))
    assert rows(t.read()) == [(1,), (2,)]
    with pytest.raises(Exception, match="boom"):
        t.replace(spark.range(1).select(F.raise_error(F.lit("boom")).cast("int").alias("id")))
    assert rows(t.read()) == [(1,), (2,)]


def test_feed(spark, tmp_path):
    path = tmp_path / "feed.tsv"
    head = "\t".join(files.FEED_COLUMNS)
    path.write_text(f"{head}\n Park \t51.5\t-1\tUnited Kingdom\t-Unknown-\tKent\tjunior Parkrunning\t\thttps://f/x//\nB\tnorth\t2\tUnited Kingdom\t\t\t\t\thttps://f/b\n \t1\t1\tUnited Kingdom\t\t\t\t\thttps://f/c\nC\t1\t1\tFrance\t\t\t\t\thttps://f/d\n")
    e = feed.feed_events(files.read_feed(spark, str(path)), "2024-01-01")
    got = {r["url"]: r for r in e.collect()}
    assert set(got) == {"https://f/x/", "https://f/b/"}
    a, b = got["https://f/x/"], got["https://f/b/"]
    assert (a["name"], a["location"], a["latitude"], a["date_text"], a["occurrence_weekdays"]) == ("Park", "Kent, United Kingdom", 51.5, "Every Sunday, 9:00am", ["sun"])
    assert (b["latitude"], b["longitude"], b["distances"][0]["distance_category"]) == (None, None, "5k")
    assert files.read_feed(spark, str(tmp_path / "absent.tsv")) is None
    assert feed.import_summary(None, "o")["status"] == "unusable"


def test_seed_and_messages(spark, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text('name,listing_urls,homepage_url,discovered_via,sitemap_url,handler,handler_params,registrator\nA,"[""https://a/x""]",https://a/,s,https://a/map.xml,,"{""k"":""v""}",\nB,[],https://b/,s,,special,,Ann\n')
    got = {r["name"]: r for r in files.read_seed(spark, str(path)).collect()}
    assert (got["A"]["listing_urls"], got["A"]["handler"], got["A"]["handler_params"], got["A"]["registrator"]) == (["https://a/x"], "default", {"k": "v", "sitemap_url": "https://a/map.xml"}, "bot")
    assert (got["B"]["listing_urls"], got["B"]["handler_params"], got["B"]["registrator"]) == ([], None, "Ann")


def test_lookups(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    page = lambda *u: spark.createDataFrame([(x, f"m{u}", [], "h", x) for x in u], lookups.PAGES)
    got = rows(lookups.fetch(asked, page("a"), page("a", "b")).select("url", "fetched", F.col("markdown").isNull()))
    assert got == [("a", True, False), ("b", True, False), ("c", False, True)]
    assert lookups.fetch(asked, page("a"), page("b"), forced="second").where("fetched").first()["url"] == "b"
    probes = spark.createDataFrame([("a", 405, 404), ("b", 200, None)], lookups.PROBES)
    assert rows(lookups.liveness(asked, probes).where("page_status IS NOT NULL")) == [("a", 404), ("b", 200)]


def test_report_files(spark, tmp_path):
    e = spark.createDataFrame([(1, 10, "valid", "u1", "A <b>"), (2, 10, "valid", "u2", None), (3, 11, "invalid", "u3", "C")], "id long, organiser_id long, status string, url string, name string")
    o = spark.createDataFrame([(10, "Org & Co"), (11, "Z")], "id long, name string")
    d = spark.createDataFrame([(1, 1, "10k", "£2", None), (1, 0, "5k", None, "running_5k"), (2, 0, "5k", "£1", "running_5k")], "event_id long, sort_order int, distance_text string, price_text string, label string")
    t = report.event_tree(e, o, d)
    assert rows(report.totals(report.entries(t)).select(F.coalesce("sport", F.lit("*")), F.coalesce("label", F.lit("*")), "entries")) == [("*", "*", 3), ("running", "*", 2), ("running", "running_5k", 2), ("uncategorised", "(uncategorised)", 1), ("uncategorised", "*", 1)]
    assert report.csv_rows(t).columns == list(report.CSV_COLUMNS)
    assert report.write_csv(report.csv_rows(t), f"file://{tmp_path}/csv") == 2
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).where("id = 1").first()["distances"] == "5k [running_5k]; 10k: £2"
    assert report.organiser_report(t, str(tmp_path / "o.html")) == 2
    page = (tmp_path / "o.html").read_text()
    assert "Org &amp; Co (ID 10)" in page and "A &lt;b&gt;" in page and "(untitled event #2)" in page
    assert report.event_type_report(t, str(tmp_path / "t.html")) == 3
    assert report.organiser_report(report.event_tree(e, o, d, status="invalid"), str(tmp_path / "i.html")) == 1


def test_csv_column_rewrite(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,body\nx,Sitemap: u\ny,none\n")
    from startline.functions.text import sitemap_directive

    assert report.with_column_rewritten(spark, f"file://{tmp_path}/a.csv", f"file://{tmp_path}/out", "sitemap_url", sitemap_directive(F.col("body"))) == (1, 2)


def test_summaries_and_known_fields(spark):
    f = spark.createDataFrame([("a", "long"), ("b", " ")], "url string, summary string")
    ans = spark.createDataFrame([("a", '{"summary_alt":" alt ","summary_short":""}'), ("b", '{"summary_alt":"never"}')], "url string, j string").select("url", F.parse_json("j").alias("answer"))
    assert rows(extract.with_summaries(f, ans).select("url", "summary_alt", "summary_short")) == [("a", "alt", None), ("b", None, None)]


def test_modes_and_registry(spark):
    found = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "organiser_id int, url string")
    assert rows(decide.planned(found, "sanity-check")) == [(1, "a"), (2, "c")]
    assert decide.planned(found, "dry-run").isEmpty() and decide.planned(found).count() == 3
    assert decide.check_mode_of(True, "hash-check") == "force"
    runs = spark.createDataFrame([("ValueError",), (None,)], "error string")
    assert not decide.aborted(runs) and decide.aborted(runs.union(spark.createDataFrame([("ConnectionError",)], "error string")))
    r = decide.Registry()
    r.register("x", len)
    assert r.get("x") is len and r.get("y") is None and r.names() == ["x"]


def test_a_provider_is_asked_again_for_what_it_left_out(spark):
    asked = []

    def provider(requests, wait):
        urls = sorted(r["url"] for r in requests.select("url").collect())
        asked.append((urls, wait))
        return requests.where(F.length("url") <= len(asked)).select("url", F.lit("m").alias("markdown"))

    requests = spark.createDataFrame([("a",), ("a",), ("bb",), ("never",), (None,)], "url string")
    got = lookups.retried(requests, provider, tries=4, most=3.0)
    assert sorted(r["url"] for r in got.collect()) == ["a", "bb"]
    assert asked == [(["a", "bb", "never"], 0.0), (["bb", "never"], 2.0), (["never"], 3.0), (["never"], 3.0)]
    assert lookups.retried(requests.where("url = 'a'"), lambda r, w: r.select("url")).count() == 1


@pytest.mark.parametrize("seconds", [7.0, 3600.0])
def test_pacing_in_ranges_of_time(spark, seconds):
    """Sites of any load, ranges that leave a queue, null sites, delays and arrivals; against one queue for each site."""
    rnd = random.Random(3)
    asked = [(k, rnd.choice(["a", "b", None]), None if k % 50 == 0 else float(rnd.randrange(60)), {"a": 2.0, "b": 99.0, None: None}) for k in range(300)]
    asked = [(k, s, a, d[s]) for k, s, a, d in asked]
    want, last = {}, {}
    for k, s, a, d in sorted(asked, key=lambda r: (r[2] is None, r[2], r[0])):
        gap = min(d or 0.0, 30.0)
        if a is None:
            want[k] = None
        elif gap > 0:
            last[s] = want[k] = max(a, last.get(s, -1e9) + gap)
        else:
            want[k] = a
    df = spark.createDataFrame(asked, "k int, site string, arrival double, delay double").repartition(3)
    assert {r["k"]: r["starts"] for r in robots.paced(df, order=("k",), seconds=seconds).collect()} == want


def test_following_more_walks_than_a_recursion_may_have_rows(spark):
    links = spark.createDataFrame([("p0", "p1"), ("p1", "p2"), ("p2", "p0"), ("x", None)], "url string, next_url string")
    starts = spark.range(1_100_000).select(F.when(F.col("id") < 3, F.concat(F.lit("p"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("q"), F.col("id").cast("string"))).alias("url"))
    got = listing.follow(links, starts)
    assert got.count() == 1_100_000 + 6
    assert sorted(map(tuple, got.where("start_url = 'p1'").collect())) == [("p1", "p0", 3), ("p1", "p1", 1), ("p1", "p2", 2)]
    assert listing.follow(links, starts.where("url = 'p0'"), most=2).count() == 2


def test_latest_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "z"), (None, 2, "n")], "key string, at int, v string")
    assert sorted((r["v"], r["first_seen"]) for r in store.latest(rows, "key", "at").collect()) == [("n", 2), ("y", 1), ("z", None)]
