"""Where an organiser's events are: its sitemap, its listings, or listings found on its home page.

The first of the three that can be read counts. Listing pages are walked along their next links, a level of all
organisers at a time, so a plan fetches only what it needs; every page is shown in full first, by the views that its
control for more leads to. Each page and sitemap leaves an audit row, and a failure ends that listing alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startline.functions import coerce, markup
from startline.functions.text import blank_to_null
from startline.functions.urls import candidate_links
from startline.operators import decide, extract, listing, robots, store
from startline.sources import lookups

RUN = "run_type string, url string, organiser_id long, status string, detail string, finished_at timestamp"
NONE = "array<string>"


@dataclass
class Found:
    """New event addresses (organiser_id, url), audit rows, and listings to remember (organiser_id, listing_urls)."""

    urls: DataFrame
    runs: DataFrame
    listings: DataFrame

    def union(self, other: Found) -> Found:
        return Found(self.urls.unionByName(other.urls), self.runs.unionByName(other.runs), self.listings.unionByName(other.listings))


@dataclass
class Request:
    """What a handler is given beside its organisers: lookups, stored events, the time, force, and the robots agent."""

    found: object
    events: DataFrame
    now: Column
    force: bool = False
    agent: str = "startline"
    respect_robots: bool = True

    def allowed(self, rows: DataFrame) -> DataFrame:
        return robots.allowed(rows, robots.rules(self.found.robots, self.agent), F.col("registrator"), self.respect_robots)


def runs(rows: DataFrame, status: Column, detail: Column, now: Column) -> DataFrame:
    return rows.select(F.lit("listing").alias("run_type"), "url", "organiser_id", status.alias("status"), detail.alias("detail"), now.cast("timestamp").alias("finished_at"))


def view_key(url: Column, press: Column) -> Column:
    """What a model's answer about a view is kept under: the address, and how often its control was pressed."""
    return F.when(press == 0, url).otherwise(F.concat(url, F.lit("#press="), press.cast("string")))


def links_or_none(c: str = "links") -> Column:
    return F.coalesce(F.col(c), F.array().cast(NONE))


def sitemap_urls(organisers: DataFrame, request: Request) -> DataFrame:
    """organiser_id, sitemap_url, sitemap_urls: the event addresses of each sitemap that may and can be read, else null."""
    found = request.found
    asked = organisers.select("organiser_id", "homepage_url", "registrator", F.col("handler_params")["sitemap_url"].alias("url")).where(F.length("url") > 0)
    asked = request.allowed(asked).withColumnRenamed("url", "sitemap_url")
    picked = lookups.answered(asked.select("sitemap_url").distinct(), found.answers, "select_sitemap", "sitemap_url")
    index = F.to_json(F.try_variant_get("answer", "$.events_sitemap_index", "variant"))
    picked = picked.select("sitemap_url", F.try_parse_json(F.concat(F.lit("["), index, F.lit("]"))).alias("picked"))
    # parts of an index are asked for too; organisers with a permission of their own may read them all
    free = ~F.coalesce("registrator", F.lit("bot")).isin("", "bot")
    files = request.allowed(found.sitemaps.withColumn("registrator", F.lit("bot")))
    read = None
    for own, some in ((free, files), (~free, files.where("allowed"))):
        homes = asked.where(own & F.col("allowed")).select("sitemap_url", "homepage_url").distinct()
        part = listing.sitemap_events(homes, some.select("url", "xml"), picked).withColumn("free", F.lit(own is free))
        read = part if read is None else read.unionByName(part)
    return asked.withColumn("free", free).join(read, ["sitemap_url", "homepage_url", "free"], "left").select("organiser_id", "sitemap_url", F.col("event_urls").alias("sitemap_urls"))


def discovered(organisers: DataFrame, request: Request) -> DataFrame:
    """organiser_id, discovered_urls: what the discovery task proposes for home pages that may be read."""
    found = request.found
    asked = request.allowed(organisers.select("organiser_id", "registrator", "homepage_url", F.col("homepage_url").alias("url"))).where("allowed")
    pages = lookups.fetch(asked, found.pages).where("fetched").withColumn("candidates", candidate_links(links_or_none(), F.col("homepage_url")))
    answered = lookups.answered(pages, found.answers, "discover_listings", "homepage_url")
    return extract.discovered_listings(answered).select("organiser_id", F.coalesce("listing_urls", F.array().cast(NONE)).alias("discovered_urls"))


def control(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """pages with interaction and selector of their control for more: grounded in the page, else a checked guess."""
    asked = lookups.answered(pages.withColumn("key", F.col("url")), answers, "detect_load_more")
    kind = coerce.one_of(coerce.text_of(coerce.field(F.col("answer"), "interaction_type")), coerce.INTERACTIONS)
    guess = blank_to_null(coerce.text_of(coerce.field(F.col("answer"), "selector")))
    shown = asked.withColumns({"kind": kind, "guess": guess}).withColumn("selector", markup.click_selector("html", "kind", "guess"))
    return shown.withColumn("interaction", coerce.interaction(F.col("kind"), F.col("selector"))).drop("answer", "key", "kind", "guess")


def analysed(views: DataFrame, answers: DataFrame) -> DataFrame:
    """views (url, press, links, homepage_url) with candidates, event_urls and next_page from the listing task."""
    rows = views.withColumns({"candidates": candidate_links(links_or_none(), F.col("homepage_url")), "key": view_key(F.col("url"), F.col("press"))})
    return extract.listing_answer(lookups.answered(rows, answers, "analyze_listing")).drop("answer", "key")


def shown_in_full(pages: DataFrame, found) -> DataFrame:
    """page, candidates (number), event_urls and next_page of fetched listing pages, after their control for more.

    A pager replaces its page, so every view is analysed and the event addresses are united; what grows is analysed
    once, in its last view. Views stop where the operators of listing stop.
    """
    pages = store.settle(control(pages, found.answers).select("page", "url", "homepage_url", "links", "interaction", "selector"))
    first = pages.withColumn("press", F.lit(0))
    pressed = pages.where("interaction <> 'none'").select("page", "url", "homepage_url", "interaction").join(found.views.select("url", "press", "links"), "url")
    pressed = pressed.where(F.col("press").between(1, listing.MOST_PAGES))
    views = first.select("page", "url", "homepage_url", "interaction", "press", "links").unionByName(pressed)

    paged = store.settle(analysed(views.where("interaction = 'paginate'"), found.answers).select("page", "press", "candidates", "event_urls"))
    ends = listing.paginate(paged.select("page", F.col("press").alias("number"), F.col("event_urls").alias("urls")).select(F.col("page").alias("listing"), (F.col("number") + 1).alias("page"), "urls"))
    ends = ends.select(F.col("listing").alias("page"), "urls", "pages")
    # the candidates of the view that ended it were seen too
    seen = paged.join(ends, "page").where("press <= pages").select("page", F.explode("candidates").alias("c")).groupBy("page").agg(F.count_distinct("c").alias("candidates"))
    pager = ends.join(seen, "page", "left").select("page", F.coalesce("candidates", F.lit(0)).cast("int").alias("candidates"), F.col("urls").alias("event_urls"), F.lit(None).cast("string").alias("next_page"))

    # a round counts if the page before it still offered more
    growing = views.where("interaction = 'append'").withColumn("key", view_key(F.col("url"), F.col("press")))
    probe = lookups.answered(growing.select("page", "press", "key"), found.answers, "detect_load_more")
    over = probe.where(coerce.one_of(coerce.text_of(coerce.field(F.col("answer"), "interaction_type")), coerce.INTERACTIONS) != "append").groupBy("page").agg(F.min("press").alias("over"))
    rounds = growing.drop("key").join(over, "page", "left").where("over IS NULL OR press <= over OR press = 0")
    last = listing.append(rounds.select(F.col("page").alias("listing"), F.col("press").alias("round"), links_or_none().alias("urls"))).select(F.col("listing").alias("page"), F.col("rounds").alias("press"))
    final = rounds.join(last, ["page", "press"]).select("page", "url", "homepage_url", "press", "links")
    final = final.unionByName(first.where("interaction = 'none'").select("page", "url", "homepage_url", "press", "links"))
    once = analysed(final, found.answers).select("page", F.size("candidates").alias("candidates"), "event_urls", "next_page")
    return once.unionByName(pager)


def walked(starts: DataFrame, request: Request) -> DataFrame:
    """Every listing page visited: organiser_id, start, step, url, status, detail, candidates, event_urls.

    From organiser_id, homepage_url, registrator, start (the listing's number) and url. A listing ends without a
    next page, at one already visited, at the cap, and at a page that may not or cannot be read.
    """
    frontier, done = starts.withColumn("seen", F.array("url")), []
    for step in range(1, listing.MOST_PAGES + 1):
        rows = request.allowed(frontier.withColumn("page", F.concat_ws("/", "organiser_id", "start")))
        rows = store.settle(lookups.fetch(rows, request.found.pages))
        shown = shown_in_full(rows.where("allowed AND fetched").select("page", "url", "homepage_url", "links", "html"), request.found)
        status = F.when(~F.col("allowed"), F.lit("skipped")).when(~F.col("fetched"), F.lit("failed")).otherwise(F.lit("success"))
        detail = F.when(~F.col("allowed"), F.lit("disallowed by robots.txt")).when(~F.col("fetched"), F.lit("page could not be fetched"))
        rows = rows.select("page", "organiser_id", "homepage_url", "registrator", "start", "url", "seen", status.alias("status"), detail.alias("detail"))
        rows = store.settle(rows.join(shown, "page", "left").withColumn("step", F.lit(step)))
        done.append(rows)
        onward = F.col("next_page").isNotNull() & ~F.array_contains("seen", F.col("next_page"))
        frontier = rows.where(onward).select("organiser_id", "homepage_url", "registrator", "start", F.col("next_page").alias("url"), F.array_append("seen", F.col("next_page")).alias("seen"))
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).select("organiser_id", "start", "step", "url", "status", "detail", "candidates", "event_urls")


def from_listings(starts: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
    """New event addresses and audit rows of listings; an address counts for the page that shows it first."""
    pages = store.settle(walked(starts, request))
    each = pages.select("organiser_id", "start", "step", F.posexplode("event_urls").alias("n", "url"))
    each = each.groupBy("organiser_id", "url").agg(F.min(F.struct("start", "step")).alias("at"))
    if not request.force:
        each = each.join(request.events.select("url"), "url", "left_anti")
    new = store.settle(each.select("organiser_id", "url", "at.start", "at.step"))
    counts = new.groupBy("organiser_id", "start", "step").agg(F.count(F.lit(1)).alias("new"))
    rows = pages.join(counts, ["organiser_id", "start", "step"], "left")
    words = F.concat(F.col("candidates").cast("string"), F.lit(" candidate links, "), F.size("event_urls").cast("string"), F.lit(" confirmed events, "), F.coalesce("new", F.lit(0)).cast("string"), F.lit(" to refresh (force)" if request.force else " new"))
    return new.select("organiser_id", "url"), runs(rows, F.col("status"), F.coalesce("detail", words), request.now)


def default(organisers: DataFrame, request: Request) -> Found:
    """The handler of every organiser that names no other: sitemap, else stored listings, else discovery."""
    rows = store.settle(organisers.select(F.col("id").alias("organiser_id"), "homepage_url", "registrator", "handler_params", "listing_urls"))
    maps = store.settle(sitemap_urls(rows, request))
    rows = rows.join(maps, "organiser_id", "left")
    nothing = F.col("sitemap_urls").isNull() & ~F.coalesce(F.size("listing_urls") > 0, F.lit(False))
    own = store.settle(discovered(rows.where(nothing), request))
    rows = store.settle(listing.listing_source(rows.join(own, "organiser_id", "left")))

    mapped = rows.where("source = 'sitemap'").select("organiser_id", F.col("sitemap_url").alias("site"), F.explode_outer("sitemap_urls").alias("url"))
    known = mapped.join(request.events.select("url", F.lit(True).alias("known")), "url", "left").withColumn("new", F.col("url").isNotNull() & (F.lit(request.force) | F.col("known").isNull()))
    known = store.settle(known)
    counts = known.groupBy("organiser_id", F.col("site").alias("url")).agg(F.count("url").alias("n"), F.count_if("new").alias("new"))
    words = F.concat(F.col("n").cast("string"), F.lit(" urls from sitemap, "), F.col("new").cast("string"), F.lit(" new" + (" (force refresh: returning all)" if request.force else "")))
    starts = rows.where("source <> 'sitemap'").select("organiser_id", "homepage_url", "registrator", F.posexplode("listing").alias("start", "url"))
    urls, audit = from_listings(starts, request)
    return Found(
        known.where("new").select("organiser_id", "url").unionByName(urls).distinct(),
        runs(counts, F.lit("success"), words, request.now).unionByName(audit),
        own.select("organiser_id", F.col("discovered_urls").alias("listing_urls")),
    )


decide.handlers.register("default", default)


def discover(organisers: DataFrame, request: Request) -> Found:
    """Every organiser through the handler that it names, or the default where the name is unknown."""
    names = decide.handlers.names()
    picked = decide.pick_handler(organisers, names)
    found = None
    for name in names:
        handler: Callable[[DataFrame, Request], Found] = decide.handlers.get(name)
        part = handler(picked.where(F.col("handler_used") == name).drop("handler_known", "handler_used"), request)
        found = part if found is None else found.union(part)
    return found
