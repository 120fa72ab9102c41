"""Lookup tables in place of calls: pages, robots files, model answers, coordinates.

Every lookup is a left join on the request, so a call that failed is a null, as it is for a live provider. A live
provider is any function from requests to the same columns; retried() asks one again for what it left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from startline.operators import store

PAGES = "url string, markdown string, links array<string>, html string, final_url string"
PROBES = "url string, head_status int, get_status int"
ROBOTS = "site string, status int, body string"
ANSWERS = "task string, key string, answer string"
PLACES = "address string, rank int, latitude double, longitude double"
#: A listing after its control for more was pressed a number of times, and sitemap files.
VIEWS = "url string, press int, markdown string, links array<string>, html string"
SITEMAPS = "url string, xml string"

# The first status of a HEAD request that asks for a GET instead.
NOT_ALLOWED = 405


def fetch(requests: DataFrame, first: DataFrame, second: DataFrame | None = None, forced: str | None = None, key: str = "url") -> DataFrame:
    """Requests with markdown, links, html, final_url: from the first backend, else from the second; or one forced.

    Requests meet pages by `key`. Of several pages of one key in a backend each request gets the same one, the least.
    """
    fields = ("markdown", "links", "html", "final_url")
    sources = {"first": first, "second": second}
    order = [sources[forced]] if forced else [s for s in (first, second) if s is not None]
    out = requests
    for n, pages in enumerate(order):
        out = out.join(pages.groupBy(key).agg(F.min(F.struct(*fields)).alias(f"_{n}")), key, "left")
    found = F.coalesce(*[F.col(f"_{n}") for n in range(len(order))])
    return out.withColumns({f: found[f] for f in fields}).withColumn("fetched", found.isNotNull()).drop(*[f"_{n}" for n in range(len(order))])


def retried(requests: DataFrame, provider: Callable[[DataFrame, float], DataFrame], key: str = "url", tries: int = 3, least: float = 2.0, most: float = 30.0) -> DataFrame:
    """What a live provider answers, asked again for what it left out: rows of its columns, at most one for each key.

    The provider is given the requests that are still open and how many seconds to wait before them: none at first,
    then `least`, doubled each time up to `most`. What it answers is settled, so nothing is asked twice. A request
    that no try answers is left out, as a lookup leaves it out. Null keys are not asked.
    """
    left, found, wait = requests.where(F.col(key).isNotNull()).dropDuplicates([key]), None, 0.0
    for _ in range(tries):
        new = store.settle(provider(left, wait).dropDuplicates([key]))
        found = new if found is None else found.unionByName(new)
        left = store.settle(left.join(new.select(key), key, "left_anti"))
        if left.isEmpty():
            break
        wait = min(most, wait * 2 or least)
    return found


def liveness(requests: DataFrame, probes: DataFrame, key: str = "url") -> DataFrame:
    """Requests with page_status: of HEAD, of GET where HEAD is not allowed; null if inconclusive.

    Requests meet probes by `key`; of several probes of one key the least holds.
    """
    once = probes.groupBy(key).agg(F.min(F.struct("head_status", "get_status")).alias("_probe"))
    status = F.when(F.col("_probe.head_status") == NOT_ALLOWED, F.col("_probe.get_status")).otherwise(F.col("_probe.head_status"))
    return requests.join(once, key, "left").withColumn("page_status", status).drop("_probe")


def answered(requests: DataFrame, answers: DataFrame, task: str, key: str = "key") -> DataFrame:
    """Requests with `answer` (VARIANT) of a model task; null without a key, without an answer, or for bad JSON."""
    found = answers.where(F.col("task") == task).select(F.col("key").alias(key), F.try_parse_json("answer").alias("answer"))
    return requests.join(found, key, "left")


def geocoded(requests: DataFrame, places: DataFrame, candidates: str = "candidates", key: str = "url") -> DataFrame:
    """Requests with latitude and longitude of their first candidate that has a place; each place's first result."""
    first = places.groupBy("address").agg(F.min_by(F.struct("latitude", "longitude"), "rank").alias("at"))
    asked = requests.select(key, F.posexplode(candidates).alias("n", "address"))
    found = asked.join(first, "address").groupBy(key).agg(F.min_by("at", "n").alias("at"))
    return requests.join(found, key, "left").withColumns({"latitude": F.col("at.latitude"), "longitude": F.col("at.longitude")}).drop("at")
