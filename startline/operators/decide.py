"""What to do with each address of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startline.functions.coerce import GONE

CHECK_MODES = ("hash-check", "url-check", "force")
RUN_MODES = ("normal", "dry-run", "sanity-check")


def content_hash(markdown: Column) -> Column:
    return F.sha2(markdown, 256)


def decide(requests: DataFrame, mode: str = "hash-check") -> DataFrame:
    """requests with action, run_status and detail, by the first rule that holds.

    From allowed (boolean), known (the address is stored), page_status, fetched, old_hash, new_hash, extracted (null
    where extraction is not known yet), is_valid and invalid_reason. Robots come first, then the url check, dead
    links, failed fetches, unchanged pages, failed extractions.
    """
    if mode not in CHECK_MODES:
        raise ValueError(f"unknown check mode {mode!r}; one of {', '.join(CHECK_MODES)}")
    dead = F.coalesce(F.col("page_status").isin(*GONE), F.lit(False))
    same = F.lit(mode == "hash-check") & F.col("known") & F.coalesce(F.col("old_hash") == F.col("new_hash"), F.lit(False))
    action = (
        F.when(~F.col("allowed"), F.lit("robots-skip"))
        .when(F.lit(mode == "url-check") & F.col("known"), F.lit("url-skip"))
        .when(dead, F.lit("dead-link"))
        .when(~F.col("fetched"), F.lit("fetch-failed"))
        .when(same, F.lit("unchanged"))
        .when(~F.coalesce(F.col("extracted"), F.lit(True)), F.lit("extraction-failed"))
        .otherwise(F.lit("upsert"))
    )
    out = requests.withColumn("action", action)
    run_status = F.when(F.col("action").isin("robots-skip", "url-skip"), F.lit("skipped")).when(F.col("action").isin("fetch-failed", "extraction-failed"), F.lit("failed")).otherwise(F.lit("success"))
    detail = (
        F.when(F.col("action") == "robots-skip", F.lit("disallowed by robots.txt"))
        .when(F.col("action") == "url-skip", F.lit("url already exists, skipped (url-check)"))
        .when(F.col("action") == "dead-link", F.concat(F.lit("confirmed dead link (HTTP "), F.col("page_status").cast("string"), F.lit(")")))
        .when(F.col("action") == "fetch-failed", F.lit("page could not be fetched"))
        .when(F.col("action") == "unchanged", F.lit("unchanged, skipped extraction"))
        .when(F.col("action") == "extraction-failed", F.lit("extraction returned no fields"))
        .when(F.coalesce(F.col("is_valid"), F.lit(True)), F.lit("extracted"))
        .otherwise(F.concat(F.lit("extracted (invalid event: "), F.coalesce("invalid_reason", F.lit("None")), F.lit(")")))
    )
    return out.withColumns({"run_status": run_status, "detail": detail})


def eligible(organisers: DataFrame, organiser_id: int | None = None) -> DataFrame:
    """Active organisers of type organiser; one of them if named."""
    rows = organisers.where(F.col("active") & (F.col("source_type") == "organiser"))
    return rows if organiser_id is None else rows.where(F.col("id") == organiser_id)


def planned(found: DataFrame, mode: str = "normal", by: str = "organiser_id", order: str = "url") -> DataFrame:
    """What a run mode crawls: all, nothing, or one address for each organiser."""
    if mode not in RUN_MODES:
        raise ValueError(f"unknown run mode {mode!r}; one of {', '.join(RUN_MODES)}")
    if mode == "dry-run":
        return found.limit(0)
    if mode == "sanity-check":
        return found.groupBy(by).agg(F.min_by(F.struct(*found.columns), F.struct(order)).alias("_first")).select("_first.*")
    return found


def check_mode_of(force_refresh: bool, check_mode: str) -> str:
    return "force" if force_refresh else check_mode


def aborted(asked: DataFrame) -> bool:
    """Whether a run must stop, by the `error` of what it asked for: the connection itself, not one page, failed."""
    return not asked.where(F.coalesce(F.col("error") == "ConnectionError", F.lit(False))).isEmpty()


def pick_handler(organisers: DataFrame, handlers: list[str], default: str = "default") -> DataFrame:
    """organisers with handler_used (the default for unknown names) and handler_known."""
    known = F.coalesce(F.col("handler").isin(*handlers), F.lit(False))
    return organisers.withColumns({"handler_known": known, "handler_used": F.when(known, F.col("handler")).otherwise(F.lit(default))})


class Registry:
    """Names to functions; unknown names are None."""

    def __init__(self):
        self._found = {}

    def register(self, name: str, function):
        self._found[name] = function
        return function

    def get(self, name: str):
        return self._found.get(name)

    def names(self) -> list[str]:
        return sorted(self._found)


handlers, importers = Registry(), Registry()
