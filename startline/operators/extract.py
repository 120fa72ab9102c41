"""From pages and model answers to the fields of events, and from fields to stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startline.functions import coerce
from startline.functions.dates import clock, iso_date, moment
from startline.functions.markup import first_event, with_structured_fields
from startline.functions.text import blank_to_null, place_candidates
from startline.operators.decide import content_hash

# What structured data can supply, and what a model is asked for as plain text.
KNOWN = ("name", "sport", "summary", "date_text", "location")
ASKED = (
    "name", "sport", "summary", "date_text", "location", "start_location", "finish_location", "age_restriction_text",
    "registration_text", "registration_opens_date_iso", "registration_opens_time_24h", "registration_closes_date_iso",
    "registration_closes_time_24h", "lifecycle_text", "occurrence_time", "occurrence_starts_on", "occurrence_ends_on",
)
ALWAYS = ("distances", "is_valid_event", "invalid_reason", "occurrence", "occurrences", "occurrence_weekdays", "registration_status", "lifecycle_status")


def known_fields(pages: DataFrame, **more) -> DataFrame:
    """pages with `known`: name, sport, summary, date_text and location of their structured data."""
    return with_structured_fields(pages.withColumn("_event", first_event(F.col("html"))), "_event", "known", **more).drop("_event")


def asked_fields(known: Column) -> Column:
    """The names a model is asked for: all but those known, the date always."""
    mine = F.filter(F.array(*[F.when(known[k].isNotNull() & (known[k] != ""), F.lit(k)) for k in KNOWN if k != "date_text"]), lambda x: x.isNotNull())
    return F.array_except(F.array(*[F.lit(x) for x in (*ASKED, *ALWAYS)]), mine)


def event_fields(pages: DataFrame) -> DataFrame:
    """url and event fields from `known` and the answer (VARIANT) of the extraction task; rows without answer go.

    Structured data wins over the answer, but for the date of events that recur. A blank page has no fields.
    """
    v, known = F.col("answer"), F.col("known")
    asked = {k: coerce.printed(coerce.field(v, k)) for k in ASKED}
    occurrence = coerce.one_of(coerce.text_of(coerce.field(v, "occurrence")), coerce.OCCURRENCES)
    fields = {k: F.coalesce(F.nullif(known[k], F.lit("")), asked[k]) if k in KNOWN else asked[k] for k in ASKED}
    fields["date_text"] = coerce.merged_date_text(occurrence, known["date_text"], asked["date_text"])
    valid, reason = coerce.validity(v)
    days = F.filter(F.transform(coerce.items_of(coerce.field(v, "occurrence_weekdays")), coerce.text_of), lambda x: x.isNotNull())
    fields |= {
        "is_valid_event": valid,
        "invalid_reason": reason,
        "registration_status": coerce.one_of(coerce.text_of(coerce.field(v, "registration_status")), coerce.REGISTRATIONS),
        "lifecycle_status": coerce.one_of(coerce.text_of(coerce.field(v, "lifecycle_status")), coerce.LIFECYCLES),
        "distances": coerce.distances(coerce.field(v, "distances")),
        "occurrence": occurrence,
        "occurrence_weekdays": coerce.weekdays(days),
        "occurrences": coerce.occurrences(coerce.field(v, "occurrences")),
    }
    rows = pages.where(blank_to_null(F.col("markdown")).isNotNull() & F.col("answer").isNotNull())
    return rows.select("url", content_hash(F.col("markdown")).alias("content_hash"), *[c.alias(k) for k, c in fields.items()])


def with_summaries(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """Supplied alternatives are kept if both columns are there; otherwise the rewrite task's, null where it has none.

    answers: url and answer (VARIANT), asked only for non-blank summaries.
    """
    if {"summary_alt", "summary_short"} <= set(fields.columns):
        return fields
    both = fields.join(answers.select("url", F.col("answer").alias("_a")), "url", "left")
    has = blank_to_null(F.col("summary")).isNotNull()
    return both.withColumns({k: F.when(has, blank_to_null(coerce.printed(coerce.field(F.col("_a"), k)))) for k in ("summary_alt", "summary_short")}).drop("_a")


def with_coordinates(fields: DataFrame, places: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Supplied pairs win, then the places of the candidate ladder, then what the event had before."""
    from startline.sources.lookups import geocoded

    if "latitude" not in fields.columns:
        fields = fields.withColumns({"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    supplied = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    ladder = place_candidates(F.col("location"), F.col("start_location"), F.col("finish_location"))
    asked = fields.where(~supplied).select("url", ladder.alias("candidates"))
    found = geocoded(asked, places).select("url", F.struct("latitude", "longitude").alias("_found")).where("_found.latitude IS NOT NULL")
    out = fields.join(found, "url", "left")
    own = F.when(supplied, F.struct("latitude", "longitude"))
    steps = [own, F.col("_found")]
    if before is not None:
        out = out.join(before.select("url", F.struct("latitude", "longitude").alias("_before")), "url", "left")
        steps.append(F.col("_before"))
    at = F.coalesce(*steps)
    return out.withColumn("_at", at).withColumns({"latitude": F.col("_at.latitude"), "longitude": F.col("_at.longitude")}).drop("_at", "_found", "_before")


def event_rows(fields: DataFrame, registrator: Column) -> DataFrame:
    """Stored columns of events from their fields; children stay as arrays."""
    plain = ("name", "sport", "summary", "summary_alt", "summary_short", "date_text", "location", "start_location", "finish_location", "age_restriction_text", "registration_text", "lifecycle_text", "invalid_reason", "latitude", "longitude", "distances", "occurrences", "content_hash")
    kept = [c for c in plain if c in fields.columns]
    days = F.col("occurrence_weekdays")
    return fields.select(
        "url",
        *kept,
        F.when(F.coalesce("is_valid_event", F.lit(True)), F.lit("valid")).otherwise(F.lit("invalid")).alias("status"),
        F.coalesce("registration_status", F.lit("unknown")).alias("registration_status"),
        F.coalesce("lifecycle_status", F.lit("scheduled")).alias("lifecycle_status"),
        moment(F.col("registration_opens_date_iso"), F.col("registration_opens_time_24h")).alias("registration_opens_at"),
        moment(F.col("registration_closes_date_iso"), F.col("registration_closes_time_24h")).alias("registration_closes_at"),
        F.coalesce("occurrence", F.lit("one_off")).alias("occurrence"),
        F.when(F.size(days) > 0, days).alias("occurrence_weekdays"),
        clock(F.col("occurrence_time")).alias("occurrence_time"),
        iso_date(F.col("occurrence_starts_on")).alias("occurrence_starts_on"),
        iso_date(F.col("occurrence_ends_on")).alias("occurrence_ends_on"),
        registrator.alias("registrator"),
    )


def listing_answer(pages: DataFrame) -> DataFrame:
    """event_urls and next_page from the answer of the listing task and the page's candidates; nothing without them."""
    v, candidates = F.col("answer"), F.col("candidates")
    one = F.array(F.try_variant_get(v, "$.next_page_index", "variant"))
    following = F.get(F.transform(F.filter(one, lambda x: F.schema_of_variant(x) == "BIGINT"), lambda x: F.try_variant_get(x, "$", "int")), F.lit(0))
    found = coerce.chosen(coerce.field(v, "event_indices"), candidates)
    next_page = F.when((following >= 0) & (following < F.size(candidates)), F.get(candidates, following))
    return pages.withColumns({"event_urls": F.coalesce(found, F.array().cast("array<string>")), "next_page": next_page})


def discovered_listings(pages: DataFrame) -> DataFrame:
    """listing_urls: what the discovery task proposes of the page's links and the homepage itself."""
    proposed = F.filter(F.transform(coerce.items_of(coerce.field(F.col("answer"), "listing_urls")), coerce.text_of), lambda x: x.isNotNull())
    return pages.withColumn("listing_urls", coerce.allowed_only(proposed, F.col("candidates"), F.col("homepage_url")))


def more_control(pages: DataFrame) -> DataFrame:
    """interaction and selector from the answer of the load-more task; none on failure."""
    v = F.col("answer")
    selector = blank_to_null(coerce.text_of(coerce.field(v, "selector")))
    return pages.withColumn("interaction", coerce.interaction(coerce.text_of(coerce.field(v, "interaction_type")), selector)).withColumn("selector", F.when(F.col("interaction") != "none", selector))
