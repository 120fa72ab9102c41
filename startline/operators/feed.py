"""A bulk feed of weekly events as event fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startline.functions.text import blank_to_null, strip
from startline.functions.urls import normal_url

# The feed's words for a junior event and for an unknown place.
JUNIOR, UNKNOWN = "junior parkrunning", "-Unknown-"
DEFAULT_COUNTRY = "United Kingdom"


def is_junior(status: Column) -> Column:
    return F.coalesce(F.lower(strip(status)) == JUNIOR, F.lit(False))


def location_text(county: Column, state: Column, country: Column) -> Column:
    """The known parts, nearest first, joined by commas; null if there are none."""
    parts = [F.nullif(blank_to_null(c), F.lit(UNKNOWN)) for c in (county, state, country)]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def coordinates(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Numbers; a blank cell is null alone, one that is not a number makes both null."""
    cells = [F.nullif(c, F.lit("")) for c in (latitude, longitude)]
    numbers = [strip(c).try_cast("double") for c in cells]
    good = F.lit(True)
    for cell, number in zip(cells, numbers, strict=True):
        good = good & (cell.isNull() | number.isNotNull())
    return F.when(good, numbers[0]), F.when(good, numbers[1])


def feed_events(rows: DataFrame, today: str, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """url and event fields of one country's rows; rows without name or website are left out."""
    name, site = blank_to_null(F.col("Event")), blank_to_null(F.col("Website"))
    junior = is_junior(F.col("Status"))
    by = lambda young, other: F.when(junior, F.lit(young)).otherwise(F.lit(other))
    latitude, longitude = coordinates(F.col("Latitude"), F.col("Longitude"))
    place = location_text(F.col("County"), F.col("State"), F.col("Country"))
    distance = F.struct(by("2k", "5k").alias("distance_text"), F.lit("Free").alias("price_text"), by("2_k", "5k").alias("distance_category"))
    text = F.lit(None).cast("string")
    nothing = F.array().cast("array<struct<date_text:string,date_iso:string,time_text:string,time_24h:string,price_text:string>>")
    fields = {
        "url": normal_url(site), "name": name, "sport": F.lit("running"), "summary": name, "summary_alt": name, "summary_short": name,
        "date_text": F.concat(F.lit("Every "), by("Sunday", "Saturday"), F.lit(", 9:00am")),
        "location": place, "start_location": place, "finish_location": place, "age_restriction_text": F.when(junior, F.lit("Ages 4-14")),
        "is_valid_event": F.lit(True), "invalid_reason": text, "registration_status": F.lit("not_required"), "registration_text": text,
        "registration_opens_date_iso": text, "registration_opens_time_24h": text, "registration_closes_date_iso": text, "registration_closes_time_24h": text,
        "lifecycle_status": F.lit("scheduled"), "lifecycle_text": text, "distances": F.array(distance), "occurrence": F.lit("weekly"),
        "occurrence_weekdays": F.array(by("sun", "sat")), "occurrence_time": F.lit("09:00"), "occurrence_starts_on": F.lit(today), "occurrence_ends_on": text,
        "occurrences": nothing, "latitude": latitude, "longitude": longitude,
    }
    return rows.where((F.col("Country") == country) & name.isNotNull() & site.isNotNull()).select(*[c.alias(k) for k, c in fields.items()])


def import_summary(events: DataFrame | None, organiser: str) -> dict:
    """What an import did: unusable feeds register nothing; otherwise every attempted row counts."""
    return {"status": "unusable" if events is None else "ok", "registered": 0 if events is None else events.count(), "organiser": organiser}
