"""Text: trimming, slugs, categories, labels, escaping, excerpts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabulary of sports.
SPORTS = ("running", "cycling", "swimming", "triathlon", "multi_sport", "walking", "obstacle", "other")
# Categories that mean the same distance.
CATEGORY_ALIASES = {
    "middle_distance_triathlon": "half_ironman",
    "70_3": "half_ironman",
    "long_distance_triathlon": "ironman",
    "full_distance_triathlon": "ironman",
    "140_6": "ironman",
    "standard_triathlon": "olympic_triathlon",
    "kids": "junior",
    "kids_race": "junior",
    "junior_race": "junior",
    "youth": "junior",
    "youth_race": "junior",
}
# Kilometre distances that are always written without an underscore.
ROUND_KILOMETRES = (5, 10, 15, 20)
# What marks a control that shows more of a listing, and the excerpt's sizes.
MORE_KEYWORDS = ("load more", "loadmore", "load-more", "show more", "view more", "pagination", "next page", "page-next", 'rel="next"')
EXCERPT_MOST, EXCERPT_HEAD, EXCERPT_BEFORE, EXCERPT_AFTER, EXCERPT_GAP = 60_000, 4_000, 300, 1_500, "\n...\n"
UK_POSTCODE = r"\b([A-Za-z]{1,2}[0-9][A-Za-z0-9]?\s*[0-9][A-Za-z]{2})\b"


def strip(c: Column) -> Column:
    """Without white space at either end, line ends and tabs included (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def blank_to_null(c: Column) -> Column:
    """The stripped text; null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def slugify(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def canonical_category(slug: Column) -> Column:
    """The one spelling of a category slug."""
    aliases = F.create_map(*[F.lit(x) for pair in CATEGORY_ALIASES.items() for x in pair])
    kilometres = "^(" + "|".join(map(str, ROUND_KILOMETRES)) + ")_k$"
    return F.when(slug.rlike(kilometres), F.regexp_replace(slug, "_k$", "k")).otherwise(F.coalesce(aliases[slug], slug))


def coerce_sport(c: Column) -> Column:
    """A sport of the vocabulary; `other` for anything else, null and blank included."""
    slug = slugify(c)
    return F.when(slug.isin(*SPORTS), slug).otherwise(F.lit("other"))


def race_label(sport: Column, category: Column) -> Column:
    """sport_category; null without a category, before or after it is made a slug."""
    found = canonical_category(slugify(category))
    return F.when(F.length(found) > 0, F.concat_ws("_", coerce_sport(sport), found))


def uk_postcode(c: Column) -> Column:
    """The first postcode in a text, or null."""
    return F.nullif(F.regexp_extract(c, UK_POSTCODE, 1), F.lit(""))


def place_candidates(*fields: Column) -> Column:
    """What to look up for a place, in order: each non-blank field, then its postcode if that is not all of it."""
    steps = []
    for c in fields:
        code = uk_postcode(c)
        steps += [F.when(blank_to_null(c).isNotNull(), c), F.when(F.lower(strip(code)) != F.lower(strip(c)), code)]
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def distance_label(text: Column, label: Column, price: Column) -> Column:
    """`text [label]: price`; the label and the price may be missing."""
    named = F.when(label.isNotNull(), F.concat(text, F.lit(" ["), label, F.lit("]"))).otherwise(text)
    return F.when(filled(price), F.concat(named, F.lit(": "), price)).otherwise(named)


def occurrence_label(date: Column, time: Column, price: Column) -> Column:
    """`date time: price`; time and price may be missing, a null date is empty."""
    when = F.concat_ws(" ", F.coalesce(date, F.lit("")), F.when(filled(time), time))
    return F.when(filled(price), F.concat(when, F.lit(": "), price)).otherwise(when)


def joined(items: Column, separator: str = "; ") -> Column:
    """Array of text as one line; empty, not null, if there are none."""
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def html_escape(c: Column, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quote else [])
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def quote_plus(c: Column) -> Column:
    """Form encoding with space as plus, tilde kept and asterisk encoded."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def maps_url(latitude: Column, longitude: Column, *places: Column) -> Column:
    """A map search for the coordinates if there are both, else for the first non-empty place, else null."""
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), maps_query(latitude, longitude, *places))


def maps_embed(latitude: Column, longitude: Column, *places: Column) -> Column:
    """The same place as a frame of a page."""
    return F.concat(F.lit("https://www.google.com/maps?q="), maps_query(latitude, longitude, *places), F.lit("&output=embed"))


def maps_query(latitude: Column, longitude: Column, *places: Column) -> Column:
    at = F.concat_ws(",", latitude.cast("string"), longitude.cast("string"))
    return F.when(latitude.isNotNull() & longitude.isNotNull(), at).otherwise(quote_plus(first_place(*places)))


def first_place(*places: Column) -> Column:
    """The first place that is not empty, or null."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in places])


def sitemap_directive(robots: Column) -> Column:
    """What follows the first `sitemap:` line of a robots file, or null."""
    return F.nullif(F.regexp_extract(robots, r"(?im)^[ \t]*sitemap:[ \t]*(.*?)[ \t\r]*$", 1), F.lit(""))


def key_values(pairs: Column) -> Column:
    """Map from an array of `key=value`; cut at the first =, an entry without one has an empty value, the last wins."""
    cut = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.expr("null")).otherwise(F.lit("")).alias("e"), p.alias("p")))
    entries = F.transform(cut, lambda s: F.struct(s["k"], F.coalesce(s["e"], F.substr(s["p"], F.length(s["k"]) + 2))))
    last = F.filter(entries, lambda s, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda t: t["k"] == s["k"]))
    return F.map_from_entries(last)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keyword_places(low: Column, word: str) -> Column:
    """Array of the positions (from 0) of a word that cannot overlap itself; a text without the word is not split."""
    # what is split off before each hit, added up; what follows the last one is not measured
    parts = F.split(low, "\\Q" + word + "\\E", -1)
    sizes = let(parts, lambda all: F.transform(F.slice(all, 1, F.size(all) - 1), lambda p: F.length(p)))
    places = let(sizes, lambda before: F.transform(before, lambda _, i: F.aggregate(F.slice(before, 1, i + 1), F.lit(0), lambda s, x: s + x) + i * len(word)))
    return F.when(F.contains(low, F.lit(word)), places).otherwise(F.array().cast("array<int>"))


def excerpt(html: Column) -> Column:
    """Short pages whole; of long ones the head and a window about every keyword, joined, up to the most.

    Overlapping windows are merged. Positions are characters.
    """
    return let(html, lambda h: let(F.length(h), lambda size: _excerpt(h, size)))


def _excerpt(html: Column, size: Column) -> Column:
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    found = let(F.lower(html), lambda low: F.flatten(F.array(*[keyword_places(low, word) for word in MORE_KEYWORDS])))
    windows = F.array_sort(
        F.concat(F.array(span(F.lit(0), F.lit(EXCERPT_HEAD))), F.transform(found, lambda p: span(F.greatest(p - EXCERPT_BEFORE, F.lit(0)), F.least(p + EXCERPT_AFTER, size))))
    )
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def add(done, w):
        last = F.try_element_at(done, F.lit(-1))
        touching = last.isNotNull() & (w["a"] <= last["b"])
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(span(last["a"], F.greatest(last["b"], w["b"]))))
        return F.when(touching, grown).otherwise(F.concat(done, F.array(w)))

    merged = F.aggregate(windows, empty, add)
    cut = F.array_join(F.transform(merged, lambda w: F.substr(html, w["a"] + 1, w["b"] - w["a"])), EXCERPT_GAP)
    return F.when(size <= EXCERPT_MOST, html).otherwise(F.substring(cut, 1, EXCERPT_MOST))
