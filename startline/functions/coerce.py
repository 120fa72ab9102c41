"""Model answers made safe: closed vocabularies, lists, indices. Answers are VARIANT columns, from parse_json()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from startline.functions.text import filled, strip

# Closed vocabularies, the first of each list being what anything else becomes.
OCCURRENCES = ("one_off", "daily", "weekly", "monthly", "yearly", "specific_dates")
REGISTRATIONS = ("unknown", "not_required", "open", "closed")
LIFECYCLES = ("scheduled", "cancelled", "postponed")
INTERACTIONS = ("none", "append", "paginate")
# Weekdays as they are stored.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
# Statuses that mean that a page is gone.
GONE = (404, 410)


def text_of(v: Column) -> Column:
    """The text of a JSON string; null for any other kind."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def printed(v: Column) -> Column:
    """Text, numbers and true as text; null for empty, zero, false and null."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.when((kind == "STRING") & (text != ""), text).when((kind == "BOOLEAN") & (text == "true"), F.lit("True")).when(~kind.isin("STRING", "BOOLEAN", "VOID") & ~text.isin("0", "0.0"), text)


def one_of(text: Column, vocabulary: tuple[str, ...]) -> Column:
    """The stripped lower-case text if it is in the vocabulary, else its first word."""
    word = F.lower(strip(text))
    return F.when(word.isin(*vocabulary), word).otherwise(F.lit(vocabulary[0]))


def weekdays(items: Column) -> Column:
    """Sorted distinct weekdays of an array of text; empty if null."""
    words = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda w: F.lower(strip(w)))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isin(*WEEKDAYS))))


def items_of(v: Column) -> Column:
    """The elements of a JSON array; empty for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def validity(answer: Column) -> tuple[Column, Column]:
    """Whether an event is valid (true unless a JSON false) and, if not, the stripped reason."""
    flag, reason = F.try_variant_get(answer, "$.is_valid_event", "variant"), F.try_variant_get(answer, "$.invalid_reason", "variant")
    valid = F.coalesce(F.when(F.schema_of_variant(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean")), F.lit(True))
    return valid, F.when(~valid, strip(printed(reason)))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def distances(v: Column) -> Column:
    """Well-formed entries of a JSON array: distance_text, price_text, distance_category."""
    entry = lambda x: F.struct(
        printed(field(x, "distance_text")).alias("distance_text"),
        printed(field(x, "price_text")).alias("price_text"),
        F.lower(strip(printed(field(x, "distance_category")))).alias("distance_category"),
    )
    return F.filter(F.transform(F.filter(items_of(v), is_object), entry), lambda e: e["distance_text"].isNotNull())


def occurrences(v: Column) -> Column:
    """Well-formed entries of a JSON array: date_text, date_iso, time_text, time_24h, price_text."""
    names = ("date_text", "date_iso", "time_text", "time_24h", "price_text")
    entry = lambda x: F.struct(*[printed(field(x, n)).alias(n) for n in names])
    return F.filter(F.transform(F.filter(items_of(v), is_object), entry), lambda e: e["date_text"].isNotNull() & e["date_iso"].isNotNull())


def chosen(indices: Column, candidates: Column) -> Column:
    """The candidates that a JSON array of whole numbers points at, in its order, each index once."""
    whole = F.filter(items_of(indices), lambda x: F.schema_of_variant(x) == "BIGINT")
    numbers = F.array_distinct(F.transform(whole, lambda x: F.try_variant_get(x, "$", "int")))
    return F.transform(F.filter(numbers, lambda n: (n >= 0) & (n < F.size(candidates))), lambda n: F.get(candidates, n))


def allowed_only(proposed: Column, candidates: Column, homepage: Column) -> Column:
    """Proposed links that are candidates or the homepage, order and repeats kept."""
    allowed = F.concat(candidates, F.array(homepage))
    return F.filter(proposed, lambda u: F.array_contains(allowed, u))


def interaction(kind: Column, selector: Column) -> Column:
    """How a listing shows more; paging without a selector is none."""
    word = one_of(kind, INTERACTIONS)
    return F.when((word == "paginate") & ~filled(selector), F.lit("none")).otherwise(word)


def merged_date_text(occurrence: Column, known: Column, answered: Column) -> Column:
    """Structured data wins for one-off events; otherwise the answer does unless it is blank."""
    return F.when(known.isNull() | (known == ""), answered).when(occurrence == "one_off", known).otherwise(F.coalesce(F.nullif(answered, F.lit("")), known))


def answer_budget(n: Column) -> Column:
    """Tokens that an answer about n candidates may take."""
    return F.least(F.lit(4000), F.lit(1000) + 8 * n)
