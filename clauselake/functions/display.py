"""Columns as people read them: headlines, shares, ages, sizes, keys and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN = r"^[a-z0-9.-]{1,253}$"


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """A number with thousands separators and its noun."""
    return F.concat_ws(" ", F.format_number(n, 0), F.when(n == 1, one).otherwise(many or one + "s"))


def share(x: Column) -> Column:
    """Whole percents from a tenth on, one decimal below."""
    return F.when(x >= 0.1, F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))).otherwise(F.concat(F.format_number(x * 100, 1), F.lit("%")))


def flagged_headline(flagged: Column, read: Column) -> Column:
    text = F.concat(flagged.cast("string"), F.lit(" potentially unfair clause"), F.when(flagged == 1, "").otherwise("s"), F.lit(" in "), read.cast("string"), F.lit(" read"))
    return F.when(flagged == 0, "No potentially unfair clauses found").otherwise(text)


def badge(flagged: Column) -> Column:
    return F.when(flagged == 0, "clean").when(flagged < 8, "some").otherwise("many")


def _ago(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))


def age_seconds(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(at)) / 1000.0)


def rounded_age(at: Column, now: Column) -> Column:
    """Each unit rounded from the one before: minutes from 90 seconds, hours from 90 minutes, days from 36 hours."""
    half_up = lambda x: F.floor(x + 0.5)
    seconds = half_up(age_seconds(at, now))
    minutes = half_up(seconds / 60)
    hours = half_up(minutes / 60)
    return (
        F.when(seconds < 90, "just now")
        .when(minutes < 90, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(hours < 36, _ago(hours, "hour"))
        .otherwise(_ago(half_up(hours / 24), "day"))
    )


def floored_age(at: Column, now: Column) -> Column:
    """The largest whole unit; nothing below 90 seconds."""
    s = age_seconds(at, now)
    return F.when(s < 90, "just now").when(s >= 86400, _ago(F.floor(s / 86400), "day")).when(s >= 3600, _ago(F.floor(s / 3600), "hour")).otherwise(_ago(F.floor(s / 60), "minute"))


def short_date(at: Column) -> Column:
    return F.date_format(at, "d MMM yyyy")


def byte_size(n: Column) -> Column:
    half_up = lambda x: F.floor(x + 0.5).cast("string")
    return (
        F.when(n >= 1e9, F.concat(F.format_string("%.1f", n / 1e9), F.lit(" GB")))
        .when(n >= 1e6, F.concat(half_up(n / 1e6), F.lit(" MB")))
        .otherwise(F.concat(F.greatest(F.lit(1), F.floor(n / 1e3 + 0.5)).cast("string"), F.lit(" kB")))
    )


def integrity(hex_digest: Column) -> Column:
    """A sha-256 in hexadecimal as a subresource-integrity value."""
    return F.concat(F.lit("sha256-"), F.base64(F.unhex(hex_digest)))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def fingerprint(items: Column) -> Column:
    """The same for arrays of the same strings in any order."""
    return F.array_join(F.array_sort(items), "|")


def confidence_percent(probs: Column, at: Column) -> Column:
    """Percent of the class at a place from 0, half up."""
    return F.floor(F.get(probs, at) * 100 + 0.5).cast("int")


def retry_after_ms(tokens: Column, capacity: float, per_ms: float) -> Column:
    """How long until a bucket that refills `capacity` in `per_ms` holds a whole token."""
    return F.ceil((1 - tokens) * per_ms / capacity).cast("long")


def is_domain(text: Column) -> Column:
    return F.coalesce(text.rlike(DOMAIN), F.lit(False))


def numbered(passages: Column) -> Column:
    """Passages (array of struct category, text) as the body of a prompt."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), p["category"], F.lit(") "), p["text"])), "\n\n")


def ordered_union(*arrays: Column) -> Column:
    """Elements of all arrays, each where it is first."""
    return F.array_distinct(F.concat(*arrays))


def without_reasoning(text: Column) -> Column:
    """A completion without its <think> parts; empty if one is not closed, as there is no answer then."""
    closed = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.when(closed.rlike("(?i)<think>"), "").otherwise(F.btrim(closed))
