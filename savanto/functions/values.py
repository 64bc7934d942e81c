"""Number, date and label expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_LISTED = 10  # fixed value: stands in for a missing or non-positive listed count


def abbreviated_count(text: Column) -> Column:
    """``1.2k`` is 1200, ``5m`` 5000000, ``544`` 544, ``54.4`` 5440; anything else NULL."""
    number = F.regexp_extract(text, r"^([0-9]+\.?[0-9]*)[km]$", 1).try_cast("double")
    return (
        F.when(text.rlike(r"^[0-9]+\.?[0-9]*k$"), (number * 1000).cast("bigint"))
        .when(text.rlike(r"^[0-9]+\.?[0-9]*m$"), (number * 1000000).cast("bigint"))
        .when(text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint"))
        .when(text.rlike(r"^-?[0-9]*\.[0-9]+$|^-?[0-9]+\.$"), (text.try_cast("double") * 100).cast("bigint"))
    )


def grouped_int(text: Column) -> Column:
    """``1,234`` is 1234."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def second_word_int(text: Column) -> Column:
    """The second blank-separated word as a grouped integer."""
    return grouped_int(F.get(F.split(text, " "), F.lit(1)))


def log_weight(listed_count: Column) -> Column:
    """Natural log of the listed count; missing or non-positive counts as 10."""
    usable = F.when(listed_count.isNull() | (listed_count <= 0), F.lit(DEFAULT_LISTED)).otherwise(listed_count)
    return F.ln(usable.cast("double"))


def rescale(score: Column, low: Column, high: Column, base_low: Column, base_high: Column) -> Column:
    """Map ``[low, high]`` onto ``[base_low, base_high]``; a single-valued range maps to the top."""
    norm = F.when(high == low, F.lit(1.0)).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))
    return norm * (base_high - base_low) + base_low


def signature_distance(a: Column, b: Column) -> Column:
    """``|a-b| / (|a|+|b|)``; a missing signature or a zero norm is most distant (1.0)."""

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    gap = norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))
    return F.coalesce(F.try_divide(gap, norm(a) + norm(b)), F.lit(1.0))


def relative_age(then: Column, now: Column) -> Column:
    """``3 minutes ago``, ``yesterday`` or a date; the whole difference counts."""
    seconds = F.timestamp_diff("SECOND", then, now)

    def ago(unit: int, name: str) -> Column:
        plural = F.when(seconds == unit, F.lit("")).otherwise(F.lit("s"))
        return F.concat((seconds / unit).cast("bigint").cast("string"), F.lit(f" {name}"), plural, F.lit(" ago"))

    return (
        F.when(seconds < 60, ago(1, "second"))
        .when(seconds < 3600, ago(60, "minute"))
        .when(seconds < 86400, ago(3600, "hour"))
        .when(seconds < 172800, F.lit("yesterday"))
        .otherwise(F.date_format(then, "MMM d / yy - HH:mm"))
    )


def reputation_text(rep: Column) -> Column:
    """999, 1,234, 12k, 12.3k. Ties follow the binary value of rep/1000, as C printf does."""
    rep = rep.cast("bigint")
    tenths = F.floor(rep / 100).cast("bigint")
    # rep/1000 as a double against the exact tie, both scaled to whole numbers
    shift = F.lit(56) - F.floor(F.log2(F.greatest(rep, F.lit(1)) / F.lit(1000.0))).cast("int")
    scaled = ((rep / F.lit(1000.0)) * F.pow(F.lit(2.0), shift)).cast("bigint").cast("decimal(20,0)") * 1000
    exact = rep.cast("decimal(17,0)") * F.pow(F.lit(2.0), shift).cast("bigint").cast("decimal(20,0)")
    up = F.when(scaled > exact, 1).when(scaled < exact, 0).otherwise(tenths % 2)
    rounded = tenths + F.when(rep % 100 > 50, 1).when(rep % 100 < 50, 0).otherwise(up)
    text = rep.cast("string")
    return (
        F.when(rep < 1000, text)
        .when(rep < 10000, F.concat(F.substring(text, 1, 1), F.lit(","), F.substring(text, 2, 9)))
        .when(rep % 1000 == 0, F.concat((rep / 1000).cast("bigint").cast("string"), F.lit("k")))
        .otherwise(
            F.concat(
                F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit("k")
            )
        )
    )


def enum_name(text: Column, members: Sequence[str], overrides: Mapping[str, str] | None = None) -> Column:
    """snake_case to the CamelCase member of an enumeration; unknown text passes through."""
    overrides = dict(overrides or {})
    first_up = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    camel = F.array_join(F.transform(F.split(text, "_"), lambda p: F.initcap(p)), "")
    out = F.when(first_up.isin(list(members)), first_up)
    out = out.when(text.contains("_") & camel.isin(list(members)), camel).otherwise(text)
    for raw, name in overrides.items():
        out = F.when(text == raw, F.lit(name)).otherwise(out)
    return out


def or_default(value: Column, default: str) -> Column:
    """Replace a missing value, also when stored as the text ``None``."""
    return F.when(value.isNull() | (value == "None"), F.lit(default)).otherwise(value)


def is_stale(last_crawled: Column, now: Column, interval_seconds: int) -> Column:
    """Due again: never crawled, or at least ``interval_seconds`` old."""
    return last_crawled.isNull() | (F.timestamp_diff("SECOND", last_crawled, now) >= interval_seconds)


def fetch_route(status: Column) -> Column:
    """What to do with a fetched page, by HTTP status."""
    return (
        F.when(status.isin(404, 301), "blacklist").when(status.isin(403, 429), "stop").otherwise("parse")
    )


def user_url(domain: Column, user_id: Column) -> Column:
    return F.format_string("http://%s/users/%d", domain, user_id.cast("bigint"))


def question_url(domain: Column, question_id: Column) -> Column:
    return F.format_string("http://%s/questions/%d", domain, question_id.cast("bigint"))


def answer_url(domain: Column, question_id: Column, answer_id: Column) -> Column:
    q, a = question_id.cast("bigint"), answer_id.cast("bigint")
    return F.format_string("http://%s/questions/%d/%d#%d", domain, q, a, a)
