"""Date and age rules, as Column expressions. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .text import col

DAY_MICROS = 86_400_000_000


def parse_timestamp(text: Column | str) -> Column:
    """Digits are epoch seconds, or milliseconds above 1e10; else ISO with UTC as default zone; else null."""
    text = F.trim(col(text).cast("string"))
    number = text.try_cast("double")
    micros = F.when(number > 1e10, number * 1000).otherwise(number * 1000000)
    return F.when(text.rlike(r"^\d+(?:\.\d+)?$"), F.timestamp_micros(micros.cast("bigint"))).otherwise(text.try_cast("timestamp"))


def age_to_posted_at(age: Column | str, now: Column) -> Column:
    """An age such as 3h or 2mo before now; anything else is null."""
    plain = F.trim(F.regexp_replace(col(age), "<[^>]*>", ""))
    pattern = r"^(\d+)(h|d|w|mo|yr)$"
    seconds = F.create_map(*[F.lit(x) for pair in {"h": 3600, "d": 86400, "w": 604800, "mo": 2592000, "yr": 31536000}.items() for x in pair])
    back = F.regexp_extract(plain, pattern, 1).try_cast("bigint") * F.try_element_at(seconds, F.regexp_extract(plain, pattern, 2))
    return F.timestamp_micros(F.unix_micros(now) - back * 1_000_000)


def posted_precision(source: Column | str, posted_at: Column | str) -> Column:
    """Instant, date, age_derived or unknown."""
    midnight = F.unix_micros(col(posted_at)) % DAY_MICROS == 0
    return (
        F.when(col(posted_at).isNull(), "unknown").when(col(source) == "listings", F.when(midnight, "date").otherwise("instant"))
        .when(col(source) == "ats", "instant").when(col(source).isin("swe", "ai"), "age_derived").otherwise("unknown")
    )


def local(when: Column | str) -> Column:
    return F.from_utc_timestamp(col(when), R.READER_ZONE)


def posted_day(posted_at: Column | str, first_seen: Column | str, precision: Column | str) -> Column:
    """The UTC date for date-only rows, else the reader's local date."""
    when = F.coalesce(col(posted_at), col(first_seen))
    return F.when(col(precision) == "date", F.to_date(when)).otherwise(F.to_date(local(when)))


def age_text(posted_at: Column | str, first_seen: Column | str, precision: Column | str, now: Column) -> Column:
    """N16."""
    when = F.coalesce(col(posted_at), col(first_seen))
    hours = F.floor((F.unix_micros(now) - F.unix_micros(when)) / F.lit(3_600_000_000))
    text = F.when(when.isNull(), "unknown").when(hours < 1, "just posted").when(hours < 24, F.concat(hours.cast("string"), F.lit("h old"))).otherwise(
        F.concat(F.floor(hours / 24).cast("string"), F.lit("d old"))
    )
    return F.when(col(posted_at).isNotNull() & (col(precision) != "instant"), F.concat(F.lit("~"), text)).otherwise(text)


def is_fresh(posted_at: Column | str, precision: Column | str, now: Column) -> Column:
    """at most 48 hours old, or posted yesterday or later where only the day is known."""
    age = F.unix_micros(now) - F.unix_micros(col(posted_at))
    day = posted_day(posted_at, posted_at, precision)
    fresh = F.when(col(precision) == "instant", age <= 2 * DAY_MICROS).otherwise(day >= F.date_sub(F.to_date(local(now)), 1))
    return F.coalesce(col(posted_at).isNotNull() & fresh, F.lit(False))


def is_quiet(now: Column | str) -> Column:
    """F11."""
    hour = F.hour(local(now))
    return (hour >= R.QUIET_FROM) | (hour < R.QUIET_TO)


def digest_due(now: Column | str, last: Column | str) -> Column:
    """C8, first half: past the digest hour, and none yet on this local day."""
    before = F.coalesce(F.to_date(local(last)) < F.to_date(local(now)), F.lit(True))
    return (F.hour(local(now)) >= R.DIGEST_HOUR) & before


def next_digest(now: Column | str) -> Column:
    """C8, second half: the next digest hour at or after now."""
    day = F.date_trunc("day", local(now))
    today = F.timestamp_add("HOUR", F.lit(R.DIGEST_HOUR), day)
    chosen = F.when(today >= local(now), today).otherwise(F.timestamp_add("HOUR", F.lit(24), today))
    return F.to_utc_timestamp(chosen, R.READER_ZONE)


def parse_applied_on(text: Column | str) -> Column:
    """The first of four date formats that fits the first ten characters."""
    head = F.trim(F.substr(col(text), F.lit(1), F.lit(10)))
    formats = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d"]
    return F.coalesce(*[F.to_date(F.try_to_timestamp(head, F.lit(f))) for f in formats])
