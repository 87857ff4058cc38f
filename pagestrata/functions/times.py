"""Times whose text is kept: parsing site times without a zone, offsets, floors, waits and backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted shapes, the site's zone, and pacing numbers
SITE_OFFSET_MINUTES = 480
NAIVE = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
RFC3339_OFFSET = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
BASE_INTERVAL_MS = 1000
MAX_INTERVAL_MS = 60_000
JITTER = 0.3
COOLDOWN_MS = (30 * 60_000, 60 * 60_000, 4 * 60 * 60_000)


def format_offset(minutes: int) -> str:
    sign, m = ("-" if minutes < 0 else "+"), abs(minutes)
    return "Z" if minutes == 0 else f"{sign}{m // 60:02d}:{m % 60:02d}"


def parse_naive(raw: Column, offset_minutes: int = SITE_OFFSET_MINUTES) -> Column:
    """struct(raw, iso, epoch_ms, tz, precision) of a time without zone, taken as local time of the offset; null for what is no such time or no such day."""
    text = F.trim(raw)
    good = text.rlike(NAIVE)
    day_only = good & ~F.contains(text, F.lit(":"))
    plain = F.when(good, F.replace(text, F.lit("T"), F.lit(" ")))
    day = F.substring_index(plain, " ", 1)
    clock = F.when(F.contains(plain, F.lit(" ")), F.substring_index(plain, " ", -1)).otherwise(F.lit("0:00:00"))
    clock = F.when(F.length(F.regexp_replace(clock, "[^:]", "")) == 1, F.concat(clock, F.lit(":00"))).otherwise(clock)
    at = F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("y-M-d H:mm:ss"))
    local = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    tz = format_offset(offset_minutes)
    found = F.struct(raw.alias("raw"), F.concat(local, F.lit(tz)).alias("iso"), (F.unix_millis(at) - 60_000 * offset_minutes).alias("epoch_ms"), F.lit(tz).alias("tz"), F.when(day_only, "day").otherwise("second").alias("precision"))
    return F.when(good & at.isNotNull(), found)


def to_rfc3339(at: Column, offset_minutes: int = 0) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(F.unix_millis(at) + 60_000 * offset_minutes), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(format_offset(offset_minutes)))


def warc_date(at: Column) -> Column:
    return to_rfc3339(at, 0)


def has_offset(text: Column) -> Column:
    return F.coalesce(text.rlike(RFC3339_OFFSET), F.lit(False))


def instant_ms(text: Column) -> Column:
    """Milliseconds of a time with an offset; null if it isn't one."""
    return F.when(has_offset(text), F.unix_millis(text.try_cast("timestamp")))


def reached_floor(at: Column, floor: Column) -> Column:
    """The floor itself counts; no floor is never reached."""
    return F.coalesce(at <= floor, F.lit(False))


def time_key(completed_at: Column, bundle_id: Column) -> Column:
    """Order of bundles: when they were completed, else the time in their id, else 0."""
    from pagestrata.functions.ids import bundle_time

    return F.coalesce(instant_ms(completed_at), F.unix_millis(bundle_time(bundle_id)), F.lit(0))


def backoff_ms(level: Column, base: int = BASE_INTERVAL_MS) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), level), F.lit(float(MAX_INTERVAL_MS))).cast("long")


def jittered_ms(interval: Column, draw: Column) -> Column:
    """``draw`` in 0..1 moves the interval by up to JITTER either way."""
    return F.round(interval * (1 + JITTER * (2 * draw - 1))).cast("long")


def cooldown_ms(level: Column) -> Column:
    """The wait that a backoff level asks for; none at level 0 or without a level."""
    return F.when(level.isNull() | (level <= 0), 0).when(level == 1, COOLDOWN_MS[0]).when(level == 2, COOLDOWN_MS[1]).otherwise(COOLDOWN_MS[2]).cast("long")


def required_cooldown_ms(level: Column, paused_at_ms: Column, now_ms: Column) -> Column:
    """What is left of the wait since the pause."""
    return F.when(paused_at_ms.isNull(), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0), cooldown_ms(level) - (now_ms - paused_at_ms)))
