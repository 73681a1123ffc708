"""Feed dates: unreadable stays NULL, an offset is dropped and the wall clock kept."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ownerlens import vocab as V
from ownerlens.functions.text import let, strip

_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}$"
_RFC_DATE = r"(?i)^\s*(?:[a-z]+,?\s+)?(\d{1,2})[ -]([a-z]{3})[a-z]*[ -](\d{4})\s+(\d{1,2}:\d{1,2}(?::\d{1,2})?)(?:\s.*)?$"
_MONTHS = [m[:3].lower() for m in V.MONTH_WORDS]


def _wall_clock(parts: Column) -> Column:
    """TIMESTAMP_NTZ of ``[year, month, day, hour, minute, second]`` texts; NULL when impossible.

    Built from the numbers, so the session time zone plays no part.
    """
    n = [F.get(parts, F.lit(i)).try_cast("int") for i in range(6)]
    return F.try_make_timestamp_ntz(n[0], n[1], n[2], n[3], n[4], n[5])


def parse_feed_date(raw: Column) -> Column:
    text = F.coalesce(raw.cast("string"), F.lit(""))
    iso = F.substring_index(strip(F.replace(text, F.lit("Z"), F.lit(""))), ".", 1)
    iso_parts = F.split(F.when(F.rlike(iso, F.lit(_ISO_DATE)), iso), "[-T :]")
    day, month = F.regexp_extract(text, _RFC_DATE, 1), F.lower(F.regexp_extract(text, _RFC_DATE, 2))
    year, clock = F.regexp_extract(text, _RFC_DATE, 3), F.split(F.regexp_extract(text, _RFC_DATE, 4), ":")
    number = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), month).cast("string")
    rfc_parts = F.concat(F.array(year, number, day), clock, F.array(F.lit("0")))
    return F.coalesce(
        let(iso_parts, _wall_clock), F.when(F.rlike(text, F.lit(_RFC_DATE)), let(rfc_parts, _wall_clock)))


def edition_label(ts: Column) -> Column:
    """The edition a run belongs to, by hour of day."""
    hour = F.hour(ts)
    return (
        F.when((hour >= 8) & (hour < 12), "10:00 AM")
        .when((hour >= 12) & (hour < 16), "2:00 PM")
        .when((hour >= 16) & (hour < 20), "6:00 PM")
        .otherwise(F.date_format(ts, "hh:00 a"))
    )
