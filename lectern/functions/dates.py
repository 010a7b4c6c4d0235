"""Date parsing and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as tx

# Hours from UTC of the named zones of mail dates.
NAMED_ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6,
    "PST": -8, "PDT": -7,
}
MAIL_DATE = (
    r"(?i)^\s*(?:[a-z]{3,}\s*,\s*)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*([+-]\d{4}|[a-z]+)?"
)


def parse_mail_date(value: Column | str) -> Column:
    """UTC timestamp of an RFC 822 date; a date without zone is UTC, an unreadable one null."""
    text = tx.col(value)
    day, month, year, clock, zone = (F.regexp_extract(text, MAIL_DATE, i) for i in range(1, 6))
    clock = F.when(F.length(clock) <= 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    local = F.try_to_timestamp(F.concat_ws(" ", day, F.initcap(month), year, clock), F.lit("d MMM yyyy H:mm:ss"))
    table = F.create_map(*[F.lit(x) for pair in NAMED_ZONES.items() for x in pair])
    sign = F.when(F.startswith(zone, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    minutes = sign * (
        F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    )
    offset = F.when(zone.rlike(r"^[+-]\d{4}$"), minutes).otherwise(F.try_element_at(table, F.upper(zone)) * 60)
    return F.timestamp_seconds(F.unix_timestamp(local) - F.coalesce(offset, F.lit(0)) * 60)


def combine_date_time(date: Column | str, time: Column | str) -> Column:
    """UTC timestamp of an ISO date and an optional ISO time; no time means midnight."""
    return F.try_to_timestamp(F.concat(tx.col(date), F.lit("T"), F.coalesce(tx.blank_to_null(time), F.lit("00:00:00Z"))))


def display_time(value: Column | str, zone: str = vocab.DISPLAY_ZONE, label: str = vocab.DISPLAY_ZONE_LABEL) -> Column:
    """Local wall time of a UTC timestamp; null gives the text for an unknown time."""
    local = F.date_format(F.from_utc_timestamp(tx.col(value), zone), "yyyy-MM-dd HH:mm")
    return F.when(tx.col(value).isNull(), F.lit(vocab.UNKNOWN_TIME)).otherwise(F.concat(local, F.lit(f" {label}")))
