"""Clocks of point-in-time work: local wall clock, availability, cutoff, age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_to_utc(date: Column, clock: Column, zone: str = "America/New_York") -> Column:
    """A local date and HH:mm clock as a UTC instant; null if either does not parse."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), clock), F.lit("yyyy-MM-dd HH:mm")), zone)


def local_date(instant: Column, zone: str = "America/New_York") -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def in_local_dates(instant: Column, first: str, last: str, zone: str = "America/New_York") -> Column:
    """Whether the local date lies in an inclusive range."""
    return local_date(instant, zone).between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))


def available_at(event_time: Column, hours: int = 24) -> Column:
    """When a fact is assumed to be known."""
    return event_time + F.expr(f"INTERVAL {int(hours)} HOURS")


def cutoff(event_time: Column, lead_minutes: int = 60) -> Column:
    """The prediction time; the lead must be positive."""
    if lead_minutes <= 0:
        raise ValueError("lead_minutes must be positive")
    return event_time - F.expr(f"INTERVAL {int(lead_minutes)} MINUTES")


def parse_zoned(text: Column) -> Column:
    """An ISO instant that names its zone; null (a reject) for anything else."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def seconds_between(earlier: Column, later: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1e6)


def age_minutes(quote_time: Column, at: Column) -> Column:
    return seconds_between(quote_time, at) / 60.0


def issued_in_time(issued_at: Column, at: Column) -> Column:
    """A missing or late issue time is ineligible."""
    return F.coalesce(issued_at <= at, F.lit(False))
