"""Event times, zones and dates; all timestamps are without zone and mean UTC unless said."""

from __future__ import annotations

#: an autumn clock change repeats one hour, in one zone (Lord Howe) half an hour
_OVERLAPS = ("1 hour", "30 minutes")


def wall_clock(date_text: str, time_text: str, date_format: str) -> str:
    """Timestamp from a date text and an ``HH:mm:ss`` text."""
    return f"to_timestamp_ntz({date_text} || ' ' || {time_text}, '{date_format} HH:mm:ss')"


def to_utc(local: str, zone: str, repeated_hour: str = "later") -> str:
    """UTC time of a local time; ``zone`` is a column or a quoted zone name.

    A local time inside the hour that autumn repeats has two UTC times; ``repeated_hour``
    picks ``later`` or ``earlier``.
    """
    if repeated_hour not in ("later", "earlier"):
        raise ValueError(f"repeated_hour must be 'later' or 'earlier', not {repeated_hour!r}")
    utc = f"convert_timezone({zone}, 'UTC', {local})"
    if repeated_hour == "earlier":
        return utc
    branches = " ".join(
        f"when convert_timezone('UTC', {zone}, {utc} + interval {gap}) = {local} then {utc} + interval {gap}"
        for gap in _OVERLAPS
    )
    return f"case {branches} else {utc} end"


def event_time(captured: str, created: str) -> str:
    return f"coalesce({captured}, {created})"


def day_month_swapped(provider_at: str, engine_at: str) -> str:
    """True when exchanging day and month of the provider time gives the engine time.

    Then the day of one is the month of the other, both ways, and year and time of day agree. So an
    exchange that is no date is false without being tried, and a missing side is false too.
    """
    parts = [("year", "year"), ("month", "day"), ("day", "month"), ("hour", "hour"), ("minute", "minute")]
    same = [f"{one}({provider_at}) = {other}({engine_at})" for one, other in parts]
    same.append(f"extract(second from {provider_at}) = extract(second from {engine_at})")
    return f"ifnull({' and '.join(same)}, false)"


def stale(rate_date: str, event_at: str, days: int) -> str:
    return f"{rate_date} < date_sub(to_date({event_at}), {days})"


def seconds_between(start: str, end: str) -> str:
    """Seconds with fraction between two timestamps."""
    return f"timestampdiff(MICROSECOND, {start}, {end}) / 1000000D"
