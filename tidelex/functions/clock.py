"""Forecast origins: a local wall-clock time on a session date, as an instant.

All arithmetic is on integers and zone conversions, so it does not depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The exchange zone and the two origins.
ZONE = "Europe/Paris"
DAILY_ORIGIN = "17:30:00"
OVERNIGHT_ORIGIN = "08:59:59"

_DAY = 86_400_000_000


def origin_micros(origin: str) -> int:
    hours, minutes, seconds = (int(part) for part in origin.split(":"))
    return ((hours * 60 + minutes) * 60 + seconds) * 1_000_000


def origin_instant(day: Column, origin: str = DAILY_ORIGIN, zone: str = ZONE) -> Column:
    """The instant at which local time `origin` is reached on `day`."""
    wall = F.unix_date(day).cast("long") * _DAY + origin_micros(origin)
    return F.to_utc_timestamp(F.timestamp_micros(wall), zone)


def next_origin_day(instant: Column, origin: str = DAILY_ORIGIN, zone: str = ZONE) -> Column:
    """The first calendar day whose origin lies strictly after `instant`."""
    wall = F.unix_micros(F.from_utc_timestamp(instant, zone)) + (_DAY - origin_micros(origin))
    return F.date_from_unix_date(((wall - F.pmod(wall, F.lit(_DAY))) / _DAY).cast("int"))


def is_eligible(published: Column, origin: Column) -> Column:
    """Strictly before the origin; an equal stamp belongs to the next window."""
    return published < origin


def sessions_seeing(published: Column, lookback_days: int = 1, origin: str = DAILY_ORIGIN,
                    zone: str = ZONE) -> Column:
    """Every calendar day d with origin(d) - lookback * 24 h <= published < origin(d).

    The lookback is absolute time while origins follow the local clock, so a 23-hour day lets a
    document into one session more and a 25-hour day into one less. The array therefore starts at
    the next origin and tests each day exactly.
    """
    first = next_origin_day(published, origin, zone)
    span = F.expr(f"INTERVAL '{int(lookback_days) * 24}' HOUR")
    return F.filter(
        F.sequence(first, F.date_add(first, lookback_days)),
        lambda day: (published >= origin_instant(day, origin, zone) - span)
        & is_eligible(published, origin_instant(day, origin, zone)),
    )


def iso_instant(instant: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only when there are any (needs a UTC session)."""
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(instant), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(whole, fraction, F.lit("+00:00"))
