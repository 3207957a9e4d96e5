"""Time and statistics functions. `us` is event time as microseconds since 1970 (UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HOUR = 3_600_000_000
_DAY = 86_400_000_000


def to_us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def from_us(c: Column) -> Column:
    return F.timestamp_micros(c)


def hour_of_day(us: Column) -> Column:
    return F.pmod(F.floor(us / _HOUR), F.lit(24)).cast("int")


def weekday(us: Column) -> Column:
    """Monday = 0. Day 0 of the epoch was a Thursday."""
    return F.pmod(F.floor(us / _DAY) + 3, F.lit(7)).cast("int")


def iso_utc(us: Column) -> Column:
    """ISO-8601 text with microseconds (left out when zero) and a +00:00 offset."""
    base = F.date_format(F.timestamp_seconds(F.floor(us / 1_000_000)), "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.pmod(us, F.lit(1_000_000))
    return F.concat(base, F.when(frac > 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0")))
                    .otherwise(""), F.lit("+00:00"))


def in_quiet_hours(us: Column, start: int, end: int, tz: str = "UTC") -> Column:
    """Local hour inside [start, end); the span may wrap midnight."""
    hour = hour_of_day(us) if tz == "UTC" else F.hour(F.convert_timezone(
        F.lit("UTC"), F.lit(tz), from_us(us).cast("timestamp_ntz")))
    if start <= end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def z_score(v: Column, mean: Column, sd: Column) -> Column:
    """Deviations above the mean; on a flat history the plain distance."""
    return F.when(sd < 1e-9, F.abs(v - mean)).otherwise((v - mean) / sd)
