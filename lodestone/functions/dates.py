"""Time functions as column expressions; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def before(as_of: str, **ago: int) -> Column:
    parts = {k: F.lit(v) for k, v in ago.items()}
    return moment(as_of) - F.make_dt_interval(**parts)


def within(ts: Column, as_of: str, **ago: int) -> Column:
    """After as_of less the interval, and not after as_of."""
    return (ts > before(as_of, **ago)) & (ts <= moment(as_of))


def local_midnight(ts: Column, zone: str) -> Column:
    """The UTC moment of the last midnight in a zone."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def next_reset(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)) + F.expr("INTERVAL 1 DAY"), zone)


def age_years(birth: Column, on: Column) -> Column:
    """Completed years."""
    early = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(on) - F.year(birth) - early.cast("int")


def life_stage(age: Column) -> Column:
    return F.when(age < 14, "child").when(age < 25, "young person").when(age < 60, "adult").otherwise("elder")


def kept_until(expires_at: Column, revoked_at: Column) -> Column:
    return F.least(expires_at, F.coalesce(revoked_at, expires_at))


def session_alive(now: Column, last_seen: Column, expires_at: Column, revoked_at: Column, idle_minutes: int) -> Column:
    return revoked_at.isNull() & (expires_at > now) & (last_seen + F.make_dt_interval(mins=F.lit(idle_minutes)) > now)


def utc_of(local: Column, zone: Column) -> Column:
    """UTC of a local clock time, in an IANA zone or a fixed offset such as +05:30."""
    return F.to_utc_timestamp(local, F.regexp_replace(zone, r"^UTC\s*(?=[+-])", ""))
