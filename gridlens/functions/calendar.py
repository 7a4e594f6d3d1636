"""Column expressions on times. Times are UTC; a report zone shifts only what is asked for in it."""

from __future__ import annotations

from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.rules import Period, ShiftSet, Tariff

UNASSIGNED = "unassigned"


def local(t: Column, tz: str | None = None) -> Column:
    """The wall clock of ``tz`` (UTC if none) as TIMESTAMP_NTZ."""
    t = t.cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), t) if tz else t


def utc(t: Column, tz: str | None = None) -> Column:
    """The instant, as TIMESTAMP_NTZ in UTC, of a wall clock of ``tz``: what ``local`` took, but for the hour that a clock set back shows twice."""
    t = t.cast("timestamp_ntz")
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), t) if tz else t


def known_zone(tz: str | None) -> str | None:
    """A zone's name, None for UTC; an unknown one raises ValueError."""
    if not tz or tz.upper() == "UTC":
        return None
    try:
        return ZoneInfo(tz).key
    except (ZoneInfoNotFoundError, ValueError, OSError) as no:
        raise ValueError(f"no such time zone: {tz}") from no


def both_clocks(t: Column, tz: str | None = None) -> Column:
    """A time as text: in UTC, or by the wall clock of ``tz`` with the UTC time in brackets."""
    text = lambda c, end: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), end)
    plain = text(t.cast("timestamp_ntz"), F.lit("+00:00"))
    if not tz:
        return plain
    here = local(t, tz)
    minutes = F.timestamp_diff("MINUTE", t.cast("timestamp_ntz"), here)
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int")))
    return F.concat(text(here, offset), F.lit(" ("), plain, F.lit(")"))


def minute_of_day(t: Column, tz: str | None = None) -> Column:
    here = local(t, tz)
    return F.hour(here) * 60 + F.minute(here)


def midnight(t: Column) -> Column:
    return F.to_date(t.cast("timestamp_ntz")).cast("timestamp_ntz")


def plus_seconds(t: Column, n: Column | int) -> Column:
    return F.timestamp_add("SECOND", n if isinstance(n, Column) else F.lit(n), t)


def bucket_start(t: Column, period: Period, first: Column | None = None) -> Column:
    """Start of the bucket. Durations are cut at midnight; weeks count from the midnight of ``first``, the session's start."""
    t = t.cast("timestamp_ntz")
    day = midnight(t)
    if period.kind == "day":
        return day
    if period.kind == "week":
        zero = midnight(first)
        return plus_seconds(zero, F.floor(F.datediff(day, zero) / 7).cast("int") * 604_800)
    into = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return plus_seconds(day, F.floor(into / period.seconds).cast("int") * period.seconds)


def bucket_label(start: Column, period: Period) -> Column:
    if period.kind in ("day", "week"):
        return F.date_format(start, "yyyy-MM-dd")
    if period.kind == "hour":
        return F.date_format(start, "yyyy-MM-dd'T'HH")
    whole = period.seconds % 3600 == 0
    end = plus_seconds(start, period.seconds)
    return F.concat(F.date_format(start, "yyyy-MM-dd'T'HH" if whole else "yyyy-MM-dd'T'HHmm"), F.lit("-"), F.date_format(end, "HH" if whole else "HHmm"))


def with_bucket(rows: DataFrame, period: Period, time: str = "t_start", first: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``bucket_start``; weeks take each session's first start from ``first`` (session_id, t_first)."""
    if period.kind != "week":
        return rows.withColumn("bucket_start", bucket_start(F.col(time), period))
    first = first if first is not None else rows.groupBy("session_id").agg(F.min(time).alias("t_first"))
    return rows.join(first, "session_id").withColumn("bucket_start", bucket_start(F.col(time), period, F.col("t_first"))).drop("t_first")


def shift_name(t: Column, shifts: ShiftSet, tz: str | None = None) -> Column:
    """The first shift whose window holds the local minute, else ``unassigned``."""
    minute, out = minute_of_day(t, tz), F.lit(UNASSIGNED)
    for s in reversed(shifts.shifts):
        holds = (minute >= s.start) | (minute < s.end) if s.wraps else (minute >= s.start) & (minute < s.end)
        out = F.when(holds, s.name).otherwise(out)
    return out


def is_peak(t: Column, tariff: Tariff) -> Column:
    hours = tariff.peak_list()
    return F.hour(t).isin(hours) if hours else F.lit(False)
