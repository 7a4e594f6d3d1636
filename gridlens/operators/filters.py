"""Projections and filters of records."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.electrical import seconds_between
from gridlens.operators.sequence import INDEX, SESSION, of_session, renumber
from gridlens.spec import CORE, SLIM, reversed_channels


def core(records: DataFrame) -> DataFrame:
    """The channels that the analyses use, of those there are."""
    return records.select(SESSION, INDEX, "t_start", "t_end", *[c for c in CORE if c in records.columns])


def slim(records: DataFrame) -> DataFrame:
    """The columns of workbooks, with powers in kW, kVA and kVAR."""
    rows = records.select(SESSION, INDEX, *SLIM)
    return rows.withColumns({"P_kW": F.col("P_total_avg_W") / 1000, "S_kVA": F.col("S_total_avg_VA") / 1000, "Q_kVAR": F.col("Q_total_avg_VAR") / 1000})


def reverse_cts(records: DataFrame, phases: str | list[str] | None) -> DataFrame:
    """Turn the sign of power, power factor and energy channels of these phases and of the totals."""
    flip = [c for c in reversed_channels(phases) if c in records.columns]
    return records.withColumns({c: -F.col(c) for c in flip}) if flip else records


def _time(t: datetime | str) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def time_window(records: DataFrame, start=None, end=None) -> DataFrame:
    """Rows that start at or after ``start`` and end at or before ``end``."""
    if start is not None:
        records = records.where(F.col("t_start") >= _time(start))
    return records.where(F.col("t_end") <= _time(end)) if end is not None else records


def range_scope(records: DataFrame, start, end) -> DataFrame:
    """Rows that start within the range, both edges included."""
    return records.where((F.col("t_start") >= _time(start)) & (F.col("t_start") <= _time(end)))


def format_range(start: datetime, end: datetime) -> str:
    return f"#t={start.isoformat()}/{end.isoformat()}"


def parse_range(text: str) -> tuple[datetime, datetime] | None:
    """``#t=ISO/ISO``; None if it is malformed or ends before it starts."""
    found = re.fullmatch(r"#?t=([^/]+)/([^/]+)", text or "")
    try:
        a, b = (datetime.fromisoformat(x.replace("Z", "+00:00")) for x in found.groups())
    except (AttributeError, ValueError):
        return None
    a, b = (t if t.tzinfo else t.replace(tzinfo=UTC) for t in (a, b))
    return (a, b) if b > a else None


def index_range(records: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows ``lo`` to ``hi``, the last not included."""
    return records.where((F.col(INDEX) >= lo) & (F.col(INDEX) < hi))


def gather(records: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows whose (session_id, record_index) are listed."""
    return records.join(indices.select(SESSION, INDEX).distinct(), [SESSION, INDEX], "left_semi")


def stride(records: DataFrame, every: int) -> DataFrame:
    return records.where(F.col(INDEX) % every == 0)


def stride_for(rows: int, every: int, most: int | None) -> int:
    """The stride that keeps an export within ``most`` rows."""
    return max(every, -(-rows // most)) if most and rows // every > most else every


def stride_by_place(rows: DataFrame, every: int) -> DataFrame:
    """Every so many-th row by its place among the rows there are, not by its number."""
    return renumber(rows, into="_row").where(F.col("_row") % every == 0).drop("_row")


def shift_clock(records: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Move a session's clock so that its first row starts at ``start``, or its last ends at ``end``."""
    if (start is None) == (end is None):
        raise ValueError("give the start or the end")
    anchor = F.min_by("t_start", INDEX) if start is not None else F.max_by("t_end", INDEX)
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    moved = records.join(records.groupBy(SESSION).agg((micros(_time(start if start is not None else end)) - micros(anchor)).alias("_by")), SESSION)
    return moved.withColumns({c: F.timestamp_add("MICROSECOND", F.col("_by"), F.col(c)) for c in ("t_start", "t_end")}).drop("_by")


def relative_time(records: DataFrame) -> DataFrame:
    """``rel_s``: seconds since the session's first row."""
    first = records.groupBy(SESSION).agg(F.min("t_start").alias("_t0"))
    return records.join(first, SESSION).withColumn("rel_s", seconds_between(F.col("_t0"), F.col("t_start"))).drop("_t0")


def decimate(records: DataFrame, channel: str, target: int = 4000) -> DataFrame:
    """At most ``target`` rows that keep a curve's shape: the first lowest and the first highest row of each of target/2 equal buckets."""
    if target < 2:
        return records
    rows = of_session(records, _n=(F.count("*"), F.sum))
    half = max(1, target // 2)
    # floor(b n / B) <= i < floor((b+1) n / B)  <=>  b = ceil((i + 1) B / n) - 1
    bucket = F.ceil((F.col(INDEX) + 1) * half / F.col("_n")) - 1
    v = F.col(channel).cast("double")
    v = F.when(~F.isnan(v), v)
    got = rows.where(F.col("_n") > target).groupBy(SESSION, bucket.alias("_b")).agg(
        F.min(F.when(v.isNotNull(), F.struct(v, F.col(INDEX).alias("i"))))["i"].alias("low"), (-F.max(F.when(v.isNotNull(), F.struct(v, (-F.col(INDEX)).alias("i"))))["i"]).alias("high"), F.min(INDEX).alias("first")
    )
    chosen = got.select(SESSION, F.explode(F.array_distinct(F.array(F.coalesce("low", "first"), F.coalesce("high", "first")))).alias(INDEX))
    thin = rows.where(F.col("_n") > target).join(chosen, [SESSION, INDEX], "left_semi")
    return thin.unionByName(rows.where(F.col("_n") <= target)).drop("_n")
