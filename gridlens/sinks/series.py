"""A file per bucket, stretch of a shift, event and session: tables, events, summaries and series for plots.

Every function is one job a kind of file, whatever the number of groups; the driver never sees a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.calendar import bucket_label, with_bucket
from gridlens.functions.electrical import number, seconds_between
from gridlens.operators.events import event_window
from gridlens.operators.filters import relative_time
from gridlens.operators.grouping import bucket_summary, events_in_buckets, events_in_occurrences
from gridlens.operators.sequence import INDEX, SESSION
from gridlens.sinks.files import OCCURRENCE_ROWS, STAMPS, events_payload, export_frame
from gridlens.sinks.grouped import lines, write_files
from gridlens.rules import Period

#: (name, channel, scale) of the series for plots.
SERIES = [*((f"V_{p}", f"V_LN_{p}_avg_V", 1.0) for p in "abc"), *((f"I_{p}", f"I_{p}_avg_A", 1.0) for p in "abc"), ("P_kW", "P_total_avg_W", 1000.0), ("Q_kVAR", "Q_total_avg_VAR", 1000.0)]


def safe(c: Column) -> Column:
    """A text as part of a file's name."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("none")), r"[^\w.+-]+", "_")


def _in(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else safe(p) for p in parts])


def _json(rows: DataFrame, file: Column, seq: Column, *drop: str) -> DataFrame:
    names = [c for c in rows.columns if c not in drop]
    return rows.select(file.alias("file"), seq.cast("long").alias("seq"), F.concat(F.to_json(F.struct(*names), STAMPS), F.lit("\n")).alias("content"))


def _texts(rows: DataFrame, file: Column, **told: Column) -> DataFrame:
    """A text of ``name: value`` lines for each row."""
    body = F.concat_ws("\n", *[F.concat(F.lit(k.replace("_", " ") + ": "), v.cast("string")) for k, v in told.items()])
    return rows.select(file.alias("file"), F.lit(0).cast("long").alias("seq"), F.concat(body, F.lit("\n")).alias("content"))


def _rows(records: DataFrame, file: Column) -> DataFrame:
    """Records as CSV, a file for each value of ``file``."""
    frame = export_frame(records)
    names = frame.columns
    rows = records.withColumns({"timestamp_utc": F.date_format(F.col("t_start").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "window_end_utc": F.date_format(F.col("t_end").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")})
    return lines(rows, file, F.col(INDEX), *names, separator=",")


def _told(c: str, unit: str = "") -> Column:
    return F.concat(F.format_string("%.3f", F.col(c).cast("double")), F.lit(unit))


def write_bucket_files(records: DataFrame, events: DataFrame, nominal: DataFrame, period: Period, path: str) -> None:
    """``<session>/<bucket>/`` session.csv, events.json and summary.txt, and ``buckets_summary.csv`` of all."""
    first = records.groupBy(SESSION).agg(F.min("t_start").alias("t_first")) if period.kind == "week" else None
    of = lambda name: _in(F.col(SESSION), bucket_label(F.col("bucket_start"), period), name)
    rows = _rows(with_bucket(records, period, first=first), of("session.csv"))
    filed = _json(events_in_buckets(events_payload(events, nominal), period, first), of("events.json"), F.col("id"), "bucket_start")
    sums = bucket_summary(records, events, period)
    told = {c: F.col(c) for c in ("records", "n_outages", "n_dips", "n_swells")} | {"energy": _told("kWh", " kWh"), "peak": _told("peak_kW", " kW"), "voltage": F.concat(_told("V_min_V"), F.lit(" to "), _told("V_max_V", " V")), "worst_power_factor": _told("worst_PF")}
    table = lines(sums.orderBy(SESSION, "bucket_start"), F.lit("buckets_summary.csv"), F.unix_micros(F.col("bucket_start").cast("timestamp")), *sums.columns, separator=",")
    for part in (rows, filed, _texts(sums, of("summary.txt"), **told), table):
        write_files(part, path)


def write_occurrence_files(records: DataFrame, events: DataFrame, occurrences: DataFrame, path: str) -> None:
    """``<session>/<stretch>/`` session.csv, events.json and summary.txt for each unbroken stretch of a shift."""
    of = lambda name: _in(F.col(SESSION), F.col("label"), name)
    spans = occurrences.select(SESSION, "label", "lo", "hi")
    parts = F.explode(F.sequence(F.floor(F.col("lo") / OCCURRENCE_ROWS), F.floor((F.col("hi") - 1) / OCCURRENCE_ROWS)))
    mine = records.withColumn("_part", F.floor(F.col(INDEX) / OCCURRENCE_ROWS)).join(spans.withColumn("_part", parts), [SESSION, "_part"]).where((F.col(INDEX) >= F.col("lo")) & (F.col(INDEX) < F.col("hi"))).drop("_part", "lo", "hi")
    found = events_in_occurrences(events, occurrences)
    write_files(_rows(mine, of("session.csv")), path)
    write_files(_json(found, of("events.json"), F.col("id"), "label"), path)
    p, keys = number("P_total_avg_W"), [SESSION, "label"]
    sums = mine.groupBy(*keys).agg(F.count("*").alias("records"), F.min("t_start").alias("a"), F.max("t_end").alias("b"), F.coalesce(F.sum(p) / 3.6e6, F.lit(0.0)).alias("kWh"), F.coalesce(F.max(p) / 1000.0, F.lit(0.0)).alias("peak_kW"))
    sums = sums.join(found.groupBy(*keys).agg(F.count("*").alias("events")), keys, "left").na.fill(0, ["events"])
    told = {"from": F.col("a"), "to": F.col("b"), "duration_s": _told("secs"), "records": F.col("records"), "energy": _told("kWh", " kWh"), "peak": _told("peak_kW", " kW"), "events": F.col("events")}
    write_files(_texts(sums.withColumn("secs", seconds_between(F.col("a"), F.col("b"))), of("summary.txt"), **told), path)


def _plotted(rows: DataFrame) -> DataFrame:
    """The series for plots; what isn't finite is NaN."""
    return rows.withColumns({name: F.coalesce(number(c) / F.lit(scale), F.lit(float("nan"))) for name, c, scale in SERIES if c in rows.columns})


def write_event_series(records: DataFrame, events: DataFrame, path: str, before_s: int = 30, after_s: int = 60) -> None:
    """``<session>/event-<id>-<kind>.tsv``: the series around each event, by seconds since 1970."""
    rows = _plotted(event_window(events, records, before_s, after_s)).withColumn("epoch_s", F.unix_micros(F.col("t_start").cast("timestamp")) / F.lit(1e6))
    file = F.concat(safe(F.col(SESSION)), F.lit("/event-"), F.col("event_id"), F.lit("-"), F.col("kind"), F.lit(".tsv"))
    write_files(lines(rows, file, F.col(INDEX), "epoch_s", *[n for n, c, _ in SERIES if c in records.columns]), path)


def write_overlays(records: DataFrame, path: str) -> None:
    """``<session>.tsv``: the series of each session by seconds since its first record, to be laid over each other."""
    rows = _plotted(relative_time(records))
    write_files(lines(rows, F.concat(safe(F.col(SESSION)), F.lit(".tsv")), F.col(INDEX), "rel_s", *[n for n, c, _ in SERIES if c in records.columns]), path)
