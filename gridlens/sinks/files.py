"""Results as files: CSV with strides, JSON lists, per-bucket tables, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.calendar import bucket_label, with_bucket
from gridlens.operators.filters import stride, stride_for
from gridlens.operators.grouping import events_in_buckets, events_in_occurrences
from gridlens.operators.sequence import INDEX
from gridlens.operators.stats import event_ride_through
from gridlens.rules import Period
from gridlens.spec import CHANNELS

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Rows by which records meet the stretches they are in.
OCCURRENCE_ROWS = 1 << 14
#: JSON keeps microseconds, which Spark's own format cuts.
STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS[XXX]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def export_frame(records: DataFrame, every: int = 1, limit: int | None = None) -> DataFrame:
    """The rows and columns of a full export: number, start and end as ISO text, and the channels there are."""
    rows = stride(records, every) if every > 1 else records
    rows = rows.orderBy("session_id", INDEX).limit(limit) if limit is not None else rows
    stamp = lambda c: F.date_format(F.col(c).cast("timestamp"), ISO)
    return rows.select(*[c for c in ("session_id", "source") if c in records.columns], INDEX, stamp("t_start").alias("timestamp_utc"), stamp("t_end").alias("window_end_utc"), *[c for c in CHANNELS.values() if c in records.columns])


def write_csv(records: DataFrame, path: str, every: int = 1, limit: int | None = None, most: int | None = None) -> None:
    """Write an export; ``most`` rows at most, by a wider stride. The folder has a part per partition."""
    if most:
        every = stride_for(records.count(), every, most)
    export_frame(records, every, limit).write.mode("overwrite").option("header", True).csv(path)


def write_minutes(records: DataFrame, path: str) -> None:
    """Every sixtieth row: a sample, not an average."""
    write_csv(records, path, 60)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").options(**STAMPS).json(path)


def read_json(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**STAMPS).json(path)


def events_payload(events: DataFrame, nominal: DataFrame) -> DataFrame:
    """Events with a struct ``itic`` where it applies."""
    itic = event_ride_through(events, nominal).select("session_id", "id", F.struct("residual_pct", "duration_secs", "itic_class").alias("itic"))
    return events.join(itic, ["session_id", "id"], "left")


def write_buckets(records: DataFrame, events: DataFrame, nominal: DataFrame, period: Period, path: str) -> None:
    """Records and events by bucket, a folder for each."""
    rows = with_bucket(records, period)
    export = export_frame(rows.drop("bucket_start")).columns
    labelled = rows.withColumn("bucket", bucket_label(F.col("bucket_start"), period))
    stamp = lambda c: F.date_format(F.col(c).cast("timestamp"), ISO)
    labelled = labelled.withColumns({"timestamp_utc": stamp("t_start"), "window_end_utc": stamp("t_end")})
    labelled.select("bucket", *export).write.mode("overwrite").partitionBy("bucket").option("header", True).csv(f"{path}/records")
    first = records.groupBy("session_id").agg(F.min("t_start").alias("t_first")) if period.kind == "week" else None
    filed = events_in_buckets(events_payload(events, nominal), period, first)
    filed.withColumn("bucket", bucket_label(F.col("bucket_start"), period)).write.mode("overwrite").options(**STAMPS).partitionBy("bucket").json(f"{path}/events")


def write_text(text: str, path: str, spark) -> None:
    """One text, as a file of its own."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def with_notes(events: DataFrame, notes: DataFrame) -> DataFrame:
    """Events that have a note (``id, note``), with it."""
    return events.join(notes, "id")


def write_table(rows: DataFrame, path: str) -> None:
    """A small result both as JSON lines and as one CSV with a header; lists in cells are joined by ``/``."""
    write_json(rows, f"{path}.json")
    cells = [F.array_join(F.transform(f.name, lambda x: x.cast("string")), "/").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema]
    rows.select(*cells).coalesce(1).write.mode("overwrite").option("header", True).option("timestampFormat", ISO).csv(f"{path}.csv")


#: Decimals of the columns of the table of load states; counts and names have none.
LOAD_STATE_DECIMALS = {c: 3 if c == "PF_avg" else 2 for c in ("hours", "duty_pct", "kWh", "P_avg_kW", "P_min_kW", "P_max_kW", "I_avg_A", "S_avg_kVA", "PF_avg", "V_LN_avg_V", "V_THD_p95_pct")}


def write_load_states(rows: DataFrame, path: str) -> None:
    """Load states as JSON lines, and as one CSV with a fixed number of decimals."""
    write_json(rows, f"{path}.json")
    cells = [F.format_string(f"%.{LOAD_STATE_DECIMALS[c]}f", F.col(c)).alias(c) if c in LOAD_STATE_DECIMALS else F.col(c) for c in rows.columns]
    rows.select(*cells).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_occurrences(records: DataFrame, events: DataFrame, occurrences: DataFrame, path: str) -> None:
    """Records and events of each stretch of a shift, a folder for each label."""
    spans = occurrences.select("session_id", "shift", "label", "lo", "hi")
    days = F.explode(F.sequence(F.floor(F.col("lo") / OCCURRENCE_ROWS), F.floor((F.col("hi") - 1) / OCCURRENCE_ROWS)))
    rows = records.withColumn("_part", F.floor(F.col(INDEX) / OCCURRENCE_ROWS)).join(spans.withColumn("_part", days), ["session_id", "_part"]).where((F.col(INDEX) >= F.col("lo")) & (F.col(INDEX) < F.col("hi")))
    export = export_frame(rows.drop("_part", "lo", "hi", "shift"))
    stamp = lambda c: F.date_format(F.col(c).cast("timestamp"), ISO)
    rows = rows.withColumns({"timestamp_utc": stamp("t_start"), "window_end_utc": stamp("t_end")}).select("label", *export.columns)
    rows.write.mode("overwrite").partitionBy("label").option("header", True).csv(f"{path}/records")
    events_in_occurrences(events, occurrences).write.mode("overwrite").options(**STAMPS).partitionBy("label").json(f"{path}/events")


def sorted_events(events: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Events in the order of a column, ids within equal values; a column that isn't there raises ValueError."""
    if column not in events.columns:
        raise ValueError(f"no such column: {column}")
    return events.orderBy(F.col(column).desc() if descending else F.col(column), "id")
