"""Structured Streaming over records as they arrive: bucket roll-ups with a watermark, and events as they end.

What a whole session decides in batch (nominal voltage, limits of current, size of a load step) is an input here, since a stream can't
look ahead. Rows later than the watermark are left out, as Structured Streaming does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.electrical import above, finite, not_outage, number, phases
from gridlens.operators.events import masks
from gridlens.rules import EventRules


def bucket_rollup(records: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per session and clock-aligned bucket: records, voltage range, peak power, energy; final once the watermark has passed."""
    p = number("P_total_avg_W")
    v = [F.when(finite(x) & above(x, 50.0), x) for x in phases("V_LN_{}_avg_V")]
    got = records.withWatermark("t_start", late).groupBy("session_id", F.window("t_start", every)).agg(
        F.count("*").alias("records"), F.min(F.array_min(F.array(*v))).alias("V_min_V"), F.max(F.array_max(F.array(*v))).alias("V_max_V"), (F.max(p) / 1000).alias("peak_kW"), (F.sum(p) / 3.6e6).alias("kWh"), F.count_if(~not_outage()).alias("outage_records")
    )
    return got.select("session_id", F.col("window.start").alias("bucket_start"), F.col("window.end").alias("bucket_end"), *got.columns[2:])


def run_events(records: DataFrame, nominal_v: float, limits: dict[str, float] | None = None, gap: str = "2 seconds", late: str = "10 minutes", rules: EventRules | None = None) -> DataFrame:
    """Events of the run-based kinds as session windows of their rows: a run ends after ``gap`` without one."""
    rules = rules or EventRules()
    limits = limits or {}
    rows = records.withColumns({"on": not_outage(rules.outage_v_threshold), "nominal_v": F.lit(float(nominal_v)), **{f"limit_{p}": F.lit(limits.get(p)).cast("double") for p in "abc"}})
    hits = F.array_compact(F.array(*[F.when(m, F.struct(F.lit(k).alias("kind"), F.lit(ph).alias("phase"))) for (k, ph), m in masks(rules).items()]))
    low, high = phases("V_LN_{}_min_V"), phases("V_LN_{}_max_V")
    rows = rows.withWatermark("t_start", late).withColumn("h", F.explode(hits))
    got = rows.groupBy("session_id", F.col("h.kind").alias("kind"), F.col("h.phase").alias("phase"), F.session_window("t_start", gap).alias("w")).agg(
        F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count("*").alias("rows"), F.min(F.least(*low)).alias("lowest_v"), F.max(F.greatest(*high)).alias("highest_v")
    )
    return got.select("session_id", "kind", "phase", "t_start", "t_end", "rows", "lowest_v", "highest_v")
