"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame of plain columns.

Times come out as microseconds since 1970, arrays as text joined by ``/``, doubles rounded to 6 places, so that two engines'
results compare by value.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.calendar import shift_name
from gridlens.functions.electrical import mean_phase_current, not_outage
from gridlens.operators import correlate, events, filters, grouping, rolling, sketch, stats, stitch
from gridlens.plans import compare, findings
from gridlens.plans.bridge import by_days, one_session, scratch, session_files
from gridlens.sinks import files, multi
from gridlens.sources import tables, trend
from gridlens.rules import CompareRules, EventRules, FindingRules, Period, ShiftSet, Tariff

NOMINAL = 277.0
WINDOW = ("2024-01-05 00:00:00", "2024-01-12 00:00:00")
THREE = ShiftSet.parse("A=06:00-14:00,B=14:00-22:00,C=22:00-06:00")
PARTIAL = ShiftSet.parse("early=05:00-12:30,late=12:00-20:00")
CUSTOM = EventRules(dip_pct_of_nominal=0.95, swell_pct_of_nominal=1.05, freq_excursion_hz=0.1, imbalance_pct_threshold=3.0, high_current_sigma=1.5, power_step_pct_of_mean=1.0, min_duration_secs=2, gap_tolerance_secs=3)
TARIFF = Tariff("EUR", 0.31, 0.19, ((7, 11), (17, 21), (23, 1)))
FEW = ["session_id", "record_index", "t_start"]


def flat(df: DataFrame) -> DataFrame:
    """Plain, rounded columns."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "/")
        out.append(c.alias(f.name))
    return df.select(*out)


def _events(records: DataFrame, rules: EventRules | None = None, kinds=events.KINDS) -> DataFrame:
    return events.detect_events(records, None, rules, kinds)


def _one(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf: flat(f(one_session(spark, sf)))


def _days(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf: flat(f(by_days(spark, sf)))


def _kind(kind: str):
    return _one(lambda r: _events(r, kinds=(kind,)))


def _nominal(r: DataFrame) -> DataFrame:
    return events.nominal_voltage(r, NOMINAL)


def _kept(records: Callable[[SparkSession, str], DataFrame], f: Callable[[DataFrame, DataFrame], DataFrame], rules: EventRules | None = None):
    """A query that reads the events more than once: they are cached until its result is gone."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = records(spark, sf)
        found = _events(rows, rules).persist()
        out = flat(f(rows, found))
        weakref.finalize(out, found.unpersist).atexit = False
        return out

    return run


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    """A mark half an hour after each row of the table."""
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return flat(correlate.nearest_events(rows.select(F.timestamp_add("MINUTE", F.lit(30), "ts").alias("time"), F.concat(F.lit("m"), "event_id").alias("label")), _events(one_session(spark, sf)).drop("session_id")))


def _finding(rule, rules: FindingRules | None = None):
    return _one(lambda r: rule(r, _events(r), rules or FindingRules()).drop("headline"))


def _compare(f):
    return _kept(by_days, lambda r, e: f(compare.session_facts(r), r, e))


CHANNELS_READ = ["V_LN_a_avg_V", "freq_avg_Hz", "P_total_avg_W"]


def _read(rows: DataFrame) -> DataFrame:
    """What a source gave: names, places, times and three channels; NaN as -1."""
    return flat(rows.select("session_id", "record_index", "t_start", "t_end", *[F.nanvl(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in CHANNELS_READ]))


def _source(kind: str, read: Callable[[SparkSession, str], DataFrame]):
    return lambda spark, sf: read(spark, session_files(spark, sf, kind))


def _csv_source(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    files.write_csv(one_session(spark, sf).drop("session_id").withColumn("session_id", F.lit("x")), path)
    return _read(tables.read_csv_session(spark, path, "x"))


def _marks_source(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.when(F.col("event_type") == "click", "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("time"), F.concat(F.lit("m"), "event_id").alias("label"))
    rows.write.option("header", True).csv(path)
    return flat(tables.read_marks(spark, path))


def _exported(spark: SparkSession, sf: str, every: int, limit: int | None = None) -> DataFrame:
    path = scratch(spark)
    files.write_csv(one_session(spark, sf), path, every, limit)
    return spark.read.option("header", True).csv(path).select(F.col("record_index").cast("long").alias("record_index"), F.substring("timestamp_utc", 1, 26).alias("timestamp_utc"), F.round(F.col("I_a_max_A").cast("double"), 6).alias("I_a_max_A"))


def _exported_buckets(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = scratch(spark), one_session(spark, sf)
    found = _events(rows)
    files.write_buckets(rows, found, _nominal(rows), Period.parse("6h"), path)
    records = spark.read.option("header", True).csv(f"{path}/records").groupBy("bucket").agg(F.count("*").alias("records"), F.min(F.col("record_index").cast("long")).alias("first"))
    events_ = spark.read.json(f"{path}/events").groupBy("bucket").agg(F.count("*").alias("events"), F.count_if("spans_bucket_boundary").alias("spanning"))
    return records.join(events_, "bucket", "left").na.fill(0)


def _events_json(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = scratch(spark), one_session(spark, sf)
    files.write_json(files.events_payload(_events(rows), _nominal(rows)), path)
    got = files.read_json(spark, path, "id int, kind string, t_start timestamp, severity double, affected_phases array<string>, itic struct<residual_pct: double, duration_secs: double, itic_class: string>")
    return flat(got.select("id", "kind", "t_start", "severity", "affected_phases", "itic.residual_pct", "itic.itic_class"))


def _rolled_up(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of days and of whole sessions, from sketches by hour that were stored."""
    path = scratch(spark)
    rows = by_days(spark, sf).withColumns({"day": F.to_date("t_start").cast("string"), "hour": F.hour("t_start")})
    stats.session_sketches(rows, ["session_id", "day", "hour"]).write.parquet(path)
    whole = sketch.merged(spark.read.parquet(path), ["session_id", "day", "name"], ["session_id", "name"])
    return flat(sketch.finished(whole, p5=0.05, median=0.5, p95=0.95))


def _exported_at_once(spark: SparkSession, sf: str) -> DataFrame:
    """What each of the sinks of one pass holds, by sink."""
    path, rows = scratch(spark), one_session(spark, sf)
    size = spark.read.parquet(f"{sf}/events.parquet").count()
    counts = multi.export_all(rows, path, most=5000, estimate=size)
    text = lambda sink: spark.read.option("header", True).csv(f"{path}/{sink}").select(F.lit(sink).alias("sink"), F.col("record_index").cast("long").alias("record_index"), F.col("V_LN_a_avg_V").cast("double").alias("v"))
    held = text(multi.FULL).union(text(multi.SAMPLE)).union(spark.read.parquet(f"{path}/{multi.STORE}").select(F.lit(multi.STORE), "record_index", "V_LN_a_avg_V"))
    return flat(held.groupBy("sink").agg(F.count("*").alias("n"), F.max("record_index").alias("last"), F.sum("v").alias("volts")).withColumns({"records": F.lit(counts["records"]), "nonfinite": F.lit(counts["nonfinite"])}))


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    found = _events(one_session(spark, sf))
    notes = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'").select(F.col("event_id").cast("int").alias("id"), F.concat(F.lit("n"), "event_id").alias("note"))
    return flat(files.with_notes(found, notes).select("id", "kind", "note"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict = {
        # sources and sinks
        "source_strict": _source("healthy", lambda spark, d: _read(trend.read_trend(spark, d, CHANNELS_READ))),
        "source_tolerant": _source("damaged", lambda spark, d: _read(trend.read_trend(spark, d, CHANNELS_READ, tolerant=True, split=100_000))),
        "source_split": _source("healthy", lambda spark, d: _read(trend.read_trend(spark, f"{d}/S0/trend.bin", CHANNELS_READ, split=200_000))),
        "source_bundle": _source("bundle", lambda spark, d: _read(tables.read_bundles(spark, d, CHANNELS_READ))),
        "source_csv": _csv_source,
        "source_scan_stats": _source("damaged", lambda spark, d: trend.scan_stats(spark, d, split=100_000)),
        "source_first_last": _source("healthy", lambda spark, d: flat(trend.first_last_times(spark, d))),
        "source_file_facts": _source("damaged", lambda spark, d: trend.file_facts(spark, d).select(F.element_at(F.split("path", "/"), -2).alias("session_id"), "records", "has_tail")),
        "source_configs": _source("healthy", tables.read_configs),
        "source_bundle_configs": _source("bundle", tables.bundle_configs),
        "source_open_session": _source("healthy", lambda spark, d: _read(tables.open_session(spark, f"{d}/S1", CHANNELS_READ)[0])),
        "source_marks": _marks_source,
        "export_every_seventh": lambda spark, sf: _exported(spark, sf, 7, 500),
        "export_minutes": lambda spark, sf: _exported(spark, sf, 60),
        "export_buckets": _exported_buckets,
        "export_events_json": _events_json,
        "export_at_once": _exported_at_once,
        "events_with_notes": _notes,
        # projections and filters
        "non_outage_mask": _one(lambda r: r.select(*FEW, not_outage().alias("on"))),
        "mean_phase_current": _one(lambda r: r.select(*FEW, mean_phase_current().alias("i_mean_a"))),
        "core_columns": _one(lambda r: filters.core(r).agg(F.count("*").alias("n"), F.sum("V_LN_a_avg_V").alias("va"), F.sum("I_THD_pct_c_avg").alias("thd"))),
        "slim_columns": _one(lambda r: filters.slim(r).select("record_index", "S_kVA", "Q_kVAR", "V_THD_pct_a_avg")),
        "time_window_filter": _one(lambda r: filters.time_window(r, *WINDOW).select(*FEW)),
        "range_scope": _one(lambda r: filters.range_scope(r, *WINDOW).select(*FEW)),
        "index_range": _one(lambda r: filters.index_range(r, 100, 300).select(*FEW)),
        "index_gather": _one(lambda r: filters.gather(r, r.where("record_index % 77 in (3, 5)")).select(*FEW)),
        "stride_sample": _one(lambda r: filters.stride(r, 60).select(*FEW)),
        "stride_by_place": _one(lambda r: filters.stride_by_place(r.where(not_outage()), 50).select("record_index")),
        "reverse_cts_all": _one(lambda r: filters.reverse_cts(r, "all").select(*FEW, "Q_total_avg_VAR", "PF_total_avg", "DPF_total_avg", "S_total_avg_VA")),
        "reverse_cts_phase_a": _one(lambda r: filters.reverse_cts(r, "a").select(*FEW, "Q_total_avg_VAR", "PF_total_avg", "I_a_avg_A")),
        "anchor_shift_start": _one(lambda r: filters.shift_clock(r, start="2025-03-01 12:00:00").select("record_index", "t_start", "t_end")),
        "anchor_shift_end": _days(lambda r: filters.shift_clock(r, end="2025-03-01 12:00:00").select("session_id", "record_index", "t_start", "t_end")),
        "relative_time": _days(lambda r: filters.relative_time(r).select("session_id", "record_index", "rel_s")),
        "decimate_minmax": _one(lambda r: filters.decimate(r, "I_a_max_A", 400).select("record_index", "I_a_max_A", "t_start")),
        # events
        "nominal_voltage": _days(events.nominal_voltage),
        "event_baselines": _days(lambda r: events.baselines(r, EventRules())),
        "events_outage": _kind("outage"),
        "events_dip": _kind("dip"),
        "events_swell": _kind("swell"),
        "events_high_current": _kind("high_current"),
        "events_freq_excursion": _kind("freq_excursion"),
        "events_imbalance": _kind("imbalance_spike"),
        "events_power_step": _kind("power_step"),
        "detect_events": _one(_events),
        "detect_events_sessions": _days(_events),
        "events_custom_rules": _one(lambda r: _events(r, CUSTOM)),
        "event_counts_by_kind": _days(lambda r: events.count_by_kind(_events(r))),
        "event_id_filter": _one(lambda r: events.filter_events(_events(r), "0-4,9,12")),
        "event_zoom_slice": _one(lambda r: events.event_window(_events(r), r, 5, 10).select("event_id", "kind", "record_index")),
        # statistics
        "session_stats": _days(stats.session_stats),
        "stats_rollup": _rolled_up,
        "threshold_seconds": _days(lambda r: stats.threshold_seconds(r, 275.0, 600.0)),
        "ct_reversal": _days(stats.ct_reversal),
        "ct_reversal_flipped": _one(lambda r: stats.ct_reversal(filters.reverse_cts(r, "all"))),
        "load_state_rows": _days(stats.load_state_rows),
        "session_energy": _days(stats.session_energy),
        "session_totals": _days(stats.session_totals),
        "compare_summary": _days(stats.compare_summary),
        "session_cards": _days(lambda r: stats.session_cards(r, _events(r))),
        "compare_table": _days(lambda r: stats.compare_table(r, [0, 1, 2, 3, 4])),
        "tariff_cost": _days(lambda r: stats.tariff_cost(r, TARIFF)),
        "first_last": _days(stats.first_last),
        "ieee519": _days(stats.harmonics),
        "sarfi": _days(lambda r: stats.sarfi(_events(r), _nominal(r))),
        "event_itic": _one(lambda r: stats.event_ride_through(_events(r), _nominal(r)).drop("affected_phases")),
        # time
        "bucket_hour": _one(lambda r: grouping.bucket_summary(r, _events(r), Period.parse("hour"))),
        "bucket_day": _one(lambda r: grouping.bucket_summary(r, _events(r), Period.parse("day"))),
        "bucket_week": _days(lambda r: grouping.bucket_summary(r, _events(r), Period.parse("week"))),
        "bucket_6h": _one(lambda r: grouping.bucket_summary(r, _events(r), Period.parse("6h"))),
        "bucket_ranges_90m": _one(lambda r: grouping.bucket_ranges(r, Period.parse("90m"))),
        "events_in_bucket": _one(lambda r: grouping.events_in_buckets(_events(r), Period.parse("6h")).select("id", "kind", "bucket_start", "spans_bucket_boundary")),
        "tod_profile": _one(lambda r: grouping.time_of_day(r, (360, 1200), 15).withColumn("p_avg_kW", F.nanvl("p_avg_kW", F.lit(-1.0)))),
        "tod_profile_nan": _one(lambda r: grouping.time_of_day(r, (0, 1440), 60).select("bin", "n", "n_days", "p_min_kW", "p_max_kW", F.isnan("p_avg_kW").alias("p_avg_nan"))),
        "shift_of_records": _one(lambda r: r.select("record_index", shift_name(F.col("t_start"), PARTIAL).alias("shift"))),
        "shift_comparison_utc": _one(lambda r: grouping.shift_comparison(r, _events(r), ShiftSet(), demand_minutes=1)),
        "shift_comparison_tz": _one(lambda r: grouping.shift_comparison(r, _events(r), THREE, "America/Chicago", demand_minutes=2)),
        "shift_comparison_gaps": _days(lambda r: grouping.shift_comparison(r, _events(r), PARTIAL, demand_minutes=1)),
        "shift_occurrences": _one(lambda r: grouping.shift_occurrences(r, THREE, "America/Chicago")),
        "events_in_occurrence": _one(lambda r: grouping.events_in_occurrences(_events(r), grouping.shift_occurrences(r, THREE)).select("id", "kind", "shift", "label")),
        "shift_coverage": _days(lambda r: grouping.shift_coverage(r, PARTIAL)),
        # rolling
        "demand_peak": _days(lambda r: rolling.demand_peak(r, 120)),
        "demand_series": _one(lambda r: rolling.demand_series(r, 90, 90)),
        "rolling_stdev": _one(lambda r: rolling.rolling_stdev(r, 60).select("record_index", "mean_w", F.round("stdev_w", 3).alias("stdev_w"))),
        "snapshot_candidates": _one(lambda r: rolling.snapshot_candidates(r, _events(r), 20).select("record_index", "t_start", "t_end")),
        "quiet_snapshots": _one(lambda r: rolling.pick_snapshots(r, _events(r), 3, 20, 86_400).drop("p_total_mean_w").withColumn("p_total_stdev_w", F.round("p_total_stdev_w", 3))),
        # correlation
        "marker_nearest": _marks,
        "outage_signature": _kept(one_session, lambda r, e: correlate.outage_signatures(e, 1800)),
        "steps_with_frequency": _one(lambda r: correlate.steps_with_frequency(r, _events(r)).select("id", "severity", "max_dev_hz")),
        # findings
        "phase_asymmetry": _days(findings.asymmetry),
        "pf_drift": _days(lambda r: findings.low_pf(r, FindingRules())),
        "imbalance_sustained": _one(lambda r: findings.sustained_imbalance(r, FindingRules())),
        "freq_source_stiffness": _finding(findings.freq_source_stiffness),
        "outage_frequency": _finding(findings.outage_frequency),
        "current_spike_ratio": _days(findings.current_ratios),
        "breaker_context": _finding(findings.current_spike_ratio, FindingRules(breaker_rating_a=5000.0)),
        "breaker_margin": _finding(findings.breaker_margin, FindingRules(breaker_rating_a=1200.0)),
        "findings": _kept(one_session, lambda r, e: findings.analyze(r, e, FindingRules(outage_dip_window_secs=600)).drop("headline", "recommended_actions"), EventRules(power_step_pct_of_mean=1.5)),
        # sessions
        "stitch": _days(lambda r: stitch.stitch(r).select("record_index", "source", "t_start")),
        "stitch_sources": _days(stitch.sources),
        "stitch_gaps": _days(stitch.stitch_gaps),
        "voltage_drift": _compare(lambda facts, r, e: compare.voltage_trend(facts)),
        "recurring_outages": _compare(lambda facts, r, e: compare.outage_times(e, CompareRules())),
        "pf_degradation": _compare(lambda facts, r, e: compare.pf_trend(facts)),
        "stiffness_emergence": _compare(lambda facts, r, e: compare.stiffness_halves(facts, findings.freq_source_stiffness(r, e, FindingRules()))),
        "event_trend": _compare(lambda facts, r, e: compare.event_trends(facts, e)),
        "compare_findings": _kept(by_days, lambda r, e: compare.analyze_compare(r, e, CompareRules(event_trend_min_r=0.2, voltage_drift_v_per_day=0.0001)).drop("headline")),
    }
    return q
