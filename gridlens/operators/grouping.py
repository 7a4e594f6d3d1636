"""Roll-ups: time buckets, shifts and their occurrences, time of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.calendar import bucket_label, local, minute_of_day, plus_seconds, shift_name, with_bucket
from gridlens.functions.electrical import above, finite, mean_phase_current, number, phases, seconds_between
from gridlens.operators.rolling import demand_peak
from gridlens.operators.sequence import INDEX, SESSION, islands, renumber
from gridlens.operators.stats import BINS, _or0, _pooled, long_values, quantiles
from gridlens.rules import Period, ShiftSet


def _count(kind: str, name: str) -> Column:
    return F.count_if(F.col("kind") == kind).alias(name)


def worst_pf() -> Column:
    """The power factor of least size below 1, the first of equal ones, among rows with all phases finite and over 50 V; 1 if none."""
    on = above(phases("V_LN_{}_avg_V")[0], 50.0)
    for v in phases("V_LN_{}_avg_V"):
        on = on & finite(v) & above(v, 50.0)
    pf = number("PF_total_avg")
    best = F.min(F.when(on & (F.abs(pf) < 1.0), F.struct(F.abs(pf).alias("size"), F.col(INDEX).alias("i"), pf.alias("pf"))))
    return F.coalesce(best["pf"], F.lit(1.0))


def bucket_summary(records: DataFrame, events: DataFrame, period: Period) -> DataFrame:
    """One row per session and bucket that has records; events count in the bucket of their start."""
    first = records.groupBy(SESSION).agg(F.min("t_start").alias("t_first")) if period.kind == "week" else None
    rows, p = with_bucket(records, period, first=first), number("P_total_avg_W")
    v = phases("V_LN_{}_avg_V")
    sound = [F.when(finite(x) & above(x, 50.0), x) for x in v]
    v_sum, v_n = _pooled("V_LN_{}_avg_V", 50.0)
    got = rows.groupBy(SESSION, "bucket_start").agg(
        F.count("*").alias("records"), _or0(F.min(F.array_min(F.array(*sound)))).alias("V_min_V"), _or0(F.try_divide(v_sum, v_n)).alias("V_avg_V"), _or0(F.max(F.array_max(F.array(*[F.when(finite(x), x) for x in v])))).alias("V_max_V"),
        F.greatest(F.lit(0.0), F.max(F.array_max(F.array(*[number(f"I_{x}_avg_A") for x in "abc"])))).alias("I_max_A"), _or0(F.avg(p) / 1000.0 * (F.count(p) / 3600.0)).alias("kWh"), worst_pf().alias("worst_PF"), _or0(F.max(p) / 1000.0).alias("peak_kW"),
    )
    kinds = with_bucket(events, period, first=first).groupBy(SESSION, "bucket_start").agg(_count("outage", "n_outages"), _count("dip", "n_dips"), _count("swell", "n_swells"))
    out = got.join(kinds, [SESSION, "bucket_start"], "left").na.fill(0, ["n_outages", "n_dips", "n_swells"])
    return out.select(SESSION, "bucket_start", bucket_label(F.col("bucket_start"), period).alias("bucket"), *out.columns[2:])


def events_in_buckets(events: DataFrame, period: Period, first: DataFrame | None = None) -> DataFrame:
    """Events with ``bucket_start`` and whether they last beyond the bucket."""
    rows = with_bucket(events, period, first=first)
    return rows.withColumn("spans_bucket_boundary", F.col("t_end") >= plus_seconds(F.col("bucket_start"), period.seconds))


def bucket_ranges(records: DataFrame, period: Period) -> DataFrame:
    """``bucket_start, lo, hi`` (the last not included) per session."""
    return with_bucket(records, period).groupBy(SESSION, "bucket_start").agg(F.min(INDEX).alias("lo"), (F.max(INDEX) + 1).alias("hi"))


def with_shift(rows: DataFrame, shifts: ShiftSet, tz: str | None = None) -> DataFrame:
    return rows.withColumn("shift", shift_name(F.col("t_start"), shifts, tz))


def shift_comparison(records: DataFrame, events: DataFrame, shifts: ShiftSet, tz: str | None = None, demand_minutes: int = 15, active_a: float = 50.0) -> DataFrame:
    """One row per session and shift (and one for what none holds, if there is any). Demand runs over a shift's rows as they follow one another."""
    rows = with_shift(records, shifts, tz)
    p, pf, busy = number("P_total_avg_W"), number("PF_total_avg"), mean_phase_current() >= active_a
    v_sum, v_n = _pooled("V_LN_{}_avg_V", 50.0)
    keys = [SESSION, "shift"]
    got = rows.groupBy(*keys).agg(
        F.count("*").alias("records"), F.count(p).alias("_n"), _or0(F.avg(p)).alias("P_total_avg_W"), _or0(F.min(p)).alias("P_total_min_W"), _or0(F.max(p)).alias("P_total_max_W"),
        _or0(F.avg(pf)).alias("PF_avg"), _or0(F.try_divide(v_sum, v_n)).alias("V_LN_avg_V"),
        F.count_if(busy).alias("active_records"), F.count(F.when(busy, p)).alias("_an"), _or0(F.avg(F.when(busy, p))).alias("_ap"), _or0(F.avg(F.when(busy, pf))).alias("active_PF_avg"),
    )
    pooled = [(f"V_LN_{x}_avg_V", "volts", 0.0, 400.0, BINS) for x in "abc"] + [(f"V_THD_pct_{x}_avg", "thd", 0.0, 50.0, BINS) for x in "abc"]
    values = long_values(rows, keys, pooled).where(finite(F.col("v")) & ((F.col("name") == "thd") | (F.col("v") > 50.0)))
    of = lambda name, column: F.max(F.when(F.col("name") == name, F.col(column)))
    shares = quantiles(values, [*keys, "name"], p5=0.05, p95=0.95).groupBy(*keys).agg(of("volts", "p5").alias("V_LN_p5_V"), of("volts", "p95").alias("V_LN_p95_V"), of("thd", "p95").alias("V_THD_p95_pct"))
    tied = renumber(rows.select(*keys, INDEX, "t_start", "t_end", "P_total_avg_W"), keys)
    both = F.struct(*keys)
    peak = demand_peak(tied.withColumn(SESSION, both), demand_minutes * 60).select(F.col(SESSION)[SESSION].alias("_s"), F.col(SESSION)["shift"].alias("shift"), F.col("peak_demand_kw").alias("peak_demand_kW")).withColumnRenamed("_s", SESSION)
    kinds = with_shift(events, shifts, tz).groupBy(*keys).agg(
        _count("outage", "n_outages"), _count("dip", "n_dips"), _count("swell", "n_swells"), _or0(F.sum(F.when(F.col("kind") == "outage", seconds_between(F.col("t_start"), F.col("t_end")))) / 60.0).alias("outage_minutes")
    )
    every = records.select(SESSION).distinct().withColumn("shift", F.explode(F.array(*[F.lit(s.name) for s in shifts.shifts])))
    every = every.union(rows.where(F.col("shift") == "unassigned").select(*keys).distinct())
    out = every.join(got, keys, "left").join(shares, keys, "left").join(peak, keys, "left").join(kinds, keys, "left").na.fill(0)
    window = F.coalesce(F.create_map(*[F.lit(x) for s in shifts.shifts for x in (s.name, s.window)])[F.col("shift")], F.lit("—"))
    hours = F.col("_n") / 3600.0
    return out.select(
        SESSION, "shift", window.alias("window"), "records", hours.alias("hours"), (F.col("P_total_avg_W") / 1000.0 * hours).alias("kWh"), "P_total_avg_W", "P_total_min_W", "P_total_max_W", "peak_demand_kW",
        F.lit(demand_minutes * 60).alias("peak_demand_window_secs"), "PF_avg", "V_LN_avg_V", "V_LN_p5_V", "V_LN_p95_V", "V_THD_p95_pct", "n_outages", "n_dips", "n_swells", "outage_minutes", "active_records",
        _or0(F.try_divide(F.col("active_records"), F.col("records")) * 100.0).alias("active_duty_pct"), (F.col("_ap") / 1000.0 * F.col("_an") / 3600.0).alias("active_kWh"), "active_PF_avg",
    )


def shift_occurrences(records: DataFrame, shifts: ShiftSet, tz: str | None = None) -> DataFrame:
    """Unbroken stretches of one shift: ``shift, label, lo, hi, t_start, t_end``; a stretch past midnight is one, named by its first local date."""
    rows = with_shift(records.select(SESSION, INDEX, "t_start", "t_end"), shifts, tz)
    runs = islands(rows, 0, (SESSION, "shift"))
    edge = rows.select(SESSION, F.col(INDEX).alias("_i"), "t_start", "t_end")
    out = runs.join(edge.select(SESSION, F.col("_i").alias("lo"), "t_start"), [SESSION, "lo"]).join(edge.select(SESSION, F.col("_i").alias("hi"), "t_end"), [SESSION, "hi"])
    label = F.concat_ws(" ", "shift", F.date_format(local(F.col("t_start"), tz), "yyyy-MM-dd"))
    return out.select(SESSION, "shift", label.alias("label"), "lo", (F.col("hi") + 1).alias("hi"), "t_start", "t_end")


def events_in_occurrences(events: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Events that start within an occurrence; a range join on days."""
    day = lambda t: F.to_date(t)
    spans = occurrences.select(SESSION, "shift", "label", F.col("t_start").alias("_a"), F.col("t_end").alias("_b"))
    spans = spans.withColumn("_d", F.explode(F.sequence(day(F.col("_a")), day(F.col("_b")))))
    return events.withColumn("_d", day(F.col("t_start"))).join(spans, [SESSION, "_d"]).where("t_start >= _a and t_start < _b").drop("_d", "_a", "_b")


def shift_coverage(records: DataFrame, shifts: ShiftSet, tz: str | None = None) -> DataFrame:
    """Per session: its records and their minutes of the day, and how many of each no shift, or more than one, holds. (``ShiftSet.coverage`` has the whole day's.)"""
    minute = F.col("minute")
    n = F.lit(0)
    for s in shifts.shifts:
        n = n + F.when((minute >= s.start) | (minute < s.end) if s.wraps else (minute >= s.start) & (minute < s.end), 1).otherwise(0)
    # at most 1,440 rows a session
    days = records.groupBy(SESSION, minute_of_day(F.col("t_start"), tz).alias("minute")).agg(F.count("*").alias("k")).withColumn("n", n)
    total = lambda when, name: [F.count_if(when).alias(f"{name}_minutes"), F.coalesce(F.sum(F.when(when, F.col("k"))), F.lit(0)).alias(f"{name}_records")]
    return days.groupBy(SESSION).agg(F.count("*").alias("minutes"), F.sum("k").alias("records"), *total(F.col("n") == 0, "gap"), *total(F.col("n") > 1, "overlap"))


def time_of_day(records: DataFrame, window: tuple[int, int] = (0, 1440), bin_minutes: int = 1) -> DataFrame:
    """Averages and envelopes by time of day, over all days; ``n_days`` counts the days in a bin. A NaN makes an average NaN, not an envelope."""
    minute = minute_of_day(F.col("t_start"))
    rows = records.where((minute >= window[0]) & (minute < window[1])).withColumn("_b", F.floor(minute / bin_minutes).cast("int") * bin_minutes)
    aggs = []
    for name, value in (("p_{}_kW", F.col("P_total_avg_W").cast("double") / 1000.0), ("v_{}_V", F.col("V_LN_a_avg_V").cast("double")), ("i_{}_A", F.col("I_a_avg_A").cast("double"))):
        known = F.when(~F.isnan(value), value)
        aggs += [F.avg(value).alias(name.format("avg")), F.min(known).alias(name.format("min")), F.max(known).alias(name.format("max"))]
    got = rows.groupBy(SESSION, "_b").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("t_start")).alias("n_days"), *aggs)
    label = F.format_string("%02d:%02d", F.floor(F.col("_b") / 60).cast("int"), F.col("_b") % 60)
    return got.select(SESSION, label.alias("bin"), *got.columns[2:])
