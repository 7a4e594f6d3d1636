"""Statistics of sessions: histogram percentiles, channel statistics, load states, energy, harmonics, voltage indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.calendar import is_peak
from gridlens.functions.electrical import above, below, finite, load_state, mean_phase_current, not_outage, number, phases, residual_pct, ride_through, seconds_between
from gridlens.operators.sequence import INDEX, SESSION
from gridlens.operators.sketch import finished, sketch
from gridlens.rules import Tariff

#: (channel, lowest, highest, unit) of the session statistics.
STATS_CHANNELS = (
    [(f"V_LN_{p}_avg_V", 0.0, 400.0, "V") for p in "abc"]
    + [(f"I_{p}_avg_A", 0.0, 1000.0, "A") for p in "abc"]
    + [("freq_avg_Hz", 55.0, 65.0, "Hz")]
    + [(f"{q}_total_avg_{u}", -2e6, 2e6, u) for q, u in (("P", "W"), ("S", "VA"), ("Q", "VAR"))]
    + [("PF_total_avg", -1.05, 1.05, "")]
)
BINS = 4000
STATES = ("active", "standby")
SARFI = (90, 80, 70, 50, 10)


def long_values(rows: DataFrame, keys: list[str], channels: list[tuple[str, str, float, float, int]]) -> DataFrame:
    """(keys, name, v, lo, width, bins) of the values that are no NaN; ``channels``: (column, name, lowest, highest, bins)."""
    parts = [F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("v"), F.lit(float(lo)).alias("lo"), F.lit((hi - lo) / bins).alias("width"), F.lit(bins).alias("bins")) for c, name, lo, hi, bins in channels]
    out = rows.select(*keys, F.explode(F.array(*parts)).alias("x")).select(*keys, "x.*")
    return out.where(F.col("v").isNotNull() & ~F.isnan("v"))


def quantiles(values: DataFrame, keys: list[str], **of: float) -> DataFrame:
    """Histogram quantiles per key: the midpoint of the first bin that reaches the share; also ``n, min, max, mean, stdev``."""
    return finished(sketch(values, keys), **of)


def session_sketches(records: DataFrame, keys: list[str], channels: list | None = None) -> DataFrame:
    """Sketches of the channels of ``STATS_CHANNELS`` by ``keys`` and ``name``, to be stored and merged."""
    values = long_values(records, keys, [(c, c, lo, hi, BINS) for c, lo, hi, _ in (channels or STATS_CHANNELS)])
    return sketch(values, [*keys, "name"])


def session_stats(records: DataFrame) -> DataFrame:
    """Per session and channel: ``channel, unit, count, min, p1, p5, median, mean, p95, p99, max, stdev``."""
    values = long_values(records, [SESSION], [(c, c, lo, hi, BINS) for c, lo, hi, _ in STATS_CHANNELS])
    got = quantiles(values, [SESSION, "name"], p1=0.01, p5=0.05, median=0.5, p95=0.95, p99=0.99)
    unit = F.create_map(*[F.lit(x) for c, _, _, u in STATS_CHANNELS for x in (c, u)])
    return got.select(SESSION, F.col("name").alias("channel"), unit[F.col("name")].alias("unit"), F.col("n").alias("count"), "min", "p1", "p5", "median", "mean", "p95", "p99", "max", "stdev")


def threshold_seconds(records: DataFrame, undervoltage_v: float = 250.0, overcurrent_a: float = 800.0) -> DataFrame:
    low = not_outage() & (sum(F.when(below(v, undervoltage_v), 1).otherwise(0) for v in phases("V_LN_{}_avg_V")) > 0)
    high = sum(F.when(above(i, overcurrent_a), 1).otherwise(0) for i in phases("I_{}_avg_A")) > 0
    got = records.groupBy(SESSION).agg(F.count("*").alias("total_records"), F.count_if(low).alias("sec_undervoltage"), F.count_if(high).alias("sec_overcurrent"))
    return got.withColumns({f"pct_{n}": F.col(f"sec_{n}") / F.col("total_records") * 100 for n in ("undervoltage", "overcurrent")})


def ct_reversal(records: DataFrame, share: float = 0.5, active_a: float = 50.0) -> DataFrame:
    """Whether power is negative so often, in the active state if there is one, that the transformers look reversed."""
    on, busy = not_outage(), mean_phase_current() >= active_a
    p = number("P_total_avg_W")
    negative = below(F.col("P_total_avg_W").cast("double"), 0.0)
    got = records.groupBy(SESSION).agg(
        F.count_if(on).alias("non_outage_records"), F.count_if(on & negative).alias("negative_records"), F.coalesce(F.avg(F.when(on, p)), F.lit(0.0)).alias("mean_p_w"),
        F.count_if(on & busy).alias("active_records"), F.count_if(on & busy & negative).alias("active_negative_records"), F.coalesce(F.avg(F.when(on & busy, p)), F.lit(0.0)).alias("active_mean_p_w"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    got = got.withColumn("frac_negative", part("negative_records", "non_outage_records")).withColumn("active_frac_negative", part("active_negative_records", "active_records"))
    active = F.col("active_records") > 0
    return got.withColumn("basis", F.when(active, "active").otherwise("whole_session")).withColumn("reversed", F.when(active, F.col("active_frac_negative")).otherwise(F.col("frac_negative")) >= share)


def _pooled(pattern: str, over: float | None = None) -> tuple[Column, Column]:
    """Sum and count over the finite phase values (above a limit)."""
    parts = [F.when(finite(v) & (above(v, over) if over is not None else F.lit(True)), v) for v in phases(pattern)]
    return F.sum(sum(F.coalesce(p, F.lit(0.0)) for p in parts)), F.sum(sum(F.when(p.isNotNull(), 1).otherwise(0) for p in parts))


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def pooled_quantiles(records: DataFrame, keys: list[str], pattern: str, hi: float, over: float | None = None, bins: int = BINS, **of: float) -> DataFrame:
    values = long_values(records, keys, [(pattern.format(p), "v", 0.0, hi, bins) for p in "abc"]).where(finite(F.col("v")))
    if over is not None:
        values = values.where(F.col("v") > over)
    return quantiles(values, keys, **of).select(*keys, *of)


def load_state_rows(records: DataFrame, threshold_a: float = 50.0) -> DataFrame:
    """One row for each session and state, active and standby, also where no record is in it."""
    rows = records.withColumn("state", load_state(threshold_a))
    p = number("P_total_avg_W")
    v_sum, v_n = _pooled("V_LN_{}_avg_V", 50.0)
    got = rows.groupBy(SESSION, "state").agg(
        F.count("*").alias("records"), F.count(p).alias("_n"), _or0(F.avg(p)).alias("_p"), _or0(F.min(p) / 1000.0).alias("P_min_kW"), _or0(F.max(p) / 1000.0).alias("P_max_kW"),
        _or0(F.avg(mean_phase_current())).alias("I_avg_A"), _or0(F.avg(number("S_total_avg_VA")) / 1000.0).alias("S_avg_kVA"), _or0(F.avg(number("PF_total_avg"))).alias("PF_avg"), _or0(F.try_divide(v_sum, v_n)).alias("V_LN_avg_V"),
    )
    thd = pooled_quantiles(rows, [SESSION, "state"], "V_THD_pct_{}_avg", 50.0, V_THD_p95_pct=0.95)
    all_ = records.groupBy(SESSION).agg(F.count("*").alias("_all")).withColumn("state", F.explode(F.array(*[F.lit(s) for s in STATES])))
    out = all_.join(got, [SESSION, "state"], "left").join(thd, [SESSION, "state"], "left").na.fill(0)
    hours = F.col("_n") / 3600.0
    return out.select(SESSION, "state", "records", hours.alias("hours"), (F.col("records") / F.col("_all") * 100.0).alias("duty_pct"), (F.col("_p") / 1000.0 * hours).alias("kWh"), (F.col("_p") / 1000.0).alias("P_avg_kW"), "P_min_kW", "P_max_kW", "I_avg_A", "S_avg_kVA", "PF_avg", "V_LN_avg_V", "V_THD_p95_pct")


def session_energy(records: DataFrame, threshold_a: float = 50.0) -> DataFrame:
    """kWh as measured, of active records only, and with standby power clipped at 0."""
    e = number("P_total_avg_W") / 3.6e6
    active = mean_phase_current() >= threshold_a
    return records.groupBy(SESSION).agg(
        _or0(F.sum(e)).alias("energy_as_measured_kWh"), _or0(F.sum(F.when(active, e))).alias("energy_active_kWh"), _or0(F.sum(F.when(active, e).otherwise(F.greatest(e, F.lit(0.0))))).alias("energy_net_clip_standby_kWh")
    )


def session_totals(records: DataFrame) -> DataFrame:
    """Energy by direction, peaks, and seconds of import, export and idling; what is not finite is skipped."""
    wh, p = number("Wh_total"), F.col("P_total_avg_W").cast("double")
    amps = F.array_max(F.array(*[number(f"I_{x}_avg_A") for x in "abc"]))
    known = finite(p)
    got = records.groupBy(SESSION).agg(
        F.count("*").alias("rows"), _or0(F.sum(wh)).alias("wh_sum"), _or0(F.sum(F.when(wh > 0, wh))).alias("wh_fwd"), _or0(F.sum(F.when(wh < 0, wh))).alias("wh_rev"),
        F.greatest(F.lit(0.0), F.max(F.when(known, p))).alias("p_peak_pos"), F.least(F.lit(0.0), F.min(F.when(known, p))).alias("p_peak_neg"), F.greatest(F.lit(0.0), F.max(amps)).alias("i_peak"),
        F.count_if(known & (p > 10)).alias("sec_import"), F.count_if(known & (p < -10)).alias("sec_export"), F.count_if(known & (p >= -10) & (p <= 10)).alias("sec_idle"),
    )
    return got


def compare_summary(records: DataFrame) -> DataFrame:
    """Per session: rows, net, imported and exported kWh, peak import and export in kW, peak current."""
    t = session_totals(records)
    return t.select(SESSION, "rows", (F.col("wh_sum") / 1000).alias("net_kwh"), (F.col("wh_fwd") / 1000).alias("imported_kwh"), (F.col("wh_rev") / 1000).alias("exported_kwh"), (F.col("p_peak_pos") / 1000).alias("peak_import_kw"), (F.col("p_peak_neg") / 1000).alias("peak_export_kw"), F.col("i_peak").alias("peak_current_a"))


def session_cards(records: DataFrame, events: DataFrame) -> DataFrame:
    """What a page about several sessions shows of each: the comparison's figures and the number of its events."""
    count = events.groupBy(SESSION).agg(F.count("*").alias("event_count"))
    return compare_summary(records).drop("net_kwh").join(count, SESSION, "left").na.fill(0, ["event_count"])


def compare_table(records: DataFrame, sessions: list) -> DataFrame:
    """The comparison with a row per metric and a column per session."""
    long = compare_summary(records).withColumn("rows", F.col("rows").cast("double")).unpivot([SESSION], None, "metric", "value")
    return long.groupBy("metric").pivot(SESSION, sessions).agg(F.first("value"))


def tariff_cost(records: DataFrame, tariff: Tariff) -> DataFrame:
    wh, peak = number("Wh_total"), is_peak(F.col("t_start"), tariff)
    part = lambda when: _or0(F.sum(F.when(when, wh))) / 1000.0
    got = records.groupBy(SESSION).agg(
        part(peak & (wh > 0)).alias("peak_imported_kwh"), part(peak & (wh < 0)).alias("peak_exported_kwh"), part(~peak & (wh > 0)).alias("offpeak_imported_kwh"), part(~peak & (wh < 0)).alias("offpeak_exported_kwh")
    )
    a, b, c, d = (F.col(x) for x in got.columns[1:])
    return got.select(
        SESSION, F.lit(tariff.currency).alias("currency"), (a + b).alias("peak_kwh"), "peak_imported_kwh", "peak_exported_kwh", (c + d).alias("offpeak_kwh"), "offpeak_imported_kwh", "offpeak_exported_kwh",
        ((a + b) * tariff.peak_rate).alias("peak_cost"), ((c + d) * tariff.offpeak_rate).alias("offpeak_cost"), (a * tariff.peak_rate + c * tariff.offpeak_rate).alias("imported_cost"),
        (b * tariff.peak_rate + d * tariff.offpeak_rate).alias("exported_cost"), ((a + b) * tariff.peak_rate + (c + d) * tariff.offpeak_rate).alias("net_cost"),
    )


def harmonics(records: DataFrame, limit_pct: float = 8.0, planning_pct: float = 5.0) -> DataFrame:
    """95th percentiles of harmonic distortion per phase, and whether the voltage's is within the limit."""
    volts = quantiles(long_values(records, [SESSION], [(f"V_THD_pct_{p}_avg", p, 0.0, 100.0, 2000) for p in "abc"]), [SESSION, "name"], v=0.95)
    amps = quantiles(long_values(records, [SESSION], [(f"I_THD_pct_{p}_avg", p, 0.0, 200.0, 2000) for p in "abc"]), [SESSION, "name"], i=0.95)
    every = records.select(SESSION).distinct().withColumn("name", F.explode(F.array(*[F.lit(p) for p in "abc"])))
    out = every.join(volts.select(SESSION, "name", "v"), [SESSION, "name"], "left").join(amps.select(SESSION, "name", "i"), [SESSION, "name"], "left").na.fill(0.0, ["v", "i"])
    out = out.select(SESSION, F.col("name").alias("phase"), F.col("v").alias("v_thd_p95"), F.col("i").alias("i_thd_p95"), (F.col("v") <= limit_pct).alias("compliant"), (F.col("v") > planning_pct).alias("exceeds_planning"))
    return out.withColumn("all_compliant", F.min("compliant").over(Window.partitionBy(SESSION)))


def sarfi(events: DataFrame, nominal: DataFrame) -> DataFrame:
    """Per session, the dips and outages whose residual voltage fell below each share of nominal."""
    rows = nominal.join(events.where(F.col("kind").isin("dip", "outage")), SESSION, "left").withColumn("r", residual_pct(F.col("nominal_v")))
    return rows.groupBy(SESSION, "nominal_v").agg(*[F.count_if(F.coalesce(F.col("r") < x, F.lit(False))).alias(f"sarfi_{x}") for x in SARFI], F.count("kind").alias("events_considered"))


def event_ride_through(events: DataFrame, nominal: DataFrame) -> DataFrame:
    """Dips, swells and outages with ``residual_pct, duration_secs, itic_class``."""
    rows = events.join(nominal, SESSION).where(F.col("kind").isin("dip", "swell", "outage"))
    rows = rows.withColumn("residual_pct", residual_pct(F.col("nominal_v"))).withColumn("duration_secs", seconds_between(F.col("t_start"), F.col("t_end")))
    return rows.withColumn("itic_class", ride_through(F.col("residual_pct"), F.col("duration_secs"))).drop("nominal_v")


def first_last(records: DataFrame) -> DataFrame:
    """``first_start, last_end`` of each session, by place."""
    return records.groupBy(SESSION).agg(F.min_by("t_start", INDEX).alias("first_start"), F.max_by("t_end", INDEX).alias("last_end"), F.count("*").alias("records"))
