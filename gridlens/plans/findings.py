"""Findings of one session: rules over its records and events. A rule is a function of both that returns a row per finding.

What rules need of a session as a whole is one aggregation over its records (``session_sums``); ``analyze`` computes it once.
Rules read the events several times: where they are costly, hand in a cached or written table.

Every row has ``session_id, kind, severity, subject, value, headline, related_event_ids``; ``analyze`` orders and numbers them and
adds what to do about each kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.electrical import imbalance_pct, not_outage, number, phases, seconds_between
from gridlens.operators.correlate import outage_signatures, steps_with_frequency
from gridlens.operators.sequence import INDEX, SESSION, islands, per_session
from gridlens.rules import FindingRules

ACTIONS = {
    "outage_signature": ["Compare the time with the utility's records and the site's switchgear log."],
    "phase_asymmetry": ["Look at the transformer's taps.", "Look at how single-phase loads are spread."],
    "pf_drift": ["Size power factor correction from the reactive power stated, then measure again."],
    "imbalance_sustained": ["Move single-phase loads between phases.", "Derate motors while it lasts."],
    "freq_source_stiffness": ["Ask whether the supply is weak: a generator's droop, or a long feeder."],
    "outage_frequency": ["Report the times to the utility.", "Bridge short outages of controls."],
    "current_spike_ratio": ["Compare the peak with the breaker's instantaneous trip."],
    "breaker_margin": ["Reduce the load or raise the rating."],
}


def _finding(rows: DataFrame, kind: str, severity: Column, subject: Column, value: Column, headline: Column, ids: Column | None = None) -> DataFrame:
    ids = F.array() if ids is None else ids
    return rows.select(SESSION, F.lit(kind).alias("kind"), severity.alias("severity"), subject.alias("subject"), value.cast("double").alias("value"), headline.alias("headline"), ids.cast("array<int>").alias("related_event_ids"))


def session_sums(records: DataFrame, rules: FindingRules | None = None) -> DataFrame:
    """One row per session: phase voltages and currents outside outages, low power factor, how long it is."""
    rules, on, pf = rules or FindingRules(), not_outage(), number("PF_total_avg")
    low = F.coalesce(on & (F.abs(pf) > 0) & (F.abs(pf) < rules.pf_drift_threshold), F.lit(False))
    kilo = lambda name: F.avg(F.when(low, F.abs(number(name)))) / 1000.0
    current = {p: F.when(on, number(f"I_{p}_max_A")) for p in "abc"}
    return records.groupBy(SESSION).agg(
        *[F.avg(F.when(on, v)).alias(f"mean_{p}_v") for p, v in zip("abc", phases("V_LN_{}_avg_V"), strict=True)],
        (F.count_if(low) / F.count("*")).alias("low_fraction"), kilo("Q_total_avg_VAR").alias("mean_kvar"), kilo("S_total_avg_VA").alias("mean_kva"),
        *[F.avg(c).alias(f"mean_{p}_a") for p, c in current.items()], *[F.max(c).alias(f"peak_{p}_a") for p, c in current.items()],
        (seconds_between(F.min_by("t_start", INDEX), F.max_by("t_end", INDEX)) / 86400.0).alias("days"),
    )


def outage_signature(records: DataFrame, events: DataFrame, rules: FindingRules, sums: DataFrame | None = None) -> DataFrame:
    rows = outage_signatures(events, int(rules.outage_dip_window_secs))
    ids = F.array_compact(F.array("outage_id", "lead_dip_id", "inrush_id", "trail_dip_id"))
    return _finding(rows, "outage_signature", F.col("severity"), F.date_format("t_start", "yyyy-MM-dd'T'HH:mm:ss"), F.col("duration_s"), F.format_string("Outage at %s (%d s)", F.date_format("t_start", "HH:mm:ss"), "duration_s"), ids)


def asymmetry(records: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Mean voltage of each phase outside outages, their mean, and the spread in percent of it."""
    names = [f"mean_{p}_v" for p in "abc"]
    cols = [F.col(n) for n in names]
    mean = (cols[0] + cols[1] + cols[2]) / 3.0
    return (sums or session_sums(records)).select(SESSION, *names).withColumn("mean_v", mean).withColumn("spread_pct", (F.greatest(*cols) - F.least(*cols)) / F.col("mean_v") * 100.0)


def phase_asymmetry(records: DataFrame, events: DataFrame, rules: FindingRules, sums: DataFrame | None = None) -> DataFrame:
    rows = asymmetry(records, sums).where(F.col("spread_pct") >= rules.phase_asymmetry_pct)
    top = F.array_max(F.array(*[F.struct(F.col(f"mean_{p}_v").alias("v"), F.lit(p.upper()).alias("p")) for p in "abc"]))["p"]
    return _finding(rows, "phase_asymmetry", F.when(F.col("spread_pct") >= 3.0, "alert").otherwise("warn"), top, F.col("spread_pct"), F.format_string("Phase voltages differ by %.1f%%, phase %s is highest", "spread_pct", top))


def low_pf(records: DataFrame, rules: FindingRules, sums: DataFrame | None = None) -> DataFrame:
    """Share of all rows with a low power factor outside outages, and the mean powers then."""
    return (sums or session_sums(records, rules)).select(SESSION, "low_fraction", "mean_kvar", "mean_kva")


def pf_drift(records: DataFrame, events: DataFrame, rules: FindingRules, sums: DataFrame | None = None) -> DataFrame:
    rows = low_pf(records, rules, sums).where(F.col("low_fraction") >= rules.pf_drift_min_fraction)
    head = F.format_string("Power factor under %.2f for %.1f%% of the time, about %d kVAR", F.lit(rules.pf_drift_threshold), F.col("low_fraction") * 100, F.bround("mean_kvar").cast("long"))
    return _finding(rows, "pf_drift", F.when(F.col("low_fraction") < 0.30, "warn").otherwise("alert"), F.lit(""), F.col("low_fraction"), head)


def sustained_imbalance(records: DataFrame, rules: FindingRules) -> DataFrame:
    """Runs of rows over the limit, without gaps, of at least the seconds asked for: ``lo, hi, peak_pct``."""
    rows = records.select(SESSION, INDEX, F.when(not_outage(), imbalance_pct()).otherwise(0.0).alias("pct"))
    runs = islands(rows.where(F.col("pct") > rules.imbalance_sustained_pct), peak_pct="pct")
    return runs.where(F.col("hi") - F.col("lo") + 1 >= rules.imbalance_sustained_secs)


def imbalance_sustained(records: DataFrame, events: DataFrame, rules: FindingRules, sums: DataFrame | None = None) -> DataFrame:
    runs = sustained_imbalance(records, rules)
    rows = runs.groupBy(SESSION).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("seconds"), F.count("*").alias("windows"), F.max("peak_pct").alias("peak_pct"))
    head = F.format_string("Imbalance over %.1f%% for %d s in %d window(s), peak %.2f%%", F.lit(rules.imbalance_sustained_pct), "seconds", "windows", "peak_pct")
    return _finding(rows, "imbalance_sustained", F.lit("warn"), F.lit(""), F.col("seconds"), head)


def freq_source_stiffness(records: DataFrame, events: DataFrame, rules: FindingRules, sums: DataFrame | None = None) -> DataFrame:
    hits = steps_with_frequency(records, events, rules.freq_stiffness_hz)
    rows = hits.groupBy(SESSION).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).where(F.col("n") >= rules.freq_stiffness_min_count)
    return _finding(rows, "freq_source_stiffness", F.lit("warn"), F.lit(""), F.col("n"), F.format_string("%d load steps with the frequency off by more than %.2f Hz", "n", F.lit(rules.freq_stiffness_hz)), F.col("ids"))


def outage_frequency(records: DataFrame, events: DataFrame, rules: FindingRules, sums: DataFrame | None = None) -> DataFrame:
    n = events.where("kind = 'outage'").groupBy(SESSION).agg(F.count("*").alias("outages"), F.sort_array(F.collect_list("id")).alias("ids"))
    rows = (sums or session_sums(records)).select(SESSION, "days").where("days > 0").join(n, SESSION).withColumn("per_day", F.col("outages") / F.col("days"))
    rows = rows.where(F.col("per_day") >= rules.outage_frequency_per_day)
    return _finding(rows, "outage_frequency", F.when(F.col("per_day") >= 2 * rules.outage_frequency_per_day, "alert").otherwise("warn"), F.lit(""), F.col("per_day"), F.format_string("%d outage(s) in %.2f day(s), %.2f a day", "outages", "days", "per_day"), F.col("ids"))


def current_ratios(records: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Per session and phase: mean and peak of the highest current outside outages, and their ratio."""
    parts = [F.struct(F.lit(p).alias("phase"), F.col(f"mean_{p}_a").alias("mean_a"), F.col(f"peak_{p}_a").alias("peak_a")) for p in "abc"]
    rows = (sums or session_sums(records)).select(SESSION, F.explode(F.array(*parts)).alias("x")).select(SESSION, "x.*")
    return rows.where(F.col("mean_a") > 0).withColumn("ratio", F.col("peak_a") / F.col("mean_a"))


def current_spike_ratio(records: DataFrame, events: DataFrame, rules: FindingRules, sums: DataFrame | None = None) -> DataFrame:
    rows = current_ratios(records, sums).where(F.col("ratio") >= rules.current_to_mean_ratio_alert)
    severity, head = F.lit("info"), F.format_string("Phase %s peaks at %.0f A, %.1f times its mean of %.0f A", F.upper("phase"), "peak_a", "ratio", "mean_a")
    if rules.breaker_rating_a:
        pct = F.col("peak_a") / rules.breaker_rating_a * 100
        severity = F.when(pct > 100, "alert").when(pct > 80, "warn").otherwise("info")
        head = F.format_string("Phase %s peaks at %.0f A, %.1f%% of the breaker's rating", F.upper("phase"), "peak_a", pct)
    return _finding(rows, "current_spike_ratio", severity, F.upper("phase"), F.col("ratio"), head)


def breaker_margin(records: DataFrame, events: DataFrame, rules: FindingRules, sums: DataFrame | None = None) -> DataFrame:
    """The phase with the highest peak, where that is over the breaker's rating; no row without a rating."""
    rating = float(rules.breaker_rating_a or 0)
    worst = current_ratios(records, sums).groupBy(SESSION).agg(F.max(F.struct("peak_a", "phase")).alias("w")).select(SESSION, "w.*")
    rows = worst.where((F.lit(rating) > 0) & (F.col("peak_a") > rating))
    return _finding(rows, "breaker_margin", F.lit("alert"), F.upper("phase"), F.col("peak_a"), F.format_string("Phase %s peaks at %.0f A over a breaker of %.0f A", F.upper("phase"), "peak_a", F.lit(rating)))


RULES = [outage_signature, phase_asymmetry, pf_drift, imbalance_sustained, freq_source_stiffness, outage_frequency, current_spike_ratio, breaker_margin]


def ranked(findings: DataFrame, by: str) -> DataFrame:
    """Alerts first, then warnings; within them by kind and then in the rules' order; numbered from 0."""
    rank = F.when(F.col("severity") == "alert", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(rank, "kind", "subject")
    return findings.withColumn("id", F.row_number().over(w) - 1)


def analyze(records: DataFrame, events: DataFrame, rules: FindingRules | None = None) -> DataFrame:
    """All findings of each session."""
    rules = rules or FindingRules()
    sums = per_session(session_sums(records, rules))
    found = reduce(DataFrame.unionByName, [rule(records, events, rules, sums) for rule in RULES])
    what = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    return ranked(found, SESSION).withColumn("recommended_actions", what[F.col("kind")])
