"""Reports: a session's results gathered, told in plain English, and written.

Texts are columns, one row a session, so a report of many sessions is as many jobs as a report of one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.functions.electrical import seconds_between
from gridlens.operators import events as ev
from gridlens.operators import rolling, stats
from gridlens.operators.sequence import SESSION
from gridlens.plans import findings as fi
from gridlens.rules import EventRules, FindingRules
from gridlens.sinks import files, grouped, multi, series
from gridlens.sources import tables


def duration_text(seconds: float) -> str:
    for size, unit in ((3600, "h"), (60, "min")):
        if seconds >= size:
            return f"{seconds / size:.1f} {unit}"
    return f"{seconds:.1f} s"


@dataclass
class Session:
    """What a report needs of one session. A report reads each table several times, so all but the records are cached."""

    records: DataFrame
    events: DataFrame
    nominal: DataFrame
    findings: DataFrame
    snapshots: DataFrame

    def close(self) -> None:
        """Let go of what is cached."""
        for df in (self.events, self.nominal, self.findings, self.snapshots):
            df.unpersist()


def analyse(records: DataFrame, rules: EventRules | None = None, finding_rules: FindingRules | None = None, nominal_v: float | None = None) -> Session:
    """Everything about one session (or several, by ``session_id``)."""
    nominal = ev.nominal_voltage(records, 277.0)
    if nominal_v is not None:
        nominal = nominal.withColumn("nominal_v", F.lit(float(nominal_v)))
    nominal = nominal.cache()
    found = ev.detect_events(records, nominal, rules).cache()
    return Session(records, found, nominal, fi.analyze(records, found, finding_rules).cache(), rolling.pick_snapshots(records, found).cache())


@dataclass
class Reloaded:
    """The tables of a report that was written before."""

    records: DataFrame
    minutes: DataFrame
    events: DataFrame
    snapshots: DataFrame


def worst_events(events: DataFrame) -> DataFrame:
    """Per session the longest outage, the deepest dip and the highest swell; the first of equal ones."""
    long = seconds_between(F.col("t_start"), F.col("t_end"))
    size = F.when(F.col("kind") == "outage", long).when(F.col("kind") == "dip", -F.col("severity")).otherwise(F.col("severity"))
    best = F.max(F.struct(size.alias("size"), (-F.col("id")).alias("back"), "id", "t_start", long.alias("seconds"), "severity", F.array_join("affected_phases", "/").alias("phases")))
    return events.where(F.col("kind").isin("outage", "dip", "swell")).groupBy(SESSION, "kind").agg(best.alias("w")).select(SESSION, "kind", "w.id", "w.t_start", "w.seconds", "w.severity", "w.phases")


def lead_dips(events: DataFrame, within_s: int = 30) -> DataFrame:
    """Per session the first dip that ends within 30 s before the longest outage starts."""
    outage = worst_events(events).where("kind = 'outage'").select(SESSION, F.col("t_start").alias("at"))
    dips = events.where("kind = 'dip'").join(outage, SESSION)
    gap = seconds_between(F.col("t_end"), F.col("at"))
    return dips.where((gap >= 0) & (gap <= within_s)).groupBy(SESSION).agg(F.min(F.struct("id", "severity", F.array_join("affected_phases", "/").alias("phases"))).alias("d")).select(SESSION, "d.*")


def ct_notice() -> Column:
    """What to say about reversed current transformers, of a row of ``ct_reversal``; null if they look right."""
    active = F.col("basis") == "active"
    share = F.when(active, F.col("active_frac_negative")).otherwise(F.col("frac_negative"))
    return F.when(F.col("reversed"), F.format_string("Real power is negative in %.0f%% of the %s records: the current transformers look reversed.", share * 100.0, F.when(active, "active").otherwise("energised")))


def _percent(c: str | Column) -> Column:
    return F.format_string("%.0f%%", (F.col(c) if isinstance(c, str) else c) * 100.0)


def _lasting(seconds: Column) -> Column:
    """``duration_text`` as a column."""
    return F.when(seconds >= 3600, F.format_string("%.1f h", seconds / 3600.0)).when(seconds >= 60, F.format_string("%.1f min", seconds / 60.0)).otherwise(F.format_string("%.1f s", seconds))


def narratives(s: Session, config: dict | DataFrame | None = None) -> DataFrame:
    """``session_id, text``: a summary of each session in sentences. ``config``: one for all, or rows of session_id and asset_name."""
    rows = stats.first_last(s.records).withColumn("seconds", seconds_between(F.col("first_start"), F.col("last_end")))
    if isinstance(config, DataFrame):
        rows = rows.join(config.select(F.col(SESSION).alias("_of"), F.col("asset_name").alias("asset")), F.col(SESSION).cast("string") == F.col("_of").cast("string"), "left").drop("_of")
    else:
        rows = rows.withColumn("asset", F.lit((config or {}).get("asset_name")).cast("string"))
    worst = worst_events(s.events).groupBy(SESSION).agg(*[F.first(F.when(F.col("kind") == k, F.struct("t_start", "seconds", "severity", "phases")), ignorenulls=True).alias(k) for k in ("outage", "dip", "swell")])
    lead = lead_dips(s.events).select(SESSION, F.struct("severity", "phases").alias("lead"))
    load = stats.load_state_rows(s.records).where("state = 'active' and records > 0").select(SESSION, F.struct("duty_pct", "P_avg_kW", "PF_avg").alias("load"))
    energy = stats.session_energy(s.records).select(SESSION, F.struct("energy_as_measured_kWh", "energy_active_kWh", "energy_net_clip_standby_kWh").alias("energy"))
    told = [F.first(F.when(F.col("kind") == k, F.concat("headline", F.lit("."))), ignorenulls=True).alias(k) for k in ("pf_drift", "imbalance_sustained", "phase_asymmetry")]
    findings = s.findings.groupBy(SESSION).agg(F.count_if(F.col("severity") == "alert").alias("alerts"), *told)
    ct = stats.ct_reversal(s.records).select(SESSION, ct_notice().alias("notice"))
    count = s.events.groupBy(SESSION).agg(F.count("*").alias("events"))
    for part in (worst, lead, load, energy, findings, ct, count):
        rows = rows.join(part, SESSION, "left")
    at = lambda k: F.date_format(F.col(f"{k}.t_start"), "HH:mm:ss")
    after = F.when(F.col("lead").isNotNull(), F.concat(F.lit(" after a dip of phase "), F.col("lead.phases"), F.lit(" to "), _percent("lead.severity"))).otherwise("")
    supply = (
        F.when(F.col("outage").isNotNull(), F.concat(F.lit("The longest outage lasted "), _lasting(F.col("outage.seconds")), F.lit(" from "), at("outage"), after, F.lit(".")))
        .when(F.col("dip").isNotNull(), F.concat(F.lit("Without an outage, the deepest dip went to "), _percent("dip.severity"), F.lit(" of nominal on phase "), F.col("dip.phases"), F.lit(" at "), at("dip"), F.lit(".")))
        .when(F.col("swell").isNotNull(), F.concat(F.lit("Without an outage, the highest swell went to "), _percent("swell.severity"), F.lit(" of nominal at "), at("swell"), F.lit(".")))
        .otherwise("There was no outage, dip or swell.")
    )
    alerts, n = F.coalesce("alerts", F.lit(0)), F.coalesce("events", F.lit(0))
    end = F.when(alerts > 0, F.format_string("%d finding(s) need attention.", alerts)).when(n > 0, F.format_string("%d event(s), none of which needs attention.", n)).otherwise("The supply looks clean.")
    sentences = [
        F.concat(F.coalesce(F.concat(F.lit("Asset "), "asset"), F.lit("This session")), F.lit(" has "), F.format_number("records", 0), F.lit(" records over "), _lasting(F.col("seconds")), F.lit(".")),
        supply,
        F.when(F.col("load").isNotNull(), F.format_string("The load was active %.0f%% of the time at %.0f kW with a power factor of %.2f.", "load.duty_pct", "load.P_avg_kW", "load.PF_avg")),
        F.when(F.col("energy").isNotNull(), F.format_string("Energy: %.0f kWh as measured, %.0f kWh active, %.0f kWh with standby clipped.", *[f"energy.{c}" for c in ("energy_as_measured_kWh", "energy_active_kWh", "energy_net_clip_standby_kWh")])),
        F.col("pf_drift"), F.col("imbalance_sustained"), F.col("phase_asymmetry"), F.col("notice"), end,
    ]
    return rows.select(SESSION, "asset", F.concat_ws(" ", *sentences).alias("text"))


def summaries(s: Session) -> DataFrame:
    """``session_id, seq, line``: counts of events, quiet windows and findings of each session, line by line."""
    every = s.records.select(SESSION).distinct()
    heads = every.select(SESSION, F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("seq"), F.lit(t).alias("line")) for k, t in ((0, "Events"), (1 << 40, "Quiet windows"), (2 << 40, "Findings"))])).alias("x")).select(SESSION, "x.*")
    place = lambda *by: F.row_number().over(Window.partitionBy(SESSION).orderBy(*by)).cast("long")  # noqa: E731  of kinds, or of few windows
    kinds = ev.count_by_kind(s.events).select(SESSION, place("kind").alias("seq"), F.format_string("  %s: %d", "kind", "n").alias("line"))
    quiet = s.snapshots.select(SESSION, (F.lit((1 << 40) + 1) + F.col("id")).alias("seq"), F.concat(F.lit("  "), F.col("t_start").cast("string"), F.lit(" to "), F.col("t_end").cast("string"), F.format_string(": %.1f kW", F.col("p_total_mean_w") / 1000.0)).alias("line"))
    found = s.findings.groupBy(SESSION, "severity", "kind").agg(F.count("*").alias("n"))
    found = found.select(SESSION, (F.lit(2 << 40) + place("severity", "kind")).alias("seq"), F.format_string("  %s %s x %d", "severity", "kind", "n").alias("line"))
    return heads.unionByName(kinds).unionByName(quiet).unionByName(found)


def narrative(s: Session, session, config: dict | None = None) -> str:
    """The narrative of one session."""
    row = narratives(s, config).where(F.col(SESSION) == session).first()
    return row["text"] if row else "The session is empty."


def markdown(text: str, title: str = "Session") -> str:
    return f"# {title}\n\n{text}\n"


def summary_text(s: Session, session) -> str:
    """The summary of one session."""
    return "".join(f"{r['line']}\n" for r in summaries(s).where(F.col(SESSION) == session).orderBy("seq").collect())


def print_json(s: Session, config: dict, out) -> None:
    """One object: configuration, counts, events, quiet windows and findings; rows come to the driver one by one."""
    n = {r["kind"]: r["n"] for r in s.events.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()}
    counts = {"event_count": sum(n.values()), "events_by_kind": n, "snapshot_count": s.snapshots.count()}
    out.write('{"config": ' + json.dumps(config) + ', "summary_stats": ' + json.dumps(counts))
    for name, df in (("events", s.events), ("snapshots", s.snapshots), ("insights", s.findings)):
        out.write(f', "{name}": [')
        for k, row in enumerate(df.orderBy(SESSION, "id").select(F.to_json(F.struct("*"), files.STAMPS)).toLocalIterator()):
            out.write((", " if k else "") + row[0])
        out.write("]")
    out.write("}\n")


def write_report(s: Session, path: str, config: dict | None = None, demand_window: int = 900, every: int = 1, limit: int | None = None, most: int | None = None) -> None:
    """Every table of a session's report under a path, and its texts. ``every``, ``limit`` and ``most`` go to the export of records."""
    spark = s.records.sparkSession
    files.write_json(files.events_payload(s.events, s.nominal), f"{path}/events.json")
    for name, df in {
        "insights": s.findings, "snapshots": s.snapshots, "stats": stats.session_stats(s.records), "thresholds": stats.threshold_seconds(s.records), "load_states": stats.load_state_rows(s.records), "energy": stats.session_energy(s.records),
        "ct_reversal": stats.ct_reversal(s.records), "harmonics": stats.harmonics(s.records), "sarfi": stats.sarfi(s.events, s.nominal), "demand": rolling.demand_peak(s.records, demand_window), "demand_series": rolling.demand_series(s.records, demand_window),
    }.items():
        {"stats": files.write_table, "load_states": files.write_load_states}.get(name, lambda d, p: files.write_json(d, f"{p}.json"))(df, f"{path}/{name}")
    if limit is None:
        multi.export_all(s.records, f"{path}/export", every, most, s.records.count() if most else None)
    else:
        files.write_csv(s.records, f"{path}/export/{multi.FULL}", every, limit, most)
        files.write_minutes(s.records, f"{path}/export/{multi.SAMPLE}")
    write_texts(s, path, config)
    series.write_event_series(s.records, s.events, f"{path}/events")


def write_texts(s: Session, path: str, config: dict | DataFrame | None = None) -> None:
    """``summary/<session>.txt`` and ``narrative/<session>.md`` of every session: two jobs, whatever their number."""
    lines = summaries(s)
    grouped.write_files(lines.select(F.concat(series.safe(F.col(SESSION)), F.lit(".txt")).alias("file"), "seq", F.concat("line", F.lit("\n")).alias("content")), f"{path}/summary")
    told = narratives(s, config)
    text = F.concat(F.lit("# "), F.coalesce("asset", F.lit("Session")), F.lit("\n\n"), "text", F.lit("\n"))
    grouped.write_files(told.select(F.concat(series.safe(F.col(SESSION)), F.lit(".md")).alias("file"), F.lit(0).alias("seq"), text.alias("content")), f"{path}/narrative")


EVENTS = "session_id string, id int, kind string, t_start timestamp, t_end timestamp, severity double, affected_phases array<string>"
SNAPSHOTS = "session_id string, id int, t_start timestamp, t_end timestamp, t_center timestamp, p_total_mean_w double, p_total_stdev_w double"


def reload(spark: SparkSession, path: str) -> Reloaded:
    """A report that was written before, without its session; raises ``FileNotFoundError`` where one of its tables is missing (quiet windows may be)."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    missing = [t for t in (f"export/{multi.FULL}", f"export/{multi.SAMPLE}", "events.json") if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(there, t))]
    if missing:
        raise FileNotFoundError(f"{path}: {', '.join(missing)}")
    table = lambda sink: tables.read_csv_session(spark, f"{path}/export/{sink}")
    snaps = files.read_json(spark, f"{path}/snapshots.json", SNAPSHOTS) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(there, "snapshots.json")) else spark.createDataFrame([], SNAPSHOTS)
    return Reloaded(table(multi.FULL), table(multi.SAMPLE), files.read_json(spark, f"{path}/events.json", EVENTS), snaps)
