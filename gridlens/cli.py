"""Command line: ``python -m gridlens.cli analyze|compare|stitch``."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from gridlens.functions.calendar import known_zone
from gridlens.operators import filters, grouping, stats, stitch
from gridlens.operators.correlate import nearest_events
from gridlens.operators.events import detect_events, filter_events
from gridlens.plans import compare, report
from gridlens.rules import EventRules, FindingRules, Period, ShiftSet, Tariff, describe_overrides, load_rules, parse_window
from gridlens.sinks import files, series
from gridlens.sources import tables, trend
from gridlens.spec import CORE


def open_session(spark: SparkSession, path: str, tolerant: bool = True) -> tuple[DataFrame, dict]:
    """A session by what its path is (a CSV, a bundle, a file or folder of binary records), and its configuration."""
    rows, config = tables.open_session(spark, path, CORE, tolerant)
    found = config.first()
    return filters.core(rows), {k: v for k, v in found.asDict().items() if k != "session_id" and v is not None} if found else {}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridlens", description="Analyse power-quality sessions.")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("analyze", help="events, findings, statistics and roll-ups of one session")
    one.add_argument("session")
    for name in ("--from", "--to", "--anchor-start", "--anchor-end", "--reverse-cts", "--rules", "--asset", "--split-by", "--shifts", "--shifts-file", "--tz", "--tod", "--marks", "--peak-hours", "--currency", "--events"):
        one.add_argument(name)
    one.add_argument("--auto-reverse-cts", action="store_true")
    one.add_argument("--mark", action="append", default=[])
    for name in ("--nominal", "--breaker", "--peak-rate", "--offpeak-rate"):
        one.add_argument(name, type=float)
    for name, value in (("--tod-bin", 1), ("--demand-window", 900), ("--every", 1), ("--limit", None), ("--max-rows", None)):
        one.add_argument(name, type=int, default=value)
    one.add_argument("--json", action="store_true", help="results to standard output, as one object")
    one.add_argument("--out")
    for name, text in (("compare", "findings across sessions"), ("stitch", "sessions as one")):
        more = sub.add_parser(name, help=text)
        more.add_argument("sessions", nargs="+")
        more.add_argument("--reverse-cts")
        more.add_argument("--gap-tolerance", type=float, default=2.0)
        more.add_argument("--out", required=True)
    return p


def _analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, config = open_session(spark, a.session)
    if a.anchor_start or a.anchor_end:
        rows = filters.shift_clock(rows, a.anchor_start, a.anchor_end)
    rows = filters.reverse_cts(rows, a.reverse_cts)
    if a.auto_reverse_cts and any(r["reversed"] for r in stats.ct_reversal(rows).select("reversed").collect()):
        rows = filters.reverse_cts(rows, "all")
    rows = filters.time_window(rows, getattr(a, "from"), a.to).cache()
    rules = load_rules(a.rules, a.asset or config.get("asset_name")) if a.rules else EventRules()
    for line in describe_overrides(rules):
        print(f"[rules] {line}", file=sys.stderr)
    s = report.analyse(rows, rules, FindingRules(breaker_rating_a=a.breaker), a.nominal)
    if a.events:
        s.events = filter_events(s.events, a.events)
    if a.json:
        report.print_json(s, config, sys.stdout)
    if a.out:
        _write(s, a, config)
    s.close()
    rows.unpersist()


def _write(s: report.Session, a: argparse.Namespace, config: dict) -> None:
    spark, rows = s.records.sparkSession, s.records
    report.write_report(s, a.out, config, a.demand_window, every=a.every, limit=a.limit, most=a.max_rows)
    if a.mark or a.marks:
        marks = reduce(DataFrame.union, [tables.parse_marks(spark, a.mark), *([tables.read_marks(spark, a.marks)] if a.marks else [])])
        files.write_json(nearest_events(marks, s.events.drop("session_id")), f"{a.out}/markers.json")
    if a.tod:
        files.write_table(grouping.time_of_day(rows, parse_window(a.tod), a.tod_bin), f"{a.out}/time_of_day")
    if a.split_by:
        period = Period.parse(a.split_by)
        series.write_bucket_files(rows, s.events, s.nominal, period, f"{a.out}/buckets")
        files.write_table(grouping.bucket_summary(rows, s.events, period), f"{a.out}/buckets_summary")
    if a.shifts or a.shifts_file:
        shifts, tz = ShiftSet.load(a.shifts_file) if a.shifts_file else ShiftSet.parse(a.shifts), known_zone(a.tz)
        stretches = grouping.shift_occurrences(rows, shifts, tz)
        files.write_table(grouping.shift_comparison(rows, s.events, shifts, tz), f"{a.out}/shift_comparison")
        files.write_table(stretches, f"{a.out}/shift_occurrences")
        series.write_occurrence_files(rows, s.events, stretches, f"{a.out}/shifts")
    if a.peak_hours:
        rates = {k: v for k, v in (("currency", a.currency), ("peak_rate", a.peak_rate), ("offpeak_rate", a.offpeak_rate)) if v is not None}
        files.write_table(stats.tariff_cost(rows, Tariff.parse(a.peak_hours, **rates)), f"{a.out}/cost")


def _sessions(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    named = [(trend.session_name(p), filters.reverse_cts(open_session(spark, p)[0].drop("session_id"), a.reverse_cts)) for p in a.sessions]
    return stitch.label_sessions(named).cache()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "analyze":
        if not (a.out or a.json):
            raise SystemExit("analyze needs --out or --json")
        _analyze(spark, a)
        return 0
    rows = _sessions(spark, a)
    if a.command == "compare":
        found = detect_events(rows).cache()
        files.write_json(compare.analyze_compare(rows, found), f"{a.out}/compare_findings.json")
        found.unpersist()
        files.write_json(stats.compare_summary(rows), f"{a.out}/compare_summary.json")
        series.write_overlays(rows, f"{a.out}/overlays")
        return 0
    files.write_json(stitch.stitch_gaps(rows, a.gap_tolerance), f"{a.out}/gaps.json")
    files.write_json(stitch.sources(rows), f"{a.out}/sources.json")
    report.write_report(report.analyse(stitch.stitch(rows)), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
