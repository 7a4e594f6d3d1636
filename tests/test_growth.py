"""Results and plans on tables that repeat a month many times over, with clocks that are set back in between."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from gridlens.operators import correlate, events, filters, rolling
from gridlens.plans import compare
from gridlens.plans.bridge import _encoded, by_days
from gridlens.rules import CompareRules
from gridlens.sinks import grouped
from gridlens.spec import CORE, RECORD_BYTES

from .helpers import BASE, session


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString().lower()


def test_center_of_a_window_over_a_clock_set_back(spark):
    """Half of an odd, negative number of microseconds is cut towards the start."""
    rows = session(spark, 20).withColumns({c: F.expr(f"case when record_index >= 10 then {c} - interval '1 00:00:00.000003' day to second else {c} end") for c in ("t_start", "t_end")})
    got = rolling.pick_snapshots(rows, events.detect_events(rows, 277.0), 1, 20, 60).first()
    assert got.t_end < got.t_start and got.t_center == got.t_start + timedelta(microseconds=-((got.t_start - got.t_end) // timedelta(microseconds=1) // 2))


def test_marks_of_a_crowded_hour(spark):
    """Against every event for every mark; no frame of the plan is gone through anew for each row."""
    rng = np.random.default_rng(5)
    at = lambda n, most: [BASE + timedelta(seconds=int(s)) for s in rng.integers(0, most, n)]
    found = [(k, "dip", t, t) for k, t in enumerate(at(200, 9000))]
    marks = [(t, f"m{k}") for k, t in enumerate([*at(300, 3600), *at(100, 40_000), datetime(2023, 5, 1), datetime(2023, 6, 1)])]
    got = correlate.nearest_events(spark.createDataFrame(marks, "time timestamp_ntz, label string"), spark.createDataFrame(found, "id int, kind string, t_start timestamp_ntz, t_end timestamp_ntz"))
    assert "unboundedfollowing" not in plan(got)
    want = {label: min((abs(t - e[2]), e[0]) for e in found)[1] for t, label in marks}
    assert {r.label: r.event_id for r in got.collect()} == want


def test_no_task_sorts_a_file(spark, tmp_path, monkeypatch):
    """A file's rows are put in order piece by piece; what comes together are places of pieces, copied in steps."""
    monkeypatch.setattr(grouped, "PIECE", 100)
    rows = spark.range(2000, numPartitions=7).select(F.concat(F.lit("g"), F.expr("id div 1990"), F.lit("/t.txt")).alias("file"), (F.col("id") - 1).alias("seq"), F.concat("id", F.lit("\n")).alias("content"))
    rows = rows.orderBy(F.xxhash64("seq"))
    places = []
    monkeypatch.setattr(grouped, "_kept", lambda make, folder, plain=grouped._kept: places.append(folder) or plain(make, folder))
    grouped.write_files(rows, str(tmp_path / "out"))
    assert (tmp_path / "out/g0/t.txt").read_text() == "".join(f"{k}\n" for k in range(1990)) and (tmp_path / "out/g1/t.txt").read_text() == "".join(f"{k}\n" for k in range(1990, 2000))
    assert len(places) == 1 and not (tmp_path / "out/_attempts").exists()
    held = rows.withColumn("piece", F.expr("greatest(seq, 0L) div 100")).repartition("file", "piece").sortWithinPartitions("file", "piece", "seq").mapInArrow(grouped._kept(None, str(tmp_path / "held")), grouped.SCHEMA).collect()
    assert len(held) == 21 and sum(r.hi - r.lo for r in held) == sum(len(f"{k}\n") for k in range(2000))


def test_runs_of_records_are_pieces(spark, sf):
    """The records of a session reach its file as runs, not row by row."""
    rows = by_days(spark, sf).select("session_id", "record_index", *[F.unix_micros(F.col(c).cast("timestamp")).alias(a) for c, a in (("t_start", "s"), ("t_end", "e"))], *[F.col(c).cast("double").alias(c) for c in CORE])
    got = rows.mapInArrow(_encoded(True), "file string, seq long, content binary").select("file", "seq", F.length("content").alias("n")).collect()
    assert sum(r.n for r in got) == rows.count() * RECORD_BYTES + 5 * (5 + 40) and len(got) == 10 and {r.n for r in got if r.seq == 1 << 60} == {40}


def test_deviation_keeps_its_digits(spark):
    """Small deviations behind much larger values, over chunks' edges, against each window by itself; no join by session."""
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(5e7, 1e7, 40_000), 1000 + rng.integers(0, 3, 60_000) * 1e-3])
    rows = spark.createDataFrame([("s", i, BASE, BASE, float(v)) for i, v in enumerate(p)], "session_id string, record_index long, t_start timestamp_ntz, t_end timestamp_ntz, P_total_avg_W double")
    got = rolling.rolling_stdev(rows, 60)
    assert "join" not in plan(got)
    got = got.orderBy("record_index").toArrow()
    windows = np.lib.stride_tricks.sliding_window_view(p, 60)
    assert got.column("stdev_w").null_count == 59 and np.allclose(got.column("stdev_w").to_numpy()[59:], windows.std(1), rtol=1e-7, atol=0) and np.allclose(got.column("mean_w").to_numpy()[59:], windows.mean(1), rtol=1e-12)


def test_trends_are_judged_as_reported(spark):
    """Of very many records the share of low power factors is almost the same each session: a slope of 0.000000 is no trend. One of 0.000100 reaches its limit."""
    facts = spark.createDataFrame([(k, 6.0 * k, 277 + 6 * k * 0.00009996, 277.0, 277 + 6 * k * 0.0001996, 0.9 + 6 * k * 2e-7) for k in range(5)], "session_id int, days double, mean_a_v double, mean_b_v double, mean_c_v double, low_pf_fraction double")
    rules = CompareRules(voltage_drift_v_per_day=0.0001)
    assert compare.pf_trend(facts).first().r == 1 and compare.pf_degradation(facts, rules).count() == 0
    assert {(r.subject, r.severity, r.value) for r in compare.voltage_drift(facts, rules).collect()} == {("A", "warn", 0.0001), ("C", "alert", 0.0002)}


def test_thinning_joins_by_chunk(spark):
    """Rows meet their session's size by chunk, and not all of a session in one task."""
    rows = spark.range(200_000).select(F.lit("s").alias("session_id"), F.col("id").alias("record_index"), F.col("id").alias("t_start"), (F.col("id") % 1000).cast("double").alias("I_a_max_A"))
    thin = filters.decimate(rows, "I_a_max_A", 400)
    assert "_chunk" in plan(thin)
    got = {r.record_index for r in thin.collect()}
    assert got == {b * 1000 + i for b in range(200) for i in (0, 999)}
