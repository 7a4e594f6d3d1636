import math

import numpy as np
import pytest

from gridlens.operators import correlate, events, grouping, rolling, sequence, sketch, stats
from gridlens.rules import EventRules, Period, ShiftSet

from .helpers import OUT, session


def found(df, *kinds):
    return [r for r in df.orderBy("id").collect() if not kinds or r.kind in kinds]


def test_healthy_has_no_events(spark):
    assert found(events.detect_events(session(spark, 120), 277.0)) == []


def test_outage_dip_swell(spark):
    rows = session(spark, 180, [(60, 69, OUT), (30, 34, {"V_LN_a_min_V": 200.0}), (100, 102, {"V_LN_b_max_V": 320.0})])
    got = {e.kind: e for e in found(events.detect_events(rows, 277.0))}
    times = [r.t_start for r in rows.orderBy("record_index").collect()]
    assert got["outage"].t_start == times[60] and got["outage"].severity == 0.0
    assert got["dip"].affected_phases == ["a"] and got["dip"].severity == pytest.approx(200 / 277)
    assert got["swell"].affected_phases == ["b"] and got["swell"].severity == pytest.approx(320 / 277)


def test_gap_of_one_row_is_tolerated_and_reduced_over(spark):
    rows = session(spark, 60, [(10, 10, {"V_LN_a_min_V": 200.0}), (12, 12, {"V_LN_a_min_V": 200.0, "V_LN_c_min_V": 240.0}), (20, 20, {"V_LN_a_min_V": 190.0})])
    dips = found(events.detect_events(rows, 277.0), "dip")
    assert [(e.t_end - e.t_start).total_seconds() for e in dips] == [3.0, 1.0]
    assert dips[0].affected_phases == ["a", "c"]


def test_minimum_duration(spark):
    rows = session(spark, 60, [(10, 10, {"V_LN_a_min_V": 200.0}), (20, 22, {"V_LN_a_min_V": 200.0})])
    assert len(found(events.detect_events(rows, 277.0, EventRules(min_duration_secs=3)), "dip")) == 1


def test_nan_never_makes_an_event_but_an_outage(spark):
    nan = math.nan
    rows = session(spark, 60, [(10, 10, {"freq_avg_Hz": nan, "V_LN_a_min_V": nan, "V_LN_a_max_V": nan, "I_a_max_A": nan, "P_total_avg_W": nan}), (30, 30, {"V_LN_b_avg_V": nan})])
    assert [e.kind for e in found(events.detect_events(rows, 277.0))] == ["outage"]


def test_power_steps_and_currents(spark):
    rows = session(spark, 100, [(50, 99, {"P_total_avg_W": 150_000.0}), (70, 70, {"I_b_max_A": 900.0})])
    got = found(events.detect_events(rows, 277.0))
    assert [(e.kind, e.severity) for e in got] == [("power_step", 100_000.0), ("high_current", 900.0)]


def test_no_voltage_at_all(spark):
    rows = session(spark, 10, [(0, 9, OUT)])
    assert events.nominal_voltage(rows).count() == 0
    assert events.nominal_voltage(rows, 277.0).first().nominal_v == 277.0
    assert [e.kind for e in found(events.detect_events(rows))] == ["outage"]


def test_empty_session(spark):
    assert found(events.detect_events(session(spark, 3).limit(0))) == []


@pytest.mark.parametrize("chunk", [4, 7, 1 << 16])
def test_runs_do_not_depend_on_chunks(spark, chunk):
    import random

    rnd = random.Random(chunk)
    mask = [rnd.random() < 0.5 for _ in range(200)]
    rows = spark.createDataFrame([("s", i) for i, m in enumerate(mask) if m], "session_id string, record_index long")
    for gap in (0, 1, 3):
        want, run = [], None
        for i, m in enumerate(mask):
            if m:
                run = [run[0], i] if run and i - run[1] <= gap + 1 else ([i, i] if not (run and want.append(tuple(run))) else [i, i])
        want.append(tuple(run))
        got = sorted((r.lo, r.hi) for r in sequence.islands(rows, gap, chunk=chunk).collect())
        assert got == want


def test_rolling_sums_and_renumber(spark):
    rows = spark.createDataFrame([("s", i * 3, float(i % 7)) for i in range(100)], "session_id string, record_index long, v double")
    rows = sequence.renumber(rows, span=10)
    assert sorted(r.record_index for r in rows.collect()) == list(range(100))
    got = {r.record_index: r.s for r in sequence.rolling_sums(rows, 9, s=rows.v).collect()}
    v = [float(i % 7) for i in range(100)]
    assert all(got[i] is None if i < 8 else got[i] == pytest.approx(sum(v[i - 8 : i + 1])) for i in range(100))


def test_ride_through_points(spark):
    from pyspark.sql import functions as F

    from gridlens.functions.electrical import ride_through

    rows = spark.createDataFrame([(70.0, 0.1), (60.0, 1.0), (130.0, 0.4), (95.0, 5.0), (0.0, 18.0), (95.0, -1.0)], "r double, d double")
    assert [r[0] for r in rows.select(ride_through(F.col("r"), F.col("d"))).collect()] == ["no_interruption", "no_damage", "prohibited", "no_interruption", "no_damage", "no_interruption"]


def test_reversed_transformers(spark):
    rows = session(spark, 100, [(0, 69, {"P_total_avg_W": -30_000.0}), (70, 99, {"P_total_avg_W": 30_000.0})])
    got = stats.ct_reversal(rows).first()
    assert got.reversed and got.basis == "active" and got.frac_negative == pytest.approx(0.7)


def test_bimodal_load(spark):
    rows = session(spark, 100, [(50, 99, {**{f"I_{p}_avg_A": 16.0 for p in "abc"}, "P_total_avg_W": -7600.0, "PF_total_avg": -0.64})], PF_total_avg=0.47)
    states = {r.state: r for r in stats.load_state_rows(rows).collect()}
    assert states["active"].records == states["standby"].records == 50 and states["active"].PF_avg == pytest.approx(0.47)
    e = stats.session_energy(rows).first()
    assert e.energy_as_measured_kWh < e.energy_active_kWh == pytest.approx(e.energy_net_clip_standby_kWh)


def test_buckets_hold_every_event_once(spark):
    rows = session(spark, 120, [(10, 12, OUT), (70, 72, {"V_LN_a_min_V": 200.0})], step=3600)
    every = events.detect_events(rows, 277.0)
    for period in ("hour", "6h", "day", "week", "90m"):
        got = grouping.bucket_summary(rows, every, Period.parse(period)).collect()
        assert sum(r.n_outages for r in got) == 1 and sum(r.n_dips for r in got) == 1 and sum(r.records for r in got) == 120


def test_quiet_windows_keep_apart(spark):
    noise = {"P_total_avg_W": lambda i: 50_000.0 + (i % 2) * (i // 50)}
    rows = session(spark, 400, [(0, 399, noise), (30, 31, OUT)])
    picks = rolling.pick_snapshots(rows, events.detect_events(rows, 277.0, kinds=("outage",)), 3, 20, 60).orderBy("id").collect()
    assert len(picks) == 3
    centers = [p.t_center for p in picks]
    assert all(abs((a - b).total_seconds()) >= 60 for i, a in enumerate(centers) for b in centers[:i])
    assert [p.p_total_stdev_w for p in picks] == sorted(p.p_total_stdev_w for p in picks)


def test_demand_without_a_full_window(spark):
    got = rolling.demand_peak(session(spark, 10), 20).first()
    assert got.n_windows == 0 and got.peak_demand_w == 0.0 and got.peak_window_end is None


def test_marks_without_events(spark):
    from datetime import datetime

    marks = spark.createDataFrame([(datetime(2024, 1, 1), "x")], "time timestamp_ntz, label string")
    none = events.detect_events(session(spark, 5), 277.0).drop("session_id")
    got = correlate.nearest_events(marks, none).first()
    assert got.label == "x" and got.event_id is None and got.offset_secs is None


def test_shift_across_a_clock_change(spark):
    from datetime import datetime

    rows = session(spark, 72, base=datetime(2026, 10, 31, 5, 0), step=3600)
    got = grouping.shift_occurrences(rows, ShiftSet.parse("A=00:00-12:00,B=12:00-00:00"), "America/Chicago").orderBy("lo").collect()
    assert [r.hi - r.lo for r in got][:4] == [12, 12, 13, 12]  # the night of the change has an hour more
    assert got[2].label == "A 2026-11-01"


def test_quiet_windows_are_the_greedy_ones(spark):
    """Against a plain greedy loop over all candidates, with ties and events, at several distances."""
    rng = np.random.default_rng(9)
    rows = session(spark, 900, [(k, k, {"P_total_avg_W": float(p)}) for k, p in enumerate((rng.integers(0, 4, 900) * 1000).tolist())] + [(300, 310, OUT)])
    found = events.detect_events(rows, 277.0, kinds=("outage",))
    left = rolling.snapshot_candidates(rows, found, 10).collect()
    for n, apart in ((3, 60), (5, 7), (4, 400), (2, 10_000)):
        picks = []
        for c in sorted(left, key=lambda c: (round(c.stdev_w, 6), c.record_index)):
            center = c.t_start + (c.t_end - c.t_start) / 2
            if len(picks) < n and all(abs((center - p).total_seconds()) >= apart for p in picks):
                picks.append(center)
        got = [r.t_center for r in rolling.pick_snapshots(rows, found, n, 10, apart).orderBy("id").collect()]
        assert got == picks and len(got) >= 1


def test_sketches_merge_exactly(spark):
    """Sketches of parts, merged by one set of keys and by several, say what one of all values says."""
    rng = np.random.default_rng(3)
    values = [("s", f"d{k % 3}", int(k % 7), float(v), 0.0, 0.25, 400) for k, v in enumerate([*rng.normal(50, 20, 4000), -5.0, 1e9])]
    rows = spark.createDataFrame(values, "session_id string, day string, hour int, v double, lo double, width double, bins int")
    whole = lambda keys: sorted(map(tuple, sketch.finished(sketch.sketch(rows, keys), a=0.05, b=0.5, c=0.99).collect()))
    parts = sketch.sketch(rows, ["session_id", "day", "hour"])
    near = lambda a, b: len(a) == len(b) and all(x[:-8] == y[:-8] and x[-8:] == pytest.approx(y[-8:]) for x, y in zip(a, b, strict=True))
    assert near(sorted(map(tuple, sketch.finished(sketch.merged(parts, ["session_id", "day"]), a=0.05, b=0.5, c=0.99).collect())), whole(["session_id", "day"]))
    both = sketch.finished(sketch.merged(parts, ["session_id", "day"], ["session_id"]), a=0.05, b=0.5, c=0.99)
    assert both.where("day is null").count() == 1 and both.count() == 4
    assert near([tuple(r) for r in both.where("day is null").drop("day").collect()], whole(["session_id"]))
    assert sketch.merged(parts.limit(0), ["session_id"]).count() == 0


def test_median_of_continuous_values(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 501):
        volts = [rng.normal(277, 3, 3).tolist() for _ in range(n)] + [[0.0, 49.0, math.nan]]
        rows = spark.createDataFrame([("s", i, *v) for i, v in enumerate(volts)], "session_id string, record_index long, " + ", ".join(f"V_LN_{p}_avg_V double" for p in "abc"))
        assert events.nominal_voltage(rows).first().nominal_v == np.median([x for v in volts[:-1] for x in v])
