import gc
import json
import math
import re
import tracemalloc
import zipfile
from datetime import datetime
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from gridlens import cli
from gridlens.functions import calendar
from gridlens.operators import events, grouping, stitch
from gridlens.plans import compare, report
from gridlens.rules import Period, ShiftSet
from gridlens.sinks import files, grouped, multi, series
from gridlens.sources import cache, ranged, tables, trend
from gridlens.spec import CHANNELS, CORE, INDEX, MAGIC, RECORD_BYTES

from .helpers import OUT, session

BASE = 1_683_180_000_000_000  # 2023-05-04T06:00:00Z


def synthetic(n=10):
    return trend.encode([(BASE + i * 1_000_000, BASE + (i + 1) * 1_000_000, [7.0 * i - f * 0.25 for f in range(180)]) for i in range(n)])


def put(folder, raw, name="ES.001"):
    (folder / name).mkdir()
    (folder / name / "trend.bin").write_bytes(raw)
    return str(folder / name / "trend.bin")


def test_round_trip(spark, tmp_path):
    path = put(tmp_path, synthetic())
    rows = trend.read_trend(spark, path).orderBy("record_index").collect()
    assert len(rows) == 10 and rows[0].session_id == "ES.001" and rows[3].t_start == datetime(2023, 5, 4, 6, 0, 3)
    assert all(rows[i][CHANNELS[f]] == 7.0 * i - f * 0.25 for i in (0, 9) for f in CHANNELS)
    few = trend.read_trend(spark, path, ["PF_total_avg"])
    assert few.columns == ["session_id", "record_index", "t_start", "t_end", "PF_total_avg"]
    assert trend.file_facts(spark, path).first()[1:] == (10, False)
    split = trend.read_trend(spark, path, ["PF_total_avg"], split=3 * RECORD_BYTES)
    assert split.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, few.collect()))
    facts = trend.first_last_times(spark, path).first()
    assert facts.last_end == datetime(2023, 5, 4, 6, 0, 10)
    with pytest.raises(ValueError):
        trend.read_trend(spark, path, ["nope"])


def test_tolerant_scan(spark, tmp_path):
    raw = bytearray(synthetic(6))
    raw[2 * RECORD_BYTES] ^= 0xFF  # another magic number
    raw[4 * RECORD_BYTES + 24 : 4 * RECORD_BYTES + 28] = b"\x00\x00\xc0\x7f"  # NaN
    path = put(tmp_path, bytes(raw) + b"\x01" * 40)
    assert trend.read_trend(spark, path, ["freq_avg_Hz"], tolerant=True).count() == 5
    got = trend.scan_stats(spark, path).first()
    assert (got.good, got.truncated, got.nonfinite) == (5, 1, 1)
    assert got.bad_magic == RECORD_BYTES and got.total_seen == 5 + RECORD_BYTES
    with pytest.raises(Exception, match="magic"):
        trend.read_trend(spark, path, ["freq_avg_Hz"]).collect()


def test_tail_shorter_than_a_record_after_noise():
    offsets, stats = trend.good_offsets(synthetic(1) + b"\x00" * (RECORD_BYTES + 5), True)
    assert list(offsets) == [0] and stats["bad_magic"] == 6 and stats["truncated"] == 1
    assert trend.good_offsets(b"", True)[1]["truncated"] == 0


def test_bundle(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ES.SYN.fel", "w") as z:
        z.writestr("ES.SYN/trend.bin", synthetic(4))
        z.writestr("ES.SYN/ES.SYN-config.json", json.dumps({"asset_name": "Pump"}))
    rows = tables.read_bundles(spark, str(tmp_path), ["freq_avg_Hz"])
    assert rows.count() == 4 and rows.first().session_id == "ES.SYN"
    assert tables.bundle_config(zipfile.ZipFile(tmp_path / "ES.SYN.fel")) == {"asset_name": "Pump"}
    assert tables.pick_trend(["trend.bin", "x/trend.bin"]) == "trend.bin"
    with pytest.raises(tables.NoSession):
        tables.pick_trend(["a/trend.bin", "b/trend.bin"])


def test_csv_session(spark, tmp_path):
    (tmp_path / "s.csv").write_text("record_index,timestamp_utc,window_end_utc,freq_avg_Hz,other\n0,2024-01-01T00:00:00+00:00,2024-01-01T00:00:01+00:00,60.5,x\n1,bad,,1,\n2,2024-01-01T00:00:02,,oops,\n")
    got = tables.read_csv_session(spark, str(tmp_path / "s.csv")).orderBy("record_index").collect()
    assert [(r.record_index, r.freq_avg_Hz) for r in got] == [(0, 60.5), (2, 0.0)]
    assert got[1].t_end == datetime(2024, 1, 1, 0, 0, 3)
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    with pytest.raises(tables.NoSession):
        tables.read_csv_session(spark, str(tmp_path / "t.csv"), strict=True)


def test_export_and_reload(spark, tmp_path):
    rows = session(spark, 130, [(5, 5, {"P_total_avg_W": math.nan})])
    files.write_csv(rows, str(tmp_path / "full"))
    back = tables.read_csv_session(spark, str(tmp_path / "full"), "s")
    assert back.count() == 130 and set(CORE) <= set(back.columns)
    assert [e.kind for e in events.detect_events(back, 277.0).collect()] == [e.kind for e in events.detect_events(rows, 277.0).collect()]
    files.write_minutes(rows, str(tmp_path / "min"))
    assert spark.read.option("header", True).csv(str(tmp_path / "min")).count() == 3
    files.write_csv(rows, str(tmp_path / "few"), most=30)
    assert spark.read.option("header", True).csv(str(tmp_path / "few")).count() == 26


def test_marks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("timestamp,label\n2024-01-01T00:00:00Z,start\nnever,x\n")
    assert [r.label for r in tables.read_marks(spark, str(tmp_path / "m.csv")).collect()] == ["start"]
    assert tables.parse_marks(spark, ["2024-01-01T00:00:00Z=go", "junk"]).count() == 1


def planted(spark, **more):
    return session(spark, 400, [(100, 170, OUT), (90, 94, {"V_LN_a_min_V": 200.0}), (300, 301, {"V_LN_b_max_V": 330.0})], PF_total_avg=0.5, Q_total_avg_VAR=30_000.0, **more)


def test_report(spark, tmp_path):
    s = report.analyse(planted(spark))
    text = report.narrative(s, "s", {"asset_name": "Pump"})
    assert "Asset Pump has 400 records" in text and "outage lasted 1.2 min" in text and "dip of phase a to 72%" in text
    assert "outage: 1" in report.summary_text(s, "s")
    report.write_report(s, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/events.json").where("itic.itic_class is not null").count() == 3
    kinds = {r.kind for r in s.findings.collect()}
    assert {"outage_signature", "pf_drift", "outage_frequency"} <= kinds
    assert (tmp_path / "narrative/s.md").read_text() == f"# Session\n\n{report.narrative(s, 's')}\n" and (tmp_path / "summary/s.txt").read_text() == report.summary_text(s, "s")
    assert spark.read.option("header", True).csv(f"{tmp_path}/export/session.csv").count() == 400
    again = report.reload(spark, str(tmp_path))
    assert (again.records.count(), again.minutes.count()) == (400, 7) and {r.session_id for r in again.records.select("session_id").distinct().collect()} == {"s"}
    assert sorted((r.id, r.kind, str(r.t_start), r.severity) for r in again.events.collect()) == sorted((r.id, r.kind, str(r.t_start), r.severity) for r in s.events.collect())
    assert again.snapshots.count() == s.snapshots.count()
    [text] = (tmp_path / "load_states.csv").glob("part-*.csv")
    assert re.fullmatch(r"s,(active|standby),\d+,\d+\.\d\d,\d+\.\d\d,.*,-?\d\.\d{3},\d+\.\d\d,\d+\.\d\d", text.read_text().splitlines()[1])
    with pytest.raises(FileNotFoundError):
        report.reload(spark, str(tmp_path / "narrative"))
    zoom = (tmp_path / "events/s").glob("event-*-outage.tsv")
    assert [len(f.read_text().splitlines()) for f in zoom] == [1 + 30 + 71 + 61]


def test_reports_of_many_sessions(spark, tmp_path):
    """Texts of all sessions in as many jobs as of one, each as the session alone gives it."""
    parts = [session(spark, 40 + 3 * k, [(10, 12 + k, OUT)] if k % 3 else [], name=f"s/{k}", PF_total_avg=0.5 if k % 2 else 0.95) for k in range(6)]
    rows = reduce(DataFrame.unionByName, parts)
    config = spark.createDataFrame([("s/1", "Pump"), ("s/2", "Fan")], "session_id string, asset_name string")
    report.write_texts(report.analyse(rows), str(tmp_path), config)
    assert sorted(p.name for p in (tmp_path / "narrative").iterdir()) == [f"s_{k}.md" for k in range(6)]
    for k in (1,):
        alone = report.analyse(parts[k])
        assert (tmp_path / f"summary/s_{k}.txt").read_text() == report.summary_text(alone, f"s/{k}")
        assert report.narrative(alone, f"s/{k}", {"asset_name": "Pump"} if k == 1 else None) in (tmp_path / f"narrative/s_{k}.md").read_text()


def test_files_by_group(spark, tmp_path):
    """Buckets, stretches of shifts, events and sessions, a file for each and kind; every record and event in its one."""
    rows = session(spark, 5000, [(100, 170, OUT), (3595, 3605, OUT)], base=datetime(2024, 5, 1, 5, 0))
    found, nominal = events.detect_events(rows, 277.0), events.nominal_voltage(rows)
    series.write_bucket_files(rows, found, nominal, Period.parse("hour"), str(tmp_path / "b"))
    folders = sorted((tmp_path / "b/s").iterdir())
    assert [f.name for f in folders] == ["2024-05-01T05", "2024-05-01T06"] and all(sorted(p.name for p in f.iterdir()) == ["events.json", "session.csv", "summary.txt"] for f in folders if f.name.endswith("05"))
    assert [len((f / "session.csv").read_text().splitlines()) for f in folders] == [3601, 1401]
    told = [json.loads(x) for x in (folders[0] / "events.json").read_text().splitlines()]
    assert [e["spans_bucket_boundary"] for e in told if e["kind"] == "outage"] == [False, True] and "records: 3600\n" in (folders[0] / "summary.txt").read_text()
    assert len((tmp_path / "b/buckets_summary.csv").read_text().splitlines()) == 3
    stretches = grouping.shift_occurrences(rows, ShiftSet.parse("a=00:00-06:00,b=06:00-24:00"))
    series.write_occurrence_files(rows, found, stretches, str(tmp_path / "o"))
    assert {f.name: len((f / "session.csv").read_text().splitlines()) for f in (tmp_path / "o/s").iterdir()} == {"a_2024-05-01": 3601, "b_2024-05-01": 1401}
    assert "events: " in (tmp_path / "o/s/a_2024-05-01/summary.txt").read_text()
    series.write_overlays(rows.withColumn("P_total_avg_W", F.when(F.col("record_index") == 1, math.nan).otherwise(F.col("P_total_avg_W"))), str(tmp_path / "v"))
    lines_ = (tmp_path / "v/s.tsv").read_text().splitlines()
    assert lines_[0].split("\t")[0] == "rel_s" and lines_[2].split("\t")[0] == "1.0" and "NaN" in lines_[2] and len(lines_) == 5001


def test_one_pass_for_all_sinks(spark, tmp_path):
    """Each record is read once; the sinks hold what separate exports hold; a limit needs no count."""
    rows = session(spark, 500, [(7, 8, {"P_total_avg_W": math.nan})], name='quo"ted, s').repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counts = multi.export_all(rows.mapInArrow(watched, rows.schema), str(tmp_path / "all"), most=120, estimate=500)
    assert seen.value == 500
    assert (counts["records"], counts["nonfinite"], counts["exported"], counts["sampled"], counts["stride"]) == (500, 2, 100, 9, 5)
    files.write_csv(rows, str(tmp_path / "full"), 5)
    files.write_minutes(rows, str(tmp_path / "minutes"))
    read = lambda p: sorted(map(tuple, spark.read.option("header", True).csv(str(p)).collect()), key=str)
    assert read(tmp_path / "all/session.csv") == read(tmp_path / "full") and read(tmp_path / "all/session_1min.csv") == read(tmp_path / "minutes")
    assert spark.read.parquet(str(tmp_path / "all/store")).count() == 500
    with pytest.raises(ValueError):
        multi.export_all(rows, str(tmp_path / "no"), most=3)


def test_export_again(spark, tmp_path):
    """A second export takes the place of the first; nothing of either's attempts stays."""
    for n in (300, 120):
        counts = multi.export_all(session(spark, n).repartition(2), str(tmp_path / "all"))
        assert counts["records"] == counts["exported"] == n
        assert spark.read.parquet(str(tmp_path / "all/store")).count() == spark.read.option("header", True).csv(str(tmp_path / "all/session.csv")).count() == n
        assert sorted(x.name for x in (tmp_path / "all").iterdir()) == ["session.csv", "session_1min.csv", "store"]


def test_quiet_report(spark):
    assert report.narrative(report.analyse(session(spark, 50, PF_total_avg=0.95)), "s").endswith("The supply looks clean.")


def test_stitch_and_compare(spark):
    days = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    named = [("x", planted(spark, base=d, **{f"V_LN_{p}_avg_V": 277.0 + k for p in "abc"}).drop("session_id")) for k, d in enumerate(days)]
    rows = stitch.label_sessions(named)
    assert {r.session_id for r in rows.select("session_id").distinct().collect()} == {"x", "x-2", "x-3", "x-4"}
    whole = stitch.stitch(rows)
    assert whole.count() == 1600 and whole.agg({"record_index": "max"}).first()[0] == 1599
    assert [r.gap_s for r in stitch.stitch_gaps(rows).collect()] == [86_000.0] * 3
    kinds = {r.kind for r in compare.analyze_compare(rows, events.detect_events(rows, 277.0)).collect()}
    assert {"voltage_drift", "recurring_outages"} <= kinds


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(report, "write_report", lambda *a, **k: None)  # test_report has it
    path = put(tmp_path, synthetic(70)).removesuffix("/trend.bin")
    out = str(tmp_path / "out")
    args = ["analyze", path, "--out", out, "--json", "--nominal", "277", "--tod", "00:00-24:00", "--mark", "2023-05-04T06:00:05Z=go", "--peak-hours", "8-20", "--peak-rate", "0.5", "--reverse-cts", "a", "--shifts", "day=06:00-18:00,night=18:00-06:00", "--tz", "America/Chicago"]
    assert cli.main(args, spark) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert set(said) == {"config", "summary_stats", "events", "snapshots", "insights"} and said["summary_stats"]["event_count"] == len(said["events"])
    assert spark.read.json(f"{out}/markers.json").first().label == "go" and spark.read.option("header", True).csv(f"{out}/cost.csv").count() == 1
    [text] = (tmp_path / "out/shifts/ES.001").glob("*/session.csv")
    assert len(text.read_text().splitlines()) == 71
    other = put(tmp_path, synthetic(5), "ES.002")
    assert cli.main(["stitch", path, other, "--out", str(tmp_path / "st")], spark) == 0
    assert spark.read.json(f"{tmp_path}/st/sources.json").count() == 2
    with pytest.raises(SystemExit):
        cli.main(["analyze", path], spark)


def test_open_session(spark, tmp_path):
    (tmp_path / "x.txt").write_text("no")
    (tmp_path / "bare").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.open_session(spark, str(tmp_path / "nothing"))
    for name in ("x.txt", "bare"):
        with pytest.raises(tables.NoSession):
            tables.open_session(spark, str(tmp_path / name))


def test_sessions_kept_by_label(spark):
    m = stitch.MultiSession()
    assert [m.add("x", session(spark, k, base=datetime(2024, 1, k))) for k in (3, 2, 1)] == ["x", "x-2", "x-3"]
    m.remove("x-2")
    m.rename("x-3", "y")
    with pytest.raises(ValueError):
        m.rename("y", "x")
    assert list(m.of) == ["x", "y"] and m.stitched().count() == 4 and m.stitched().where("source = 'y' and record_index = 0").count() == 1


def test_cached_sessions(spark, tmp_path, monkeypatch):
    """Unchanged files aren't decoded again, changed ones alone are; what isn't the cache's stays; tables in use stay."""
    source, held = tmp_path / "in", tmp_path / "cache"
    source.mkdir()
    for k in (1, 2, 3):
        put(source, synthetic(10 * k), f"ES.00{k}")
    (held / "run-mine").mkdir(parents=True)
    (held / "run-mine" / "notes.txt").write_text("not the cache's")
    asked = []
    plain = cache.read_trend
    monkeypatch.setattr(cache, "read_trend", lambda spark, paths, *a, **k: asked.append(sorted(trend.session_name(p) for p in paths)) or plain(spark, paths, *a, **k))
    get = lambda *columns, **more: cache.cached_trend(spark, str(source), str(held), list(columns), **more)
    first = get("V_LN_a_avg_V")
    assert first.count() == 60 and asked == [["ES.001", "ES.002", "ES.003"]]
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, trend.read_trend(spark, str(source), ["V_LN_a_avg_V"]).collect()))
    assert get("V_LN_a_avg_V").count() == 60 and len(asked) == 1
    (source / "ES.002" / "trend.bin").write_bytes(synthetic(7))
    assert get("V_LN_a_avg_V").count() == 47 and asked[1:] == [["ES.002"]]
    (source / "ES.001").rename(source / "old")  # the same bytes under another name are another session, the rest is known
    assert get("V_LN_a_avg_V").where("session_id = 'old'").count() == 10 and asked[2:] == [["old"]]
    (source / "old" / "trend.bin").write_bytes(b"")
    other = get("I_a_avg_A", keep=1, grace=0)
    assert other.count() == 37 and first.count() == 60  # a frame that is open still reads
    del first
    gc.collect()
    get("I_a_avg_A", keep=1, grace=0)
    tables_ = json.loads((held / "manifest.json").read_text())["tables"]
    assert len(tables_) == 2 and (held / "run-mine" / "notes.txt").read_text() == "not the cache's"
    assert other.count() == 37
    with pytest.raises(ValueError):
        cache.cached_trend(spark, "viewfs://store/x", str(held))


def test_damaged_files_cut_anywhere(spark, tmp_path):
    """Every split gives what one scan from the start gives: records, numbers and counts."""
    rng = np.random.default_rng(4)
    for k in range(12):
        raw = b""
        for i in range(int(rng.integers(0, 12))):
            record = bytearray(synthetic(1))
            if rng.random() < 0.2:
                record[40:44] = MAGIC  # in the middle of a record
            if rng.random() < 0.2:
                record = record[: int(rng.integers(1, RECORD_BYTES))]
            if rng.random() < 0.1:
                record[24:28] = b"\0\0\x80\x7f"
            raw += bytes(record) + (bytes(int(rng.integers(0, 900))) if rng.random() < 0.2 else b"")
        put(tmp_path, raw, f"F{k}")
    want, counts = [], []
    for k in range(12):
        raw = (tmp_path / f"F{k}" / "trend.bin").read_bytes()
        offsets, stats = trend.good_offsets(raw, True)
        want += [(f"F{k}", i, np.frombuffer(raw[p + 24 : p + 28], "<f4")[0]) for i, p in enumerate(offsets)]
        counts.append((f"F{k}", stats["total_seen"], stats["good"], stats["bad_magic"], stats["truncated"]))
    assert sum(c[3] > 0 for c in counts) > 3
    for split in (RECORD_BYTES, 1000, 1 << 20):
        got = trend.read_trend(spark, str(tmp_path), ["V_LN_a_min_V"], tolerant=True, split=split).drop("t_start", "t_end").collect()  # what only looks like a record has any time
        assert sorted((r.session_id, r.record_index, r.V_LN_a_min_V) for r in got) == sorted(want)
        assert sorted(tuple(r)[:5] for r in trend.scan_stats(spark, str(tmp_path), split=split).collect()) == sorted(counts)


def test_ranges_windows_and_pruning(spark, tmp_path):
    for k in (1, 2):
        put(tmp_path, synthetic(100), f"ES.00{k}")
    since, until = datetime(2023, 5, 4, 6, 0, 10), datetime(2023, 5, 4, 6, 0, 20)
    rows = trend.read_trend(spark, str(tmp_path), ["freq_avg_Hz"], since=since, until=until, split=30 * RECORD_BYTES)
    assert sorted((r.session_id, r.record_index) for r in rows.collect()) == [(f"ES.00{k}", i) for k in (1, 2) for i in range(10, 20)]
    reader = trend.PruningReader(["freq_avg_Hz"], {"path": str(tmp_path), "split": str(30 * RECORD_BYTES)})
    assert len(reader.partitions()) == 8
    assert list(reader.pushFilters([EqualTo(("session_id",), "ES.002"), EqualTo(("record_index",), 3)])) == [EqualTo(("record_index",), 3)]
    assert {p[0].split("/")[-2] for part in reader.partitions() for p in part.pieces} == {"ES.002"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert trend.read_trend(spark, str(tmp_path), ["freq_avg_Hz"]).where("session_id = 'ES.002' and record_index < 5").count() == 5
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    # a file of 3 GB (with holes, so that it takes no room) is many tasks; small files share one
    with (tmp_path / "large.bin").open("wb") as f:
        f.truncate(3 << 30)
    large = trend.TrendReader([], {"path": str(tmp_path / "large.bin")}).partitions()
    assert len(large) == -(-(3 << 30) // ranged.SPLIT) and all(p.pieces[0][2] % RECORD_BYTES == 0 for p in large)
    assert len(trend.TrendReader([], {"paths": json.dumps([str(tmp_path / "ES.001"), f"file:{tmp_path}/ES.00?"])}).partitions()) == 1
    with pytest.raises(FileNotFoundError):
        trend.TrendReader([], {"path": str(tmp_path / "none")}).partitions()


def test_peeks_are_one_job(spark, tmp_path):
    raw = synthetic(3)
    for k in range(400):
        put(tmp_path, raw[: RECORD_BYTES * (k % 4)] + b"x", f"P{k}")
    before = {j for j in spark.sparkContext.statusTracker().getJobIdsForGroup(None)}
    got = trend.first_last_times(spark, str(tmp_path)).collect()
    jobs = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)
    assert len(got) == 300 and {r.last_end.second for r in got} == {1, 2, 3} and jobs <= 4


def test_bundles_take_bounded_memory(spark, tmp_path):
    """A member ten times as large takes no more memory; records are cut across steps; both rules for members."""
    peaks = []
    for n in (10_000, 100_000):
        path = tmp_path / f"B{n}.fel"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("B/trend.bin", "w") as member:
            for _ in range(n // 1000):
                member.write(synthetic(1) * 1000)
        tracemalloc.start()
        with zipfile.ZipFile(path) as z, z.open("B/trend.bin") as member:
            assert sum(len(offsets) for _, offsets, _ in tables.unpacked(member, True, 1_000_003)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]
    with zipfile.ZipFile(tmp_path / "many.fel", "w") as z:
        for k, name in enumerate(("a/trend.bin", "b/c/trend.bin")):
            z.writestr(name, synthetic(k + 2) + b"tail")
        z.writestr("b/x-config.json", '{"asset_name": "last"}')
        z.writestr("a/a-config.json", "[not json")
    names = zipfile.ZipFile(tmp_path / "many.fel").namelist()
    assert tables.pick_trend(names) == "a/trend.bin" and tables.pick_trend(names, anywhere=True) == "b/c/trend.bin"
    assert tables.read_bundles(spark, str(tmp_path / "many.fel"), ["freq_avg_Hz"], anywhere=True).count() == 3
    assert tables.bundle_configs(spark, str(tmp_path / "many.fel")).first().asset_name == "last"
    assert tables.bundle_configs(spark, str(tmp_path / "many.fel"), anywhere=True).first().asset_name is None


def test_files_are_written_as_a_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"g{k % 3}/t.txt", k, f"{k}\n") for k in range(30)], "file string, seq long, content string").repartition(4)
    grouped.write_files(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["g0", "g1", "g2"]
    assert (tmp_path / "out/g1/t.txt").read_text() == "".join(f"{k}\n" for k in range(1, 30, 3))
    # a task that fails leaves nothing, and what was there stays
    bad = rows.select("file", "seq", F.when(F.col("seq") == 29, F.raise_error(F.lit("no"))).otherwise(F.lit("new\n")).alias("content"))
    for broken in (bad, rows.withColumn("file", F.concat(F.lit("../"), "file"))):
        with pytest.raises(Exception, match="no"):
            grouped.write_files(broken, str(tmp_path / "out"))
        assert (tmp_path / "out/g1/t.txt").read_text().startswith("1\n4\n") and not (tmp_path / "out/_attempts").exists()
    grouped.write_files(rows.where("file like 'g0%'"), str(tmp_path / "out"), overwrite=True)
    assert [p.name for p in (tmp_path / "out").rglob("*.txt")] == ["t.txt"]
    table = spark.createDataFrame([("a", 1.5, None, ["x", "y"]), ("b", math.nan, 2, None)], "k string, x double, n int, tags array<string>")
    grouped.write_files(grouped.lines(table, F.concat("k", F.lit(".tsv")), F.lit(0), "x", "n", "tags"), str(tmp_path / "t"))
    assert (tmp_path / "t/a.tsv").read_text() == "x\tn\ttags\n1.5\t\tx/y\n" and (tmp_path / "t/b.tsv").read_text() == "x\tn\ttags\nNaN\t2\t\n"


def test_clocks(spark):
    df = spark.sql("select timestamp_ntz'2024-01-13 15:00:00' t union all select timestamp_ntz'2024-07-13 15:00:00'")
    text = [r[0] for r in df.select(calendar.both_clocks(F.col("t"), "America/Chicago")).orderBy("t").collect()]
    assert text == ["2024-01-13T09:00:00-06:00 (2024-01-13T15:00:00+00:00)", "2024-07-13T10:00:00-05:00 (2024-07-13T15:00:00+00:00)"]
    assert df.where(calendar.utc(calendar.local(F.col("t"), "America/Chicago"), "America/Chicago") == F.col("t")).count() == 2
    assert calendar.known_zone("UTC") is None and calendar.known_zone("Europe/Berlin") == "Europe/Berlin"
    with pytest.raises(ValueError):
        calendar.known_zone("Nowhere/Here")


def test_channel_places():
    assert INDEX["V_LN_rolling_178_V"] == 178
