import json

import pytest

from gridlens.operators.events import parse_ids
from gridlens.operators.filters import format_range, parse_range, stride_for
from gridlens.rules import EventRules, Period, Shift, ShiftSet, Tariff, describe_overrides, load_rules, parse_window
from gridlens.spec import CHANNELS, CORE, INDEX, parse_phases, reversed_channels


def test_layout():
    assert len(CHANNELS) == 174 and set(range(180)) - set(CHANNELS) == set(range(164, 170))
    assert [INDEX[n] for n in ("V_LN_a_min_V", "V_LL_ca_avg_V", "I_c_avg_A", "freq_min_Hz", "P_total_avg_W", "PF_a_min", "DPF_total_avg", "Wh_a", "VARh_total", "V_LN_rolling_all_V", "I_rolling_179_A")] == [0, 17, 26, 45, 59, 120, 143, 144, 155, 170, 179]
    assert set(CORE) <= set(INDEX)
    assert len(reversed_channels("all")) == 80 and parse_phases("c, a") == ["a", "c"] and reversed_channels(None) == []
    with pytest.raises(ValueError):
        parse_phases("a,d")


def test_rules_files(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"defaults": {"dip_pct_of_nominal": 0.92}, "assets": {"P1": {"outage_v_threshold": 60, "gap_tolerance_secs": 4.0}, "bare": {}, "default": {"freq_excursion_hz": 0.4}}}))
    rules = load_rules(tmp_path / "r.json", "P1")
    assert rules == EventRules(dip_pct_of_nominal=0.92, outage_v_threshold=60.0, gap_tolerance_secs=4) and isinstance(rules.gap_tolerance_secs, int) and isinstance(rules.outage_v_threshold, float)
    assert load_rules(tmp_path / "r.json", "other") == load_rules(tmp_path / "r.json") == EventRules(dip_pct_of_nominal=0.92, freq_excursion_hz=0.4)
    assert load_rules(tmp_path / "r.json", "bare") == EventRules(dip_pct_of_nominal=0.92)
    (tmp_path / "r.toml").write_text('[defaults]\ndip_pct_of_nominal = 0.92\n[assets."P1"]\nswell_pct_of_nominal = 1.08\n')
    assert load_rules(tmp_path / "r.toml", "P1") == EventRules(dip_pct_of_nominal=0.92, swell_pct_of_nominal=1.08)
    (tmp_path / "flat.toml").write_text("high_current_sigma = 3\nmin_duration_secs = 2\n")
    assert describe_overrides(load_rules(tmp_path / "flat.toml")) == ["high_current_sigma: 2.0 -> 3.0", "min_duration_secs: 1 -> 2"]
    for name, text in (("bad.json", '{"nope": 1}'), ("list.json", "[1]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            load_rules(tmp_path / name)


def test_shifts(spark, tmp_path):
    assert Shift("n", 1080, 360).wraps and Shift("n", 1080, 360).minutes == 720 and Shift("n", 1080, 360).window == "18:00-06:00"
    (tmp_path / "s.json").write_text(json.dumps([{"name": "a", "start": "00:00", "end": "12:00"}]))
    assert ShiftSet.load(tmp_path / "s.json").shifts == (Shift("a", 0, 720),)
    assert ShiftSet().coverage() == (0, 0)
    for bad in ("a=00:00-12:00,a=12:00-00:00", "a=10:00-10:00", "a", "a=9-10:00"):
        with pytest.raises(ValueError):
            ShiftSet.parse(bad)


def test_periods_windows_tariffs():
    assert [Period.parse(x).seconds for x in ("hour", "day", "week", "90m", "2d", "15s")] == [3600, 86_400, 604_800, 5400, 172_800, 15]
    for bad in ("", "x", "0m", "1.5h"):
        with pytest.raises(ValueError):
            Period.parse(bad)
    assert parse_window("00:00-24:00") == parse_window("00:00-00:00") == (0, 1440)
    assert Tariff.parse("22-2,8-8").peak_list() == [0, 1, 22, 23]


def test_ids_ranges_strides():
    assert parse_ids("1-3,7", {1, 2, 7, 9}) == [1, 2, 7] and parse_ids("none") == [] and parse_ids("x") is None and parse_ids("all", {2, 1}) == [1, 2]
    a, b = parse_range("#t=2024-01-01T00:00:00Z/2024-01-02T00:00:00+00:00")
    assert parse_range(format_range(a, b)) == (a, b)
    assert parse_range("#t=2024-01-02/2024-01-01") is None and parse_range("junk") is None and parse_range(None) is None
    assert stride_for(100, 1, 30) == 4 and stride_for(100, 5, 30) == 5 and stride_for(100, 2, None) == 2
