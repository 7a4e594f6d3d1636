"""Thresholds and catalogues that the analyses take: event rules, finding rules, tariffs, shifts, periods."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields, replace
from datetime import timedelta
from pathlib import Path


# The keys of rules files and their defaults.
@dataclass(frozen=True)
class EventRules:
    outage_v_threshold: float = 50.0
    dip_pct_of_nominal: float = 0.90
    swell_pct_of_nominal: float = 1.10
    high_current_sigma: float = 2.0
    freq_excursion_hz: float = 0.5
    imbalance_pct_threshold: float = 2.5
    power_step_pct_of_mean: float = 0.50
    min_duration_secs: int = 1
    gap_tolerance_secs: int = 1
    nominal_freq_hz: float = 60.0


# Thresholds of the findings of a session.
@dataclass(frozen=True)
class FindingRules:
    outage_dip_window_secs: float = 30
    phase_asymmetry_pct: float = 2.0
    pf_drift_threshold: float = 0.85
    pf_drift_min_fraction: float = 0.10
    imbalance_sustained_pct: float = 1.5
    imbalance_sustained_secs: int = 60
    freq_stiffness_hz: float = 0.05
    freq_stiffness_min_count: int = 3
    outage_frequency_per_day: float = 1.0
    current_to_mean_ratio_alert: float = 5.0
    breaker_rating_a: float | None = None


# Thresholds of the findings across sessions.
@dataclass(frozen=True)
class CompareRules:
    voltage_drift_v_per_day: float = 0.1
    recurring_outage_window_mins: int = 15
    pf_degradation_min_r: float = 0.5
    pf_degradation_min_sessions: int = 3
    event_trend_min_r: float = 0.7
    event_trend_min_sessions: int = 3


def load_rules(path: str | Path, asset: str | None = None, base: EventRules | None = None) -> EventRules:
    """Rules of a JSON or TOML file over ``base``: flat, or ``defaults`` and then ``assets`` by name (else its ``default``)."""
    path = Path(path)
    found = tomllib.loads(path.read_text("utf-8")) if path.suffix == ".toml" else json.loads(path.read_text("utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path}: no table of rules")
    layers = [found]
    if found.keys() & {"defaults", "assets"}:
        assets = found.get("assets") or {}
        layers = [found.get("defaults"), assets.get(asset if asset in assets else "default")]
    rules, kinds = base or EventRules(), {f.name: f.type for f in fields(EventRules)}
    for layer in filter(None, layers):
        if unknown := layer.keys() - kinds.keys():
            raise ValueError(f"{path}: unknown rule {', '.join(sorted(unknown))}; known are {', '.join(sorted(kinds))}")
        rules = replace(rules, **{k: int(v) if kinds[k] == "int" else float(v) for k, v in layer.items()})
    return rules


def describe_overrides(rules: EventRules, base: EventRules | None = None) -> list[str]:
    base = base or EventRules()
    return [f"{f.name}: {getattr(base, f.name)} -> {getattr(rules, f.name)}" for f in fields(EventRules) if getattr(rules, f.name) != getattr(base, f.name)]


@dataclass(frozen=True)
class Tariff:
    """Rates per kWh; peak hours as (start, end) pairs, a pair of equal hours is empty, start > end goes past midnight."""

    currency: str = "USD"
    peak_rate: float = 0.20
    offpeak_rate: float = 0.10
    peak_hours: tuple[tuple[int, int], ...] = ((8, 20),)

    @classmethod
    def parse(cls, text: str, **more) -> Tariff:
        """Peak hours from ``8-12,17-21``."""
        pairs = []
        for part in filter(None, (x.strip() for x in text.split(","))):
            a, _, b = part.partition("-")
            pair = int(a), int(b)
            if not all(0 <= x <= 24 for x in pair):
                raise ValueError(f"no hours of a day: {part}")
            pairs.append(pair)
        return cls(peak_hours=tuple(pairs), **more)

    def peak_list(self) -> list[int]:
        """The hours of the day that are peak."""
        return [h for h in range(24) if any(a <= h < b if a < b else a != b and (h >= a or h < b) for a, b in self.peak_hours)]


def parse_hhmm(text: str) -> int:
    """``HH:MM`` as a minute of the day; 24:00 is 1440."""
    h, colon, m = text.strip().partition(":")
    if not colon:
        raise ValueError(f"not HH:MM: {text}")
    minute = int(h) * 60 + int(m)
    if not (0 <= minute <= 1440 and 0 <= int(m) < 60):
        raise ValueError(f"no time of day: {text}")
    return minute


def parse_window(text: str) -> tuple[int, int]:
    """``HH:MM-HH:MM`` as minutes of the day, half open; an end of 00:00 is the end of the day."""
    a, _, b = text.partition("-")
    start, end = parse_hhmm(a), parse_hhmm(b)
    return start, end or 1440


@dataclass(frozen=True)
class Shift:
    name: str
    start: int
    end: int

    @property
    def wraps(self) -> bool:
        return self.end <= self.start

    @property
    def minutes(self) -> int:
        return self.end - self.start + (1440 if self.wraps else 0)

    @property
    def window(self) -> str:
        return f"{self.start // 60:02d}:{self.start % 60:02d}-{self.end // 60:02d}:{self.end % 60:02d}"

    def holds(self, minute: int) -> bool:
        return self.start <= minute < self.end if not self.wraps else minute >= self.start or minute < self.end


@dataclass(frozen=True)
class ShiftSet:
    """Named minute-of-day windows in order; of windows that overlap the first takes the record."""

    shifts: tuple[Shift, ...] = field(default_factory=lambda: (Shift("day", 360, 1080), Shift("night", 1080, 360)))

    @classmethod
    def of(cls, rows: list[tuple[str, str, str]]) -> ShiftSet:
        shifts = tuple(Shift(n, parse_hhmm(a) % 1440, parse_hhmm(b) % 1440) for n, a, b in rows)
        if len({s.name for s in shifts}) != len(shifts):
            raise ValueError("two shifts have one name")
        if empty := [s.name for s in shifts if s.start == s.end]:
            raise ValueError(f"empty window: {', '.join(empty)}")
        return cls(shifts)

    @classmethod
    def parse(cls, text: str) -> ShiftSet:
        """``day=06:00-18:00,night=18:00-06:00``"""
        rows = []
        for part in filter(None, (x.strip() for x in text.split(","))):
            name, equals, window = part.partition("=")
            a, dash, b = window.partition("-")
            if not (equals and dash):
                raise ValueError(f"not name=HH:MM-HH:MM: {part}")
            rows.append((name.strip(), a, b))
        return cls.of(rows)

    def coverage(self) -> tuple[int, int]:
        """Minutes of the day that no shift holds, and that more than one holds."""
        held = [sum(s.holds(m) for s in self.shifts) for m in range(1440)]
        return held.count(0), sum(n > 1 for n in held)

    @classmethod
    def load(cls, path: str | Path) -> ShiftSet:
        found = json.loads(Path(path).read_text("utf-8"))
        return cls.of([(x["name"], x["start"], x["end"]) for x in (found["shifts"] if isinstance(found, dict) else found)])


@dataclass(frozen=True)
class Period:
    """What records are bucketed by: hour, day, week (7 days from the first midnight), or a number of seconds within the day."""

    kind: str
    seconds: int

    @classmethod
    def parse(cls, text: str) -> Period:
        named = {"hour": 3600, "day": 86_400, "week": 604_800}
        text = text.strip().lower()
        if text in named:
            return cls(text, named[text])
        unit = {"s": 1, "m": 60, "h": 3600, "d": 86_400}.get(text[-1:])
        if not unit or not text[:-1].isdigit() or int(text[:-1]) <= 0:
            raise ValueError(f"no period: {text}")
        return cls("duration", int(text[:-1]) * unit)

    def end(self, start):
        return start + timedelta(seconds=self.seconds)
