"""Event detection: outages, dips, swells, over-currents, frequency excursions, imbalance and load steps.

Six kinds are runs of rows for which a mask holds, with short gaps allowed; what an event reports is reduced over all rows of its
run, those in the gaps included. A load step is one event per row. Baselines (median voltage, mean and deviation of currents, mean
power) are per session and skip NaN.

Sessions are cut into chunks. One pass sums up each chunk; windows over these few rows make the limits of a session and leave
them with its chunks. A second pass brings each chunk's rows (and the few beyond its edges that gaps and steps look at) together with its limits
and reduces its runs, all kinds at once; the runs that touch an edge are put together across chunks. Nothing runs before the result is
asked for, and no task holds a session.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.electrical import above, below, imbalance_pct, not_outage, number, phases
from gridlens.operators.sequence import CHUNK, INDEX, SESSION, renumber, with_halo
from gridlens.rules import EventRules

KINDS = ("outage", "dip", "swell", "high_current", "freq_excursion", "imbalance_spike", "power_step")
COLUMNS = ["session_id", "id", "kind", "t_start", "t_end", "severity", "affected_phases"]
#: Bins of the median's counts.
BINS_A_VOLT = 256


def nominal_voltage(records: DataFrame, fallback: float | None = None) -> DataFrame:
    """``session_id, nominal_v``: exact median of all phase voltages over 50 V. A session without any gets ``fallback``, or no row.

    Values are counted by narrow bins; the bins' counts say which of them hold the two middle values, and only these are put in order.
    """
    v = records.select(SESSION, F.explode(F.array(*phases("V_LN_{}_avg_V"))).alias("v")).where(above(F.col("v"), 50.0))
    counts = v.groupBy(SESSION, F.floor(F.col("v") * BINS_A_VOLT).alias("_bin"), "v").agg(F.count("*").alias("n"))
    bins = counts.groupBy(SESSION, "_bin").agg(F.sum("n").alias("_n"), F.collect_list(F.struct("v", "n")).alias("_values"))
    session = Window.partitionBy(SESSION)
    bins = bins.withColumn("_to", F.sum("_n").over(session.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(session))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1  # the places of both middle values, from 1
    bins = bins.where((F.col("_to") >= low) & (F.col("_to") - F.col("_n") < high))
    none = F.lit(None).cast("double")
    start = F.struct((F.col("_to") - F.col("_n")).alias("to"), none.alias("low"), none.alias("high"))

    def step(held: Column, x: Column) -> Column:
        to = held["to"] + x["n"]
        return F.struct(to.alias("to"), F.coalesce(held["low"], F.when(to >= low, x["v"])).alias("low"), F.coalesce(held["high"], F.when(to >= high, x["v"])).alias("high"))

    middle = F.aggregate(F.array_sort("_values"), start, step)
    found = bins.select(SESSION, middle.alias("m")).groupBy(SESSION).agg(((F.min("m.low") + F.min("m.high")) / 2.0).alias("nominal_v"))
    if fallback is None:
        return found
    return records.select(SESSION).distinct().join(found, SESSION, "left").withColumn("nominal_v", F.coalesce("nominal_v", F.lit(float(fallback))))


def chunk_limits(records: DataFrame, rules: EventRules) -> DataFrame:
    """A row for each chunk of a session with the session's ``limit_a..c`` (null: none) and ``step_w``, the size of a load step."""
    on, session = not_outage(rules.outage_v_threshold), Window.partitionBy(SESSION)
    values = {p: F.when(on, number(f"I_{p}_max_A")) for p in "abc"} | {"w": F.when(on, F.abs(number("P_total_avg_W")))}
    parts = [f(v).alias(f"_{n}_{k}") for k, v in values.items() for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))]
    rows = records.groupBy(SESSION, F.floor(F.col(INDEX) / CHUNK).alias("_chunk")).agg(*parts)
    c = lambda n, k: F.col(f"_{n}_{k}")
    rows = rows.withColumns({f"_all_{k}": F.sum(c("n", k)).over(session) for k in values})
    rows = rows.withColumns({f"_avg_{k}": F.try_divide(F.sum(c("n", k) * c("mean", k)).over(session), c("all", k)) for k in values})
    out = []
    for p in "abc":
        gap = c("mean", p) - c("avg", p)
        sd = F.sqrt(F.try_divide(F.sum(c("n", p) * (c("var", p) + gap * gap)).over(session), c("all", p)))
        some = (c("all", p) >= 2) & (F.max(c("max", p)).over(session) > F.min(c("min", p)).over(session))
        out.append(F.when(some, c("avg", p) + rules.high_current_sigma * sd).alias(f"limit_{p}"))
    return rows.select(SESSION, "_chunk", *out, F.when(c("all", "w") >= 2, c("avg", "w") * rules.power_step_pct_of_mean).alias("step_w"))


def baselines(records: DataFrame, rules: EventRules) -> DataFrame:
    """Per session: limits of the phase currents (null: none) and the size of a load step."""
    return chunk_limits(records, rules).drop("_chunk").dropDuplicates([SESSION])


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def masks(rules: EventRules) -> dict[tuple[str, str], Column]:
    """(kind, phase) -> whether a prepared row belongs to it; the phase is '' where the event is of all."""
    low, high = F.col("nominal_v") * rules.dip_pct_of_nominal, F.col("nominal_v") * rules.swell_pct_of_nominal
    freq = F.col("freq_avg_Hz").cast("double")
    out = {
        ("outage", ""): ~F.col("on"),
        ("dip", ""): F.col("on") & _any([below(v, low) for v in phases("V_LN_{}_min_V")]),
        ("swell", ""): F.col("on") & _any([above(v, high) for v in phases("V_LN_{}_max_V")]),
    }
    for p in "abc":
        out["high_current", p] = F.col("on") & above(F.col(f"I_{p}_max_A").cast("double"), F.col(f"limit_{p}"))
    out["freq_excursion", ""] = F.col("on") & above(F.abs(freq - rules.nominal_freq_hz), rules.freq_excursion_hz)
    out["imbalance_spike", ""] = F.col("on") & above(imbalance_pct(), rules.imbalance_pct_threshold)
    return out


#: What a chunk's pass reads of a record.
READ = [f"V_LN_{p}_{stat}_V" for stat in ("min", "max", "avg") for p in "abc"] + [f"I_{p}_max_A" for p in "abc"] + ["freq_avg_Hz", "P_total_avg_W"]
_REDUCED = [*(f"min_{p}" for p in "abc"), *(f"max_{p}" for p in "abc"), *(f"amp_{p}" for p in "abc"), "swing", "spread", "change", "nominal_v"]


class Chunk:
    """The rows of a chunk in order, as arrays (nulls are NaN), and which of them belong to which kind."""

    def __init__(self, columns: dict[str, np.ndarray], index: np.ndarray, limits: dict[str, float], rules: EventRules):
        of = lambda name: np.stack([columns[name.format(p)] for p in "abc"])
        self.index, self.limits, self.rules = index, limits, rules
        self.low, self.high, self.amps, avg = of("V_LN_{}_min_V"), of("V_LN_{}_max_V"), of("I_{}_max_A"), of("V_LN_{}_avg_V")
        self.on = (avg > rules.outage_v_threshold).all(0)
        mean = (avg[0] + avg[1] + avg[2]) / 3.0
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = (avg.max(0) - avg.min(0)) / mean * 100.0
        self.spread = np.where(mean > 50.0, spread, 0.0)
        self.swing, self.power = columns["freq_avg_Hz"] - rules.nominal_freq_hz, columns["P_total_avg_W"]

    def masks(self) -> dict[tuple[str, str], np.ndarray]:
        """(kind, phase) -> which rows belong to it; NaN is never above or below anything. The phase is '' where the event is of all."""
        r, v = self.rules, self.limits["nominal_v"]
        out = {("outage", ""): ~self.on, ("dip", ""): self.on & (self.low < v * r.dip_pct_of_nominal).any(0), ("swell", ""): self.on & (self.high > v * r.swell_pct_of_nominal).any(0)}
        out |= {("high_current", p): self.on & (self.amps[k] > self.limits[f"limit_{p}"]) for k, p in enumerate("abc")}
        return out | {("freq_excursion", ""): self.on & (np.abs(self.swing) > r.freq_excursion_hz), ("imbalance_spike", ""): self.on & (self.spread > r.imbalance_pct_threshold)}

    def runs(self, mask: np.ndarray, gap: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the runs of a mask (gaps of up to ``gap`` rows are part of them), as far as they lie in first..end-1."""
        true = np.flatnonzero(mask)
        if not len(true):
            return true, true
        cut = np.flatnonzero(np.diff(self.index[true]) > gap + 1)
        lo, hi = true[np.concatenate(([0], cut + 1))], true[np.concatenate((cut, [len(true) - 1]))]
        lo, hi = np.maximum(lo, first), np.minimum(hi, end - 1)
        return lo[lo <= hi], hi[lo <= hi]

    def reduced(self, kind: str, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        """What events of the kind report, over the rows lo..hi (both included) of each run; NaN where there is nothing."""
        edges = np.stack((lo, hi + 1), 1).ravel()
        # reduceat takes what lies between runs as well: every other result is a run's
        over = lambda f, x: f.reduceat(np.append(x, x[-1:]), edges)[::2] if len(lo) else np.zeros(0)
        out = {name: np.full(len(lo), np.nan) for name in _REDUCED}
        if kind in ("outage", "dip"):
            out |= {f"min_{p}": over(np.fmin, self.low[k]) for k, p in enumerate("abc")}
        if kind == "swell":
            out |= {f"max_{p}": over(np.fmax, self.high[k]) for k, p in enumerate("abc")}
        if kind == "high_current":
            out |= {f"amp_{p}": over(np.fmax, self.amps[k]) for k, p in enumerate("abc")}
        if kind == "freq_excursion":
            size = np.abs(self.swing)
            most = over(np.fmax, size)
            out["swing"] = np.array([self.swing[a + int(np.argmax(size[a : b + 1] == m))] for a, b, m in zip(lo.tolist(), hi.tolist(), most, strict=True)], float)
        if kind == "imbalance_spike":
            out["spread"] = over(np.fmax, np.where(self.on, self.spread, np.nan))
        return out | {"nominal_v": np.full(len(lo), self.limits["nominal_v"])}

    def steps(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Places, from ``first`` on, of load steps against the row before, and their sizes."""
        if len(self.index) < 2:
            return np.zeros(0, np.int64), np.zeros(0)
        change = np.diff(self.power)
        hit = self.on[1:] & self.on[:-1] & (np.diff(self.index) == 1) & (np.abs(change) > self.limits["step_w"]) & (self.limits["step_w"] > 0)
        at = np.flatnonzero(hit) + 1
        at = at[at >= first]
        return at, change[at - 1]


def _chunk_runs(rules: EventRules, kinds: tuple[str, ...], names: list[str]):
    """Per chunk: rows with halo and its limits -> a row for each run, or part of one."""
    gap = int(rules.gap_tolerance_secs)

    def reduce(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[dict] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by(INDEX)
            number_of = lambda t, c: t.column(c).cast(pa.float64()).to_numpy()
            limits = {c: float(number_of(right, c)[0]) for c in ("limit_a", "limit_b", "limit_c", "step_w", "nominal_v")}
            index, own = left.column(INDEX).to_numpy(), left.column("_own").to_numpy()
            chunk = Chunk({c: number_of(left, c) for c in READ}, index, limits, rules)
            mine = np.flatnonzero(own)
            first, end = (int(mine[0]), int(mine[-1]) + 1) if len(mine) else (0, 0)
            for (kind, phase), mask in chunk.masks().items():
                if kind in kinds:
                    lo, hi = chunk.runs(mask, gap, first, end)
                    found.append({"kind": kind, "phase": phase, "lo": lo, "hi": hi} | chunk.reduced(kind, lo, hi))
            if "power_step" in kinds:
                at, change = chunk.steps(first)
                at, change = at[at < end], change[at < end]
                found.append({"kind": "power_step", "phase": "", "lo": at, "hi": at} | chunk.reduced("", at, at) | {"change": change})
        found = [f for f in found if len(f["lo"])]
        session = left.column(SESSION) if left.num_rows else right.column("_of")
        n = sum(len(f["lo"]) for f in found)
        lo, hi = (pa.array(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64)) for c in ("lo", "hi"))
        cols = [
            pa.array([session[0].as_py()] * n, session.type), pa.array(np.repeat([f["kind"] for f in found], [len(f["lo"]) for f in found]) if found else [], pa.string()), pa.array(np.repeat([f["phase"] for f in found], [len(f["lo"]) for f in found]) if found else [], pa.string()),
            left.column(INDEX).take(lo), left.column(INDEX).take(hi), left.column("t_start").take(lo), left.column("t_end").take(hi),
            *(pa.array(np.concatenate([f[c] for f in found]) if found else np.zeros(0), pa.float64(), from_pandas=True) for c in _REDUCED),
        ]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names)

    return reduce


def _runs(records: DataFrame, limits: DataFrame, rules: EventRules, kinds: tuple[str, ...]) -> DataFrame:
    """One row per run with what its severity needs; parts that end at a chunk's edge are put together."""
    gap = int(rules.gap_tolerance_secs)
    rows = with_halo(records.select(SESSION, INDEX, "t_start", "t_end", *[F.col(c).cast("double").alias(c) for c in READ]), max(1, gap), gap)
    kind_of = {f.name: f.dataType for f in records.schema}
    schema = T.StructType(
        [T.StructField(SESSION, kind_of[SESSION]), T.StructField("kind", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("finish", T.LongType()), T.StructField("t_start", kind_of["t_start"]), T.StructField("t_end", kind_of["t_end"])]
        + [T.StructField(c, T.DoubleType()) for c in _REDUCED]
    )
    limits = limits.withColumnsRenamed({SESSION: "_of", "_chunk": "_at"})
    parts = rows.groupBy(SESSION, "_chunk").cogroup(limits.groupBy("_of", "_at")).applyInArrow(_chunk_runs(rules, kinds, schema.names), schema)
    # only runs at edges can go on in another chunk; the others stay apart by chunk
    step = F.col("kind") == "power_step"
    edge = ~step & ((F.col("begin") % CHUNK <= gap) | (F.col("finish") % CHUNK >= CHUNK - 1 - gap))
    parts = parts.withColumn("_apart", F.when(edge, -1).otherwise(F.floor(F.col("begin") / CHUNK)))
    across = Window.partitionBy(SESSION, "kind", "phase", "_apart").orderBy("begin")
    last = F.lag("finish").over(across)
    parts = parts.withColumn("_new", F.when(step | last.isNull() | (F.col("begin") - last > gap + 1), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(across))
    values = {c: (F.min if c.startswith("min") else F.max)(c).alias(c) for c in _REDUCED if c != "swing"}
    swing = F.max(F.when(F.col("swing").isNotNull(), F.struct(F.abs("swing").alias("size"), (-F.col("begin")).alias("back"), F.col("swing").alias("by"))))["by"].alias("swing")
    edges = [F.min("begin").alias("lo"), F.max("finish").alias("hi"), F.min_by("t_start", "begin").alias("t_start"), F.max_by("t_end", "finish").alias("t_end")]
    return parts.groupBy(SESSION, "kind", "phase", "_apart", "_run").agg(*edges, *values.values(), swing).drop("_apart", "_run")


def severity_and_phases(rules: EventRules) -> tuple[Column, Column]:
    """``severity`` and ``affected_phases`` of runs that are reduced."""
    kind = F.col("kind")
    low, high = F.col("nominal_v") * rules.dip_pct_of_nominal, F.col("nominal_v") * rules.swell_pct_of_nominal
    dipped = [F.when(F.col(f"min_{p}") < low, F.col(f"min_{p}")) for p in "abc"]
    swelled = [F.when(F.col(f"max_{p}") > high, F.col(f"max_{p}")) for p in "abc"]
    severity = (
        F.when(kind == "outage", F.array_min(F.array(*[F.col(f"min_{p}") for p in "abc"])))
        .when(kind == "dip", F.array_min(F.array(*dipped)) / F.col("nominal_v"))
        .when(kind == "swell", F.array_max(F.array(*swelled)) / F.col("nominal_v"))
        .when(kind == "freq_excursion", F.col("swing"))
        .when(kind == "imbalance_spike", F.col("spread"))
        .when(kind == "power_step", F.col("change"))
    )
    for p in "abc":
        severity = F.when((kind == "high_current") & (F.col("phase") == p), F.col(f"amp_{p}")).otherwise(severity)
    named = lambda parts: F.array_compact(F.array(*[F.when(v.isNotNull(), p) for p, v in zip("abc", parts, strict=True)]))
    affected = (
        F.when(kind == "dip", named(dipped))
        .when(kind == "swell", named(swelled))
        .when(kind == "high_current", F.array("phase"))
        .when(kind == "freq_excursion", F.array().cast("array<string>"))
        .otherwise(F.array(*[F.lit(p) for p in "abc"]))
    )
    return severity.alias("severity"), affected.alias("affected_phases")


def numbered(events: DataFrame) -> DataFrame:
    """Ids from 0 within a session, by start, kind, phase and place; counted by days, so that no task sorts a session."""
    rows = events.withColumn("_us", F.unix_micros(F.col("t_start").cast("timestamp")))
    return renumber(rows, order="_us", into="id", span=86_400_000_000, ties=("kind", "phase", "lo")).withColumn("id", F.col("id").cast("int")).select(*COLUMNS)


def detect_events(records: DataFrame, nominal: DataFrame | float | None = None, rules: EventRules | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """All events of each session: ``session_id, id, kind, t_start, t_end, severity, affected_phases``."""
    rules = rules or EventRules()
    limits = chunk_limits(records, rules)
    if isinstance(nominal, (int, float)):
        limits = limits.withColumn("nominal_v", F.lit(float(nominal)))
    else:
        limits = limits.join(nominal_voltage(records) if nominal is None else nominal.select(SESSION, "nominal_v"), SESSION, "left")
    runs = _runs(records, limits, rules, kinds).where((F.col("kind") == "power_step") | (F.col("hi") - F.col("lo") + 1 >= rules.min_duration_secs))
    return numbered(runs.select(SESSION, "kind", "t_start", "t_end", *severity_and_phases(rules), "phase", "lo"))


def count_by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy(SESSION, "kind").agg(F.count("*").alias("n"))


def filter_events(events: DataFrame, ids: str | list[int]) -> DataFrame:
    """Events by id: a list, or text as ``parse_ids`` takes it."""
    if isinstance(ids, str):
        text = ids.strip().lower()
        if text == "all":
            return events
        ids = parse_ids(text)
    return events.where(F.col("id").isin(list(ids or [])))


def parse_ids(text: str, valid: set[int] | None = None) -> list[int] | None:
    """``1-4,7`` as ids, ``none`` as none of them; ``all`` needs the valid ones; anything unreadable is None."""
    text = text.strip().lower()
    if text in ("", "none"):
        return []
    if text == "all":
        return sorted(valid) if valid is not None else None
    found: set[int] = set()
    for part in text.split(","):
        a, dash, b = part.strip().partition("-")
        if not a.isdigit() or dash and not b.isdigit():
            return None
        found.update(range(int(a), int(b or a) + 1))
    return sorted(found & valid if valid is not None else found)


def event_window(events: DataFrame, records: DataFrame, before_s: int = 30, after_s: int = 60, slot_s: int = 300) -> DataFrame:
    """The records around each event (both edges included), with ``event_id``; a range join on time slots."""
    lo, hi = F.timestamp_add("SECOND", F.lit(-before_s), F.col("t_start")), F.timestamp_add("SECOND", F.lit(after_s), F.col("t_end"))
    slot = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(slot_s * 1_000_000))
    spans = events.select(SESSION, F.col("id").alias("event_id"), "kind", lo.alias("_lo"), hi.alias("_hi"))
    spans = spans.withColumn("_slot", F.explode(F.sequence(slot(F.col("_lo")), slot(F.col("_hi")))))
    rows = records.withColumn("_slot", slot(F.col("t_start")))
    return spans.join(rows, [SESSION, "_slot"]).where("t_start >= _lo and t_start <= _hi").drop("_slot", "_lo", "_hi")
