"""Events of a stream of records, as they end, with severity and phases: what ``detect_events`` finds, for limits that are given.

Each session has a state of bounded size: for each kind the run that is open (what its severity needs so far), and the last few rows, which short gaps
and load steps look back at. A run ends when more samples without it have come than a gap may have, or, if no more samples come, when the
watermark has passed its last row by ``idle``. Rows come in the order of ``record_index``, as a logger writes them; a row whose
number is not above the last one seen of its session is left out, as rows later than the watermark are.

What a whole session decides in batch (nominal voltage, limits of current, size of a load step) is an input, since a stream can't look ahead.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridlens.operators.events import _REDUCED, KINDS, READ, Chunk, severity_and_phases
from gridlens.operators.sequence import INDEX, SESSION
from gridlens.rules import EventRules

LIMITS = ["limit_a", "limit_b", "limit_c", "step_w", "nominal_v"]
HELD = "held BINARY"
_MERGED = {c: np.fmin if c.startswith("min") else np.fmax for c in _REDUCED if c != "swing"}


def _joined(a: dict, b: dict) -> dict:
    """Two parts of one run, ``a`` the earlier."""
    out = a | {"hi": b["hi"], "t_end": b["t_end"]} | {c: float(f(a[c], b[c])) for c, f in _MERGED.items()}
    further = np.isnan(a["swing"]) or abs(b["swing"]) > abs(a["swing"])  # of equal ones the first
    return out | {"swing": b["swing"] if further else a["swing"]}


class EventProcessor(StatefulProcessor):
    def __init__(self, rules: EventRules, kinds: tuple[str, ...], idle_ms: int):
        self.rules, self.kinds, self.idle = rules, kinds, idle_ms
        self.gap = int(rules.gap_tolerance_secs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("runs", HELD)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else {"open": {}, "tail": None, "due": None}
        new = pd.concat(list(rows)).drop_duplicates(INDEX).sort_values(INDEX)
        tail = held["tail"]
        if tail is not None:
            new = new[new[INDEX] > tail[INDEX].iloc[-1]]
        if not len(new):
            return
        whole = new if tail is None else pd.concat([tail, new])
        ended, held["open"] = self._follow(whole, 0 if tail is None else len(tail), held["open"])
        held["tail"] = whole.iloc[-max(1, self.gap + 1) :]
        if held["due"] is not None:
            self.handle.deleteTimer(held["due"])
        held["due"] = int(pd.Timestamp(whole["t_end"].iloc[-1]).value // 1_000_000) + self.idle
        self.handle.registerTimer(held["due"])
        self.state.update((pickle.dumps(held),))
        yield self._rows(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0])
        ended, held["open"], held["due"] = list(held["open"].values()), {}, None
        self.state.update((pickle.dumps(held),))
        yield self._rows(key, ended)

    def _follow(self, rows: pd.DataFrame, first: int, open_: dict) -> tuple[list[dict], dict]:
        """Runs that have ended, and those still open, after the rows from place ``first`` on; the rows before are known."""
        chunk = Chunk({c: rows[c].to_numpy(float) for c in READ}, rows[INDEX].to_numpy(), {c: float(rows[c].iloc[-1]) for c in LIMITS}, self.rules)
        index, start, end = chunk.index, rows["t_start"].to_numpy(), rows["t_end"].to_numpy()
        ended, left = [], {}

        def part(kind: str, phase: str, lo: int, hi: int, **more: float) -> dict:
            values = {c: float(v[0]) for c, v in chunk.reduced(kind, np.array([lo]), np.array([hi])).items()}
            return {"kind": kind, "phase": phase, "lo": int(index[lo]), "hi": int(index[hi]), "t_start": start[lo], "t_end": end[hi]} | values | more

        for (kind, phase), mask in chunk.masks().items():
            if kind not in self.kinds:
                continue
            run = open_.get((kind, phase))
            lo, hi = chunk.runs(np.where(np.arange(len(mask)) >= first, mask, False), self.gap, first, len(mask))
            parts = list(zip(lo.tolist(), hi.tolist(), strict=True))
            if run and parts and index[parts[0][0]] - run["hi"] <= self.gap + 1:
                # the rows of the gap are part of the run as well
                run = _joined(run, part(kind, phase, int(np.searchsorted(index, run["hi"], "right")), parts.pop(0)[1]))
            for a, b in parts:
                if run:
                    ended.append(run)
                run = part(kind, phase, a, b)
            if run and index[-1] - run["hi"] > self.gap:
                ended.append(run)
            elif run:
                left[kind, phase] = run
        if "power_step" in self.kinds:
            at, change = chunk.steps(max(1, first))
            ended += [part("power_step", "", k, k, change=float(c)) for k, c in zip(at.tolist(), change.tolist(), strict=True)]
        return ended, left

    def _rows(self, key, runs: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(runs, columns=["kind", "phase", "lo", "hi", "t_start", "t_end", *_REDUCED])
        out.insert(0, SESSION, [key[0]] * len(out))
        return out.astype({SESSION: object, "kind": object, "phase": object, "lo": "int64", "hi": "int64", "t_start": "datetime64[us]", "t_end": "datetime64[us]"} | {c: float for c in _REDUCED})


def stream_events(records: DataFrame, limits: DataFrame, rules: EventRules | None = None, kinds: tuple[str, ...] = KINDS, late: str = "10 minutes", idle: timedelta = timedelta(minutes=5)) -> DataFrame:
    """``session_id, kind, t_start, t_end, severity, affected_phases, record_index`` (of the first row) of each event, once it has ended.

    ``records`` is a stream with TIMESTAMP columns; ``limits`` a table with a row for each session: ``limit_a..c``, ``step_w``, ``nominal_v`` (see
    ``chunk_limits`` and ``nominal_voltage``). The session needs RocksDB as its state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rules = rules or EventRules()
    rows = records.select(SESSION, INDEX, "t_start", "t_end", *[F.col(c).cast("double").alias(c) for c in READ]).withWatermark("t_start", late)
    rows = rows.join(limits.select(F.col(SESSION).alias("_of"), *[F.col(c).cast("double").alias(c) for c in LIMITS]), F.col(SESSION) == F.col("_of")).drop("_of")
    kind_of = {f.name: f.dataType for f in records.schema}
    schema = T.StructType([T.StructField(SESSION, kind_of[SESSION]), T.StructField("kind", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("t_start", T.TimestampType()), T.StructField("t_end", T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in _REDUCED])
    processor = EventProcessor(rules, kinds, int(idle.total_seconds() * 1000))
    runs = rows.groupBy(SESSION).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    runs = runs.where((F.col("kind") == "power_step") | (F.col("hi") - F.col("lo") + 1 >= rules.min_duration_secs))
    # a NaN is nothing here, as in batch
    runs = runs.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in _REDUCED})
    return runs.select(SESSION, "kind", "t_start", "t_end", *severity_and_phases(rules), F.col("lo").alias(INDEX))
