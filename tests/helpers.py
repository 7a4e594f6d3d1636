"""Planted sessions and comparison of results."""

import math
from datetime import datetime, timedelta

from gridlens.spec import CORE

BASE = datetime(2023, 5, 4, 6, 0)
HEALTHY = {"V_LN": 277.0, "I": 100.0, "freq": 60.0, "P": 50_000.0}


def session(spark, n, plant=(), base=BASE, step=1, name="s", **defaults):
    """n healthy records; ``plant`` has (first, last, {channel: value}) of records to change, both ends included."""
    rows = []
    for i in range(n):
        row = {c: next((v for k, v in HEALTHY.items() if c.startswith(k + "_") and "THD" not in c), 0.0) for c in CORE}
        row |= defaults
        for lo, hi, values in plant:
            if lo <= i <= hi:
                row |= {k: v(i) if callable(v) else v for k, v in values.items()}
        t = base + timedelta(seconds=i * step)
        rows.append((name, i, t, t + timedelta(seconds=1), *(float(row[c]) for c in CORE)))
    return spark.createDataFrame(rows, "session_id string, record_index long, t_start timestamp_ntz, t_end timestamp_ntz, " + ", ".join(f"{c} double" for c in CORE))


OUT = {f"V_LN_{p}_{s}_V": 0.0 for p in "abc" for s in ("min", "max", "avg")}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v if isinstance(v, (bool, int, str)) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)
