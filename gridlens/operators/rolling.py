"""Rolling windows over rows (a row is a second): peak demand, its series, rolling deviation, quiet windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.electrical import finite
from gridlens.operators.sequence import INDEX, SESSION, rolling_sums, with_halo


def _power(records: DataFrame):
    p = F.col("P_total_avg_W").cast("double")
    return records.select(SESSION, INDEX, "t_start", "t_end", F.when(finite(p), p).otherwise(0.0).alias("p"))


def demand(records: DataFrame, window: int = 900) -> DataFrame:
    """Every full window: ``session_id, record_index`` of its last row, ``demand_w, t_start, t_end``. What is not finite counts 0."""
    window = max(1, int(window))
    rows = rolling_sums(_power(records), window, first=("t_start",), s=F.col("p"))
    return rows.where(F.col("s").isNotNull()).select(SESSION, INDEX, (F.col("s") / window).alias("demand_w"), "t_start", "t_end")


def demand_peak(records: DataFrame, window: int = 900) -> DataFrame:
    """Per session the first of the highest windows, the mean of all and their number; zeros where no window is full."""
    d = demand(records, window)
    # sums that differ in the last bits are one: ties go to the first
    best = F.max(F.struct(F.round("demand_w", 6).alias("d"), (-F.col(INDEX)).alias("back"), "t_start", "t_end"))
    got = d.groupBy(SESSION).agg(best.alias("b"), F.avg("demand_w").alias("mean_demand_w"), F.count("*").alias("n_windows"))
    got = records.select(SESSION).distinct().join(got, SESSION, "left")
    return got.select(
        SESSION, F.lit(int(window)).alias("window_secs"), F.coalesce("b.d", F.lit(0.0)).alias("peak_demand_w"), (F.coalesce("b.d", F.lit(0.0)) / 1000.0).alias("peak_demand_kw"),
        F.col("b.t_start").alias("peak_window_start"), F.col("b.t_end").alias("peak_window_end"), F.coalesce("mean_demand_w", F.lit(0.0)).alias("mean_demand_w"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
    )


def demand_series(records: DataFrame, window: int = 900, step: int | None = None) -> DataFrame:
    """The demand at every ``step``-th full window (by default each window once)."""
    step = step or window
    return demand(records, window).where((F.col(INDEX) - (window - 1)) % step == 0).select(SESSION, F.col("t_end").alias("t"), "demand_w")


def rolling_stdev(records: DataFrame, window: int = 300, times: bool = False) -> DataFrame:
    """Population deviation (and mean) of power over the last ``window`` rows; null before, and all null for a window of 1.

    ``times``: with ``t_start`` of the window's first row and ``t_end`` of its last.
    """
    rows, kept = _power(records), ["t_start", "t_end"] if times else []
    if window <= 1:
        return rows.select(SESSION, INDEX, *kept, *[F.lit(None).cast("double").alias(c) for c in ("mean_w", "stdev_w")])
    kinds = {f.name: f.dataType for f in rows.schema}
    names = [SESSION, INDEX, *kept, "mean_w", "stdev_w"]

    def reduce(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(INDEX)
        mean, deviation = window_moments(chunk.column("p").to_numpy(), window)
        none = np.arange(chunk.num_rows) < window - 1
        got = [pa.array(x, pa.float64(), mask=none) for x in (mean, deviation)]
        if times:
            first = pa.array(np.maximum(np.arange(chunk.num_rows) - (window - 1), 0), mask=none)
            got = [chunk.column("t_start").take(first), chunk.column("t_end"), *got]
        return pa.Table.from_arrays([chunk.column(SESSION), chunk.column(INDEX), *got], names).filter(chunk.column("_own"))

    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in names])
    return with_halo(rows.select(SESSION, INDEX, *kept, "p"), window).groupBy(SESSION, "_chunk").applyInArrow(reduce, schema)


def window_moments(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the last ``width`` values at each place (of no meaning before there are so many).

    Values are cut into blocks of ``width``: a window is the end of one and the beginning of the next. Moments of both come from running sums of terms that
    are never negative, so nothing large is taken from something large, and the time doesn't depend on the width.
    """
    n = len(x)
    blocks = np.zeros(-(-n // width) * width)
    blocks[:n] = x
    blocks, k = blocks.reshape(-1, width), np.arange(1, width + 1)

    def running(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = b[:, :1] + np.cumsum(b - b[:, :1], 1) / k
        terms = np.zeros_like(b)
        terms[:, 1:] = (b[:, 1:] - mean[:, :-1]) * (b[:, 1:] - mean[:, 1:])
        return mean, np.cumsum(terms, 1)

    mean, squares = running(blocks)
    back_mean, back_squares = (a[:, ::-1] for a in running(blocks[:, ::-1]))
    rest = width - k[:-1]  # values of a window that lie in the block before
    gap = back_mean[:-1, 1:] - mean[1:, :-1]
    squares[1:, :-1] += back_squares[:-1, 1:] + gap * gap * (k[:-1] * rest / width)
    mean[1:, :-1] += gap * (rest / width)
    return mean.ravel()[:n], np.sqrt(np.maximum(squares.ravel()[:n], 0.0) / width)


def snapshot_candidates(records: DataFrame, events: DataFrame, window: int = 300) -> DataFrame:
    """Windows that no event touches (edges included): ``t_start, t_end, mean_w, stdev_w`` by their last row.

    Whether an event touches a window depends on rows only, so events mark rows and a rolling count finds windows without
    a mark; an event between two rows marks the later one.
    """
    wide = rolling_stdev(records, window, times=True).where(F.col("stdev_w").isNotNull()).withColumnRenamed("t_start", "w_start")
    hour = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(3_600_000_000))
    spans = events.select(SESSION, F.col("t_start").alias("e_start"), F.col("t_end").alias("e_end"))
    spans = spans.withColumn("_h", F.explode(F.sequence(hour(F.col("e_start")), hour(F.col("e_end")))))
    # an hour's events as one list would grow with them; disjoint unions of them do not
    w = Window.partitionBy(SESSION, "_h").orderBy("e_start", "e_end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_far", F.max("e_end").over(w)).withColumn("_new", F.when(F.col("_far").isNull() | (F.col("e_start") > F.col("_far")), 1).otherwise(0))
    spans = spans.withColumn("_g", F.sum("_new").over(Window.partitionBy(SESSION, "_h").orderBy("e_start", "e_end")))
    spans = spans.groupBy(SESSION, "_h", "_g").agg(F.min("e_start").alias("e_start"), F.max("e_end").alias("e_end"))
    asked = wide.withColumn("_h", F.explode(F.sequence(hour(F.col("w_start")), hour(F.col("t_end")))))
    touched = asked.join(spans, [SESSION, "_h"]).where("t_end >= e_start and w_start <= e_end").select(SESSION, INDEX).distinct()
    return wide.join(touched, [SESSION, INDEX], "left_anti").select(SESSION, INDEX, F.col("w_start").alias("t_start"), "t_end", "mean_w", "stdev_w")


def pick_snapshots(records: DataFrame, events: DataFrame, n: int = 3, window: int = 300, apart_s: int = 3600) -> DataFrame:
    """Up to ``n`` quiet windows a session, the quietest first, with centres at least ``apart_s`` seconds apart.

    Picks follow one another, but few candidates can be one. Time is cut into slots of ``apart_s``. A pick rules out centres in its own slot and in
    the two beside it only, so before the k-th pick at most 3 (k - 1) slots have lost any; of the 3 (k - 1) + 1 slots with the quietest
    windows one is whole, and nothing outside these is quieter than its best. So all picks lie in the 3 n - 2 slots with the quietest windows; only their
    candidates (a second has one window) come together, and the picks are made among them. Candidates are computed once.
    """
    if n < 1 or apart_s < 1:
        raise ValueError("a number of windows and a distance of at least 1 are needed")
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    # whole microseconds, cut towards the start, also where a clock was set back and the end comes first
    center = F.timestamp_add("MICROSECOND", F.call_function("div", micros(F.col("t_end")) - micros(F.col("t_start")), F.lit(2).cast("long")), F.col("t_start"))
    left = snapshot_candidates(records, events, window).withColumn("t_center", center).withColumns({"stdev_w": F.round("stdev_w", 6), "_us": micros(F.col("t_center"))})
    held = F.struct("stdev_w", INDEX, "_us", "t_start", "t_end", "t_center", "mean_w")
    slots = left.groupBy(SESSION, F.floor(F.col("_us") / (apart_s * 1_000_000)).alias("_slot")).agg(F.min(F.struct("stdev_w", INDEX)).alias("_best"), F.collect_list(held).alias("_held"))
    order = F.row_number().over(Window.partitionBy(SESSION).orderBy("_best"))
    few = slots.withColumn("_place", order).where(F.col("_place") <= 3 * n - 2)
    rows = few.select(SESSION, F.explode("_held").alias("x")).select(SESSION, "x.*")
    kinds = {f.name: f.dataType for f in rows.schema}
    names = [SESSION, "id", "t_start", "t_end", "t_center", "p_total_mean_w", "p_total_stdev_w"]
    types = [kinds[SESSION], T.IntegerType(), kinds["t_start"], kinds["t_end"], kinds["t_center"], T.DoubleType(), T.DoubleType()]

    def greedy(table: pa.Table) -> pa.Table:
        table = table.sort_by([("stdev_w", "ascending"), (INDEX, "ascending")])
        at, taken = table.column("_us").to_numpy(), []
        while len(taken) < n:
            free = np.flatnonzero(np.all([np.abs(at - at[k]) >= apart_s * 1_000_000 for k in taken], axis=0)) if taken else np.arange(len(at))
            if not len(free):
                break
            taken.append(int(free[0]))
        picks = table.take(pa.array(taken))
        cols = [picks.column(SESSION), pa.array(range(len(taken)), pa.int32()), *(picks.column(c) for c in ("t_start", "t_end", "t_center", "mean_w", "stdev_w"))]
        return pa.Table.from_arrays(cols, names)

    return rows.groupBy(SESSION).applyInArrow(greedy, T.StructType([T.StructField(c, t) for c, t in zip(names, types, strict=True)]))
