"""Row sequences at scale: neighbours, runs and rolling sums of a session without sorting it in one task.

A session's rows are ordered by ``record_index``, which counts them without holes (``renumber`` makes it so). The operators cut
sessions into chunks of ``CHUNK`` rows; what needs rows beyond a chunk's edge gets copies of them, and runs that touch
an edge are merged afterwards, when only runs are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16
SESSION, INDEX = "session_id", "record_index"


def per_session(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of one row per session, to be joined to records.

    Up to ``most`` rows are computed now, once, and joined by broadcast; more stay a plan, joined as the optimizer sees fit.
    """
    got = rows.limit(most + 1).toArrow()
    return rows if got.num_rows > most else F.broadcast(rows.sparkSession.createDataFrame(got))


def of_session(rows: DataFrame, **values: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """``rows`` with values of their whole session, each given as what a chunk's rows come to and what the chunks come to.

    They are joined by chunk: joined by session, all rows of a session would meet in one task.
    """
    at, session = F.floor(F.col(INDEX) / CHUNK).alias("_chunk"), Window.partitionBy(SESSION)
    parts = rows.groupBy(SESSION, at).agg(*[part.alias(name) for name, (part, _) in values.items()])
    parts = parts.select(SESSION, "_chunk", *[whole(name).over(session).alias(name) for name, (_, whole) in values.items()])
    return rows.withColumn("_chunk", at).join(parts, [SESSION, "_chunk"]).drop("_chunk")


def renumber(rows: DataFrame, keys: list[str] | None = None, order: str = INDEX, into: str = INDEX, span: int = CHUNK, ties: tuple[str, ...] = ()) -> DataFrame:
    """Number each key's rows 0, 1, 2, ... in the order of a LONG column (and ``ties``); a count per span of it, then places within spans."""
    keys = keys or [SESSION]
    rows = rows.withColumn("_span", F.floor(F.col(order) / span))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(order, *ties)) - 1
    return rows.withColumn("_place", place).join(offset, [*keys, "_span"]).withColumn(into, F.col("_before") + F.col("_place")).drop("_span", "_place", "_before")


def with_halo(rows: DataFrame, before: int, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with ``_chunk`` and ``_own``: each chunk also gets the ``before`` rows ahead of it and the ``after`` rows behind it."""
    chunk = max(chunk, before, after)
    at, c = F.col(INDEX) % chunk, F.floor(F.col(INDEX) / chunk)
    places = F.array_compact(F.array(c, F.when(at >= chunk - before, c + 1) if before else F.lit(None), F.when((at < after) & (c > 0), c - 1) if after else F.lit(None)))
    return rows.withColumn("_chunk", F.explode(places)).withColumn("_own", F.col("_chunk") == F.floor(F.col(INDEX) / chunk))


def halo_window(before: int | None = None, after: int | None = None, keys: tuple[str, ...] = (SESSION,)):
    w = Window.partitionBy(*keys, "_chunk").orderBy(INDEX)
    return w if before is None else w.rowsBetween(-before, after or 0)


def own(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop("_chunk", "_own")


def rolling_sums(rows: DataFrame, width: int, first: tuple[str, ...] = (), **values: Column) -> DataFrame:
    """Sums of the last ``width`` rows of each value (null before there are so many), by differences of running sums.

    ``first``: columns that get their value of the window's first row. Values must be finite. Running sums start anew in each chunk, so their size, and the rounding of a difference, is bounded.
    """
    rows = with_halo(rows, width)
    running, back = halo_window().rowsBetween(Window.unboundedPreceding, 0), halo_window()
    for name, value in values.items():
        rows = rows.withColumn(f"_{name}", F.sum(value).over(running))
    sums = {name: F.when(F.col(INDEX) >= width - 1, F.col(f"_{name}") - F.coalesce(F.lag(f"_{name}", width).over(back), F.lit(0.0))) for name in values}
    rows = rows.withColumns(sums | {c: F.lag(c, width - 1).over(back) for c in first if width > 1}).drop(*[f"_{name}" for name in values])
    return own(rows)


def islands(true_rows: DataFrame, gap: int = 0, keys: tuple[str, ...] = (SESSION,), chunk: int = CHUNK, **most: str) -> DataFrame:
    """Runs (``lo``, ``hi`` inclusive) of the indices in ``true_rows``; up to ``gap`` missing indices don't end a run. ``most``: maxima of columns by name."""
    cut = Window.partitionBy(*keys, "_chunk").orderBy(INDEX)
    rows = true_rows.select(*keys, INDEX, *most.values(), F.floor(F.col(INDEX) / chunk).alias("_chunk"))
    last = F.lag(INDEX).over(cut)
    rows = rows.withColumn("_new", F.when(last.isNull() | (F.col(INDEX) - last > gap + 1), 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_new").over(cut))
    parts = rows.groupBy(*keys, "_chunk", "_run").agg(F.min(INDEX).alias("lo"), F.max(INDEX).alias("hi"), *[F.max(c).alias(n) for n, c in most.items()])
    # only runs at a chunk's edge can go on in another; the others stay apart by chunk
    edge = (F.col("lo") % chunk <= gap) | (F.col("hi") % chunk >= chunk - 1 - gap)
    parts = parts.withColumn("_apart", F.when(edge, -1).otherwise(F.col("_chunk")))
    whole = Window.partitionBy(*keys, "_apart").orderBy("lo")
    last = F.lag("hi").over(whole)
    parts = parts.withColumn("_new", F.when(last.isNull() | (F.col("lo") - last > gap + 1), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(whole))
    return parts.groupBy(*keys, "_apart", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max(n).alias(n) for n in most]).drop("_apart", "_run")

