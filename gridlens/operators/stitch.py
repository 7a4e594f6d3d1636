"""Sessions as one: union in order of their starts, with provenance and gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.electrical import seconds_between
from gridlens.operators.sequence import INDEX, SESSION


def label_sessions(named: list[tuple[str, DataFrame]]) -> DataFrame:
    """Sessions in one table with ``session_id`` from their names; names that repeat get -2, -3."""
    seen: dict[str, int] = {}
    out = []
    for name, df in named:
        seen[name] = seen.get(name, 0) + 1
        out.append(df.withColumn(SESSION, F.lit(name if seen[name] == 1 else f"{name}-{seen[name]}")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


class MultiSession:
    """Sessions by label, in the order they came: add, remove, rename, and look at them together."""

    def __init__(self) -> None:
        self.of: dict[str, DataFrame] = {}

    def add(self, label: str, records: DataFrame) -> str:
        """The label that the session got: its own, or with the first of -2, -3, ... that is free."""
        name, k = label, 1
        while name in self.of:
            k += 1
            name = f"{label}-{k}"
        self.of[name] = records
        return name

    def remove(self, label: str) -> None:
        del self.of[label]

    def rename(self, label: str, new: str) -> None:
        """Raises ValueError if the new label is taken; the session keeps its place."""
        if new != label and new in self.of:
            raise ValueError(f"there is a session {new}")
        self.of = {new if name == label else name: df for name, df in self.of.items()}

    def records(self) -> DataFrame:
        return label_sessions(list(self.of.items()))

    def stitched(self) -> DataFrame:
        return stitch(self.records())


def sources(records: DataFrame) -> DataFrame:
    """Per session its place in the stitched order and its first and last row there (``hi`` not included); one row per session."""
    each = records.groupBy(SESSION).agg(F.min_by("t_start", INDEX).alias("first_start"), F.max_by("t_end", INDEX).alias("last_end"), F.count("*").alias("records"))
    w = Window.orderBy("first_start", SESSION)
    before = F.coalesce(F.sum("records").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select(F.col(SESSION).alias("source"), (F.row_number().over(w) - 1).alias("place"), "first_start", "last_end", "records", before.alias("lo"), (before + F.col("records")).alias("hi"))


def stitch(records: DataFrame) -> DataFrame:
    """One session of all: rows renumbered through, ``source`` says where they are from. Needs sessions numbered from 0."""
    spans = sources(records).select("source", "lo")
    out = records.withColumnRenamed(SESSION, "source").join(spans, "source").withColumn(INDEX, F.col("lo") + F.col(INDEX)).drop("lo")
    return out.withColumn(SESSION, F.lit(0))


def stitch_gaps(records: DataFrame, tolerance_s: float = 2.0) -> DataFrame:
    """Where a session doesn't start when the one before ends; overlaps have negative seconds."""
    w = Window.orderBy("place")
    rows = sources(records).withColumn("after", F.lag("source").over(w)).withColumn("gap_start", F.lag("last_end").over(w))
    rows = rows.withColumn("gap_s", seconds_between(F.col("gap_start"), F.col("first_start")))
    return rows.where(F.abs("gap_s") > tolerance_s).select("after", F.col("source").alias("before"), "gap_start", F.col("first_start").alias("gap_end"), "gap_s")
