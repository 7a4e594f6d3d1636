"""Histogram sketches: the state of a distribution as a column, to be built once, stored, merged and asked for quantiles.

A sketch has for each bin of a fixed range that holds values their number, sum, sum of squares, lowest and highest. Sketches of parts merge
exactly: what is asked of the merged one is what one of all values would say. Values beyond the range count in the outer bins. A sketch
is a row of at most ``bins`` entries, whatever the number of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a sketch's bins lie; sketches of different ranges don't merge.
RANGE = ["lo", "width", "bins"]
_SUMS = {"n": F.sum, "s": F.sum, "q": F.sum, "l": F.min, "h": F.max}


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, range, histogram) of rows of (keys, range, bin, n, s, q, l, h)."""
    return rows.groupBy(*keys, *RANGE).agg(F.array_sort(F.collect_list(F.struct("bin", *_SUMS))).alias("histogram"))


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lo, width, bins, histogram`` of values (keys, v, lo, width, bins), which must not be NaN."""
    v = F.col("v")
    at = F.greatest(F.lit(0), F.least(F.floor((v - F.col("lo")) / F.col("width")), F.col("bins") - 1)).cast("int")
    n = F.count("*")
    # squares from each bin's own variance keep their digits
    square = n * (F.var_pop("v") + F.avg("v") * F.avg("v"))
    return _packed(values.groupBy(*keys, *RANGE, at.alias("bin")).agg(n.alias("n"), F.sum("v").alias("s"), square.alias("q"), F.min("v").alias("l"), F.max("v").alias("h")), keys)


def merged(sketches: DataFrame, *sets: list[str]) -> DataFrame:
    """Sketches put together by each set of keys (GROUPING SETS): keys that a row isn't grouped by are null."""
    every = list(dict.fromkeys(k for keys in sets for k in keys))
    rows = sketches.select(*every, *RANGE, F.explode("histogram").alias("x")).select(*every, *RANGE, "x.*")
    sums = [f(c).alias(c) for c, f in _SUMS.items()]
    if len(sets) == 1:
        return _packed(rows.groupBy(*every, *RANGE, "bin").agg(*sums), every)
    by = [*every, *RANGE, "bin"]
    rows = rows.groupingSets([[F.col(c) for c in [*keys, *RANGE, "bin"]] for keys in sets], *by).agg(F.grouping_id().alias("_set"), *sums)
    return _packed(rows, [*every, "_set"]).drop("_set")


def _total(name: str) -> Column:
    return F.aggregate(F.transform("histogram", lambda x: x[name]), F.lit(0).cast("long" if name == "n" else "double"), lambda a, x: a + x)


def _quantile(q: float) -> Column:
    """The midpoint of the first bin that reaches the share."""
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(None).cast("int").alias("bin"))
    step = lambda a, x: F.struct((a["to"] + x["n"]).alias("to"), F.coalesce(a["bin"], F.when(a["to"] + x["n"] >= F.lit(q) * F.col("_n"), x["bin"])).alias("bin"))
    return F.col("lo") + (F.aggregate("histogram", start, step)["bin"] + 0.5) * F.col("width")


def finished(sketches: DataFrame, **of: float) -> DataFrame:
    """The keys, and ``n, min, max, mean, stdev`` and the quantiles asked for by name."""
    keys = [c for c in sketches.columns if c not in (*RANGE, "histogram")]
    got = sketches.withColumns({"_n": _total("n"), "_s": _total("s"), "_q": _total("q")})
    mean = F.col("_s") / F.col("_n")
    stdev = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean))
    low, high = F.array_min(F.transform("histogram", lambda x: x["l"])), F.array_max(F.transform("histogram", lambda x: x["h"]))
    return got.select(*keys, F.col("_n").alias("n"), low.alias("min"), high.alias("max"), mean.alias("mean"), stdev.alias("stdev"), *[_quantile(q).alias(name) for name, q in of.items()])
