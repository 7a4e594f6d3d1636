"""Column expressions for electrical quantities. A channel that is null or NaN is never above or below anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# Fixed values of the ride-through curve: (longest duration in s, percent of nominal).
RIDE_LOW = [(0.001, 0.0), (0.003, 0.0), (0.02, 70.0), (0.5, 70.0), (10.0, 80.0), (INF, 90.0)]
RIDE_HIGH = [(0.001, 500.0), (0.0001, 500.0), (0.003, 200.0), (0.5, 120.0), (10.0, 110.0), (INF, 110.0)]


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < INF), F.lit(False))


def number(name: str) -> Column:
    """The channel as DOUBLE, null where it is NaN or infinite."""
    c = F.col(name).cast("double")
    return F.when(finite(c), c)


def above(c: Column, limit) -> Column:
    """c > limit, false for NaN and null."""
    return F.coalesce((c > limit) & ~F.isnan(c), F.lit(False))


def below(c: Column, limit) -> Column:
    """c < limit, false for NaN and null."""
    return F.coalesce((c < limit) & ~F.isnan(c), F.lit(False))


def phases(pattern: str) -> list[Column]:
    return [F.col(pattern.format(p)).cast("double") for p in "abc"]


def not_outage(limit: float = 50.0) -> Column:
    """All three phase voltages are above the limit."""
    a, b, c = (above(v, limit) for v in phases("V_LN_{}_avg_V"))
    return a & b & c


def imbalance_pct() -> Column:
    """Spread of the phase voltages in percent of their mean; 0 where the mean is 50 V or less."""
    v = phases("V_LN_{}_avg_V")
    mean = (v[0] + v[1] + v[2]) / 3.0
    return F.when(above(mean, 50.0), (F.greatest(*v) - F.least(*v)) / mean * 100.0).otherwise(0.0)


def mean_phase_current() -> Column:
    """Mean of the finite phase currents, 0 if none is."""
    i = phases("I_{}_avg_A")
    n = sum(F.when(finite(x), 1).otherwise(0) for x in i)
    total = sum(F.when(finite(x), x).otherwise(0.0) for x in i)
    return F.when(n > 0, total / n).otherwise(0.0)


def load_state(threshold_a: float = 50.0) -> Column:
    return F.when(mean_phase_current() >= threshold_a, "active").otherwise("standby")


def ride_through(residual_pct: Column, seconds: Column) -> Column:
    """prohibited, no_damage or no_interruption by residual voltage and duration."""
    seconds = F.greatest(seconds, F.lit(0.0))

    def limit(steps) -> Column:
        out = F.lit(steps[-1][1])
        for longest, pct in reversed(steps[:-1]):
            out = F.when(seconds <= longest, F.lit(pct)).otherwise(out)
        return out

    return F.when(residual_pct > limit(RIDE_HIGH), "prohibited").when(residual_pct < limit(RIDE_LOW), "no_damage").otherwise("no_interruption")


def residual_pct(nominal: Column) -> Column:
    """Residual voltage of a dip, swell or outage event in percent of nominal; null for other kinds."""
    return (
        F.when(F.col("kind").isin("dip", "swell"), F.col("severity") * 100.0)
        .when(F.col("kind") == "outage", F.coalesce(F.try_divide(F.col("severity"), nominal) * 100.0, F.lit(0.0)))
    )


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, as DOUBLE."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(b) - micros(a)) / F.lit(1e6)
