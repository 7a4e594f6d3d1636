"""Events against events and marks: nearest event, outage surroundings, load steps against frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.electrical import seconds_between
from gridlens.operators.sequence import INDEX, SESSION, halo_window, own, with_halo


def nearest_events(marks: DataFrame, events: DataFrame, slot_s: int = 3600) -> DataFrame:
    """Each mark (``time, label``) with the event whose start is nearest, the first of equally near ones, and ``offset_secs``, mark less event.

    Marks and events are put in one order of time, slot by slot; the last event at or before a mark and the first after it are its
    candidates. Where a slot has none, the last of the slots before and the first of those after stand in: those come from one
    row per slot. A mark stays without an event where there is none. Marks may carry ``session_id``.
    """
    keys = [SESSION] if SESSION in marks.columns else []
    slot = lambda: F.floor(F.unix_micros(F.col("at").cast("timestamp")) / F.lit(slot_s * 1_000_000))
    kind = "struct<id:int,kind:string>"
    starts = events.groupBy(*keys, F.col("t_start").alias("at")).agg(F.min(F.struct("id", "kind")).alias("e"))
    starts = starts.select(*keys, "at", F.struct(F.col("e.id").cast("int").alias("id"), "e.kind").cast(kind).alias("e"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("mark"), slot().alias("_slot"))
    asked = marks.select(*keys, F.col("time").alias("at"), F.lit(None).cast(kind).alias("e"), "label", F.lit(1).alias("mark"), slot().alias("_slot"))
    event = F.when(F.col("mark") == 0, F.struct("at", "e"))
    both = starts.unionByName(asked)
    # one row per slot: its first and last event, and those of the slots around it
    slots = both.groupBy(*keys, "_slot").agg(F.min(event).alias("_first"), F.max(event).alias("_last"))
    # what comes after is what came before in the opposite order: frames that end at the last row are gone through anew for every row
    line = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*keys, "_slot", F.last("_last", True).over(past(line.orderBy("_slot"))).alias("_prior"), F.last("_first", True).over(past(line.orderBy(F.desc("_slot")))).alias("_next"))
    w = Window.partitionBy(*keys, "_slot")
    rows = both.withColumn("before", F.last(event, True).over(w.orderBy("at", "mark"))).withColumn("after", F.last(event, True).over(past(w.orderBy(F.desc("at"), F.desc("mark")))))
    rows = rows.where("mark = 1").join(slots, [*keys, "_slot"]).withColumns({"before": F.coalesce("before", "_prior"), "after": F.coalesce("after", "_next")})
    gap = lambda c: seconds_between(F.col(f"{c}.at"), F.col("at"))
    later = F.col("after").isNotNull() & (F.col("before").isNull() | (F.abs(gap("after")) < F.abs(gap("before"))) | ((F.abs(gap("after")) == F.abs(gap("before"))) & (F.col("after.e.id") < F.col("before.e.id"))))
    out = rows.withColumn("near", F.when(later, F.col("after")).otherwise(F.col("before")))
    return out.select(*keys, F.col("at").alias("marker_time"), "label", F.col("near.e.id").alias("event_id"), F.col("near.e.kind").alias("event_kind"), F.col("near.at").alias("event_start"), seconds_between(F.col("near.at"), F.col("at")).alias("offset_secs"))


def outage_signatures(events: DataFrame, window_s: int = 30) -> DataFrame:
    """Each outage with the first leading dip, trailing over-current and trailing dip within the window, and its severity.

    One join on time slots as wide as the window: an outage meets only the events near it, each in the role it may have.
    """
    slot = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(window_s * 1_000_000))
    role = lambda name, at, *slots: F.struct(F.lit(name).alias("role"), F.col(at).alias("at"), *slots)
    here = lambda at: F.array(slot(F.col(at))).alias("slots")
    dip, inrush = F.array(role("lead", "t_end", here("t_end")), role("trail", "t_start", here("t_start"))), F.array(role("inrush", "t_start", here("t_start")))
    theirs = events.where("kind in ('dip', 'high_current')").select(SESSION, F.struct(F.col("id").alias("e"), F.col("severity").alias("sev"), F.array_join("affected_phases", "/").alias("ph")).alias("found"), F.explode(F.when(F.col("kind") == "dip", dip).otherwise(inrush)).alias("r"))
    theirs = theirs.select(SESSION, "found", "r.role", F.col("r.at").alias("edge"), F.explode("r.slots").alias("s"))
    start, end = slot(F.col("t_start")), slot(F.col("t_end"))
    asked = F.array(role("lead", "t_start", F.array(start - 1, start).alias("slots")), role("inrush", "t_end", F.array(end, end + 1).alias("slots")), role("trail", "t_end", F.array(end, end + 1).alias("slots")))
    mine = events.where("kind = 'outage'").select(SESSION, "id", "t_start", "t_end", F.explode(asked).alias("r"))
    mine = mine.select(SESSION, "id", "t_start", "t_end", "r.role", "r.at", F.explode("r.slots").alias("s"))
    gap = seconds_between(F.col("edge"), F.col("at"))
    near = F.when(F.col("role") == "lead", (gap >= 0) & (gap <= window_s)).otherwise((gap <= 0) & (gap >= -window_s))
    first = lambda name: F.min(F.when((F.col("role") == name) & near, F.col("found"))).alias(name)
    out = mine.join(theirs, [SESSION, "role", "s"], "left").groupBy(SESSION, "id", "t_start", "t_end").agg(first("lead"), first("inrush"), first("trail"))
    duration = F.floor(seconds_between(F.col("t_start"), F.col("t_end"))).cast("long")
    trail = F.when(F.col("trail.e").isNull() | (F.col("trail.e") == F.coalesce("lead.e", F.lit(-1))), None).otherwise(F.col("trail"))
    return out.select(
        SESSION, F.col("id").alias("outage_id"), "t_start", duration.alias("duration_s"), F.col("lead.e").alias("lead_dip_id"), F.col("lead.sev").alias("lead_dip_severity"), F.col("lead.ph").alias("lead_dip_phases"),
        F.col("inrush.e").alias("inrush_id"), F.col("inrush.sev").alias("inrush_a"), F.col("inrush.ph").alias("inrush_phase"), trail["e"].alias("trail_dip_id"), trail["ph"].alias("trail_dip_phases"), F.when(duration >= 60, "alert").otherwise("warn").alias("severity"),
    )


def steps_with_frequency(records: DataFrame, events: DataFrame, over_hz: float = 0.05, nominal_hz: float = 60.0) -> DataFrame:
    """Load steps within two rows of a frequency deviation over the limit; of rows that start together the last counts."""
    dev = F.abs(F.col("freq_avg_Hz").cast("double") - nominal_hz)
    rows = with_halo(records.select(SESSION, INDEX, "t_start", F.when(~F.isnan(dev), dev).alias("dev")), 2, 2)
    rows = own(rows.withColumn("max_dev_hz", F.max("dev").over(halo_window(2, 2))))
    last = rows.groupBy(SESSION, "t_start").agg(F.max_by("max_dev_hz", INDEX).alias("max_dev_hz"))
    steps = events.where("kind = 'power_step'").select(SESSION, "id", "t_start", "severity")
    return steps.join(last, [SESSION, "t_start"]).where(F.col("max_dev_hz") > over_hz)
