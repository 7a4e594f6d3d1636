from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from gridlens.operators import events
from gridlens.rules import EventRules
from gridlens.streaming import events as live
from gridlens.streaming import rollups

from .helpers import OUT, session


def run(df, name, spark, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream(spark, rows, folder):
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("t_start", "t_end")})
    rows.where("record_index < 3000").coalesce(1).sortWithinPartitions("record_index").write.parquet(f"{folder}/in/a")
    rows.where("record_index >= 3000").coalesce(1).sortWithinPartitions("record_index").write.parquet(f"{folder}/in/b")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_buckets_close_with_the_watermark(spark, tmp_path):
    rows = session(spark, 6000, [(100, 109, OUT)])
    got = run(rollups.bucket_rollup(stream(spark, rows, tmp_path), "30 minutes", "1 minute"), "buckets", spark).orderBy("bucket_start").collect()
    assert [r.records for r in got] == [1800, 1800, 1800] and got[0].outage_records == 10


def test_events_end_with_a_gap(spark, tmp_path):
    rows = session(spark, 6000, [(100, 109, OUT), (200, 200, {"V_LN_a_min_V": 200.0})])
    got = run(rollups.run_events(stream(spark, rows, tmp_path), 277.0, late="1 minute"), "runs", spark).collect()
    assert sorted((r.kind, r.rows) for r in got) == [("dip", 1), ("outage", 10)]


def test_streamed_events_are_those_of_the_batch(spark, tmp_path):
    """Runs that cross batches, gaps at their edges, steps between them; the last run ends with the watermark."""
    rng = np.random.default_rng(5)
    plant = [(90, 94, {"V_LN_a_min_V": 200.0}), (96, 96, {"V_LN_a_min_V": 190.0, "V_LN_c_min_V": 210.0}), (198, 203, OUT), (205, 205, OUT), (299, 299, OUT), (300, 300, {"V_LN_b_max_V": 330.0}), (302, 304, {"V_LN_b_max_V": 340.0}), (420, 450, {"freq_avg_Hz": lambda i: 61.0 + i % 7}), (520, 521, {"I_c_max_A": 900.0}), (599, 601, {"V_LN_a_avg_V": 250.0})]
    parts = [session(spark, 700, [*plant, *[(int(k), int(k), {"P_total_avg_W": float(p)}) for k, p in zip(rng.integers(0, 600, 40), rng.normal(50_000, 40_000, 40))]], name=name) for name in ("x", "y")]
    rows = parts[0].unionByName(parts[1]).withColumns({c: F.col(c).cast("timestamp") for c in ("t_start", "t_end")})
    later = session(spark, 3, base=datetime(2023, 5, 5), name="x").withColumn("record_index", F.col("record_index") + 100_000).withColumns({c: F.col(c).cast("timestamp") for c in ("t_start", "t_end")})
    for k, (a, b) in enumerate([(0, 100), (100, 200), (200, 300), (300, 301), (301, 700)]):
        rows.where(f"record_index >= {a} and record_index < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in (5, 6):
        later.where(f"record_index {'<' if k == 5 else '>='} 100002").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rules = EventRules(gap_tolerance_secs=2)
    limits = events.baselines(rows, rules).join(events.nominal_voltage(rows), "session_id")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream_ = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        got = run(live.stream_events(stream_, spark.createDataFrame(limits.toArrow()), rules, late="1 minute"), "live", spark).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = events.detect_events(rows, limits.select("session_id", "nominal_v"), rules).collect()
    plain = lambda found: sorted((r.session_id, r.kind, str(r.t_start), str(r.t_end), round(r.severity, 9), tuple(r.affected_phases)) for r in found if r.t_start < datetime(2023, 5, 5))
    assert plain(got) == plain(want) and len({r.kind for r in want}) == 7
