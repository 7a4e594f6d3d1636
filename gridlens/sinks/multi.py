"""One pass over the records, many sinks.

``export_all`` writes the full export, the one-minute sample and the full-resolution store from one scan, and counts in it what a caller wants to know of
it. Each task writes a part of each sink; parts of all tasks appear together, once all are done (see ``grouped``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from gridlens.functions.electrical import finite
from gridlens.operators.filters import stride_for
from gridlens.operators.sequence import INDEX
from gridlens.sinks.files import ISO, export_frame
from gridlens.sinks.grouped import ATTEMPTS, GroupedWriter, Written
from gridlens.sources.ranged import store_of
from gridlens.spec import CHANNELS, CORE

MINUTE = 60
FULL, SAMPLE, STORE = "session.csv", "session_1min.csv", "store"


class ExportWriter(GroupedWriter):
    """Rows of (_line, _full, _sample, the store's columns); ``header`` is the first line of each text part."""

    def __init__(self, path: str, overwrite: bool, header: str):
        super().__init__(path, overwrite, uuid.uuid4().hex)
        self.header = header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = store_of(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        folder = f"{top}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}"
        files, streams, table = [], {}, None

        def stream(sink: str, ending: str):
            if sink not in streams:
                store.create_dir(f"{folder}/{sink}", recursive=True)
                files.append(f"{sink}/{name}{ending}")
                streams[sink] = store.open_output_stream(f"{folder}/{files[-1]}")
                if ending == ".csv":
                    streams[sink].write(self.header.encode())
            return streams[sink]

        try:
            for batch in iterator:
                for sink, flag in ((FULL, "_full"), (SAMPLE, "_sample")):
                    lines = batch.filter(batch.column(flag)).column("_line")
                    if len(lines):
                        stream(sink, ".csv").write("".join(lines.to_pylist()).encode())
                kept = batch.drop_columns(["_line", "_full", "_sample"])
                if kept.num_columns and kept.num_rows:
                    if table is None:
                        table = pq.ParquetWriter(stream(STORE, ".parquet"), kept.schema)
                    table.write_batch(kept)
        finally:
            if table is not None:
                table.close()
            for s in streams.values():
                s.close()
        return Written(folder, files)


class ExportSink(DataSource):
    """Options: ``path``, ``header``."""

    @classmethod
    def name(cls) -> str:
        return "session_export"

    def schema(self) -> str:
        return "_line string, _full boolean, _sample boolean"

    def writer(self, schema: T.StructType, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options["path"], overwrite, self.options["header"])


def csv_line(columns: list[str]) -> Column:
    """A row as Spark's CSV has it: nothing for nulls, quotes where a text needs them, a backslash before quotes."""
    cells = []
    for c in columns:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        cells.append(F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text))
    return F.concat(F.concat_ws(",", *cells), F.lit("\n"))


def export_all(records: DataFrame, path: str, every: int = 1, most: int | None = None, estimate: int | None = None, store: list[str] | None = None) -> dict[str, int]:
    """Write ``session.csv``, ``session_1min.csv`` and ``store`` (Parquet) under ``path``; returns what was counted.

    ``most`` rows at most in the full export, by a wider stride; how wide follows from ``estimate``, the number of records that the files' sizes
    give (``file_facts``), so no record is read for it. ``store``: the channels kept at full resolution.
    """
    spark = records.sparkSession
    if most:
        if estimate is None:
            raise ValueError("a limit needs an estimate of the records: the files' sizes give one (file_facts)")
        every = stride_for(estimate, every, most)
    text = export_frame(records).columns
    channels = [c for c in CHANNELS.values() if c in records.columns]
    kept = [c for c in ("session_id", INDEX, "t_start", "t_end") if c in records.columns] + [c for c in (CORE if store is None else store) if c in records.columns]
    odd = F.lit(False)
    for c in channels:
        odd = odd | ~finite(F.col(c).cast("double"))
    full, sample = F.col(INDEX) % every == 0, F.col(INDEX) % MINUTE == 0
    seen = Observation()
    counted = records.observe(
        seen, F.count("*").alias("records"), F.count_if(odd).alias("nonfinite"), F.count_if(full).alias("exported"), F.count_if(sample).alias("sampled"), F.min(F.unix_micros(F.col("t_start").cast("timestamp"))).alias("first_us"), F.max(F.unix_micros(F.col("t_end").cast("timestamp"))).alias("last_us")
    )
    stamp = lambda c: F.date_format(F.col(c).cast("timestamp"), ISO)
    frame = counted.withColumns({"timestamp_utc": stamp("t_start"), "window_end_utc": stamp("t_end")})
    rows = frame.select(F.when(full | sample, csv_line(text)).otherwise("").alias("_line"), full.alias("_full"), sample.alias("_sample"), *kept)
    spark.dataSource.register(ExportSink)
    rows.write.format("session_export").option("path", path).option("header", ",".join(text) + "\n").mode("overwrite").save()
    return {**seen.get, "stride": every}
