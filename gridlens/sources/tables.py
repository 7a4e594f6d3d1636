"""CSV sessions, marks, session bundles and configuration."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.operators.sequence import renumber
from gridlens.sources.ranged import STEP, files, last_start, reachable, record_starts, store_of
from gridlens.sources.trend import _all_magic, _known, _schema, decode, read_trend, session_name
from gridlens.spec import INDEX, RECORD_BYTES


#: Bytes asked of a packed member at a time.
PART = 1 << 16


class NoSession(ValueError):
    """A table or bundle holds no session."""


def read_csv_session(spark: SparkSession, path: str, session: str | None = None, strict: bool = False) -> DataFrame:
    """A session exported as CSV; columns are taken by name, any subset of the channels.

    A column ``session_id`` of the table names the sessions, unless ``session`` does; without either it is the path's name. Cells that are missing or no numbers are 0 (with ``strict``, values that aren't finite too). Rows without a readable start are
    left out and their numbers stay unused; a missing end is a second later; times without a zone are UTC.
    """
    rows = spark.read.option("header", True).csv(path)
    known = [c for c in rows.columns if c in INDEX]
    if strict and ("timestamp_utc" not in rows.columns or not known):
        raise NoSession("the table needs timestamp_utc and a channel")
    if "record_index" in rows.columns:
        number = F.col("record_index").try_cast("long")
    else:
        number = F.monotonically_increasing_id()
    cell = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0))
    if strict:
        cell = lambda c, plain=cell: F.when(F.abs(plain(c)) < float("inf"), plain(c)).otherwise(0.0)
    start = F.try_to_timestamp("timestamp_utc")
    end = F.try_to_timestamp("window_end_utc") if "window_end_utc" in rows.columns else F.lit(None).cast("timestamp")
    named = F.col("session_id") if session is None and "session_id" in rows.columns else F.lit(session or session_name(path))
    out = rows.select(named.alias("session_id"), number.alias("record_index"), start.alias("t_start"), F.coalesce(end, start + F.expr("interval 1 second")).alias("t_end"), *[cell(c).cast("float").alias(c) for c in known])
    if "record_index" not in rows.columns:
        out = renumber(out, span=1 << 33)  # row numbers before rows are left out, so those leave holes
    return out.where(F.col("t_start").isNotNull())


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """``time, label`` of a CSV with a column ``time`` or ``timestamp``; rows without a readable time are left out."""
    rows = spark.read.option("header", True).csv(path)
    name = "time" if "time" in rows.columns else "timestamp"
    return rows.select(F.try_to_timestamp(name).alias("time"), F.coalesce(F.col("label"), F.lit("")).alias("label")).where(F.col("time").isNotNull())


def parse_marks(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Marks written as ``ISO=LABEL``."""
    rows = [(t.partition("=")[0].strip(), t.partition("=")[2].strip()) for t in texts if "=" in t]
    return spark.createDataFrame(rows, "time string, label string").select(F.try_to_timestamp("time").alias("time"), "label").where(F.col("time").isNotNull())


def pick_trend(names: list[str], anywhere: bool = False) -> str:
    """The member of a bundle that holds the records: at its root, or in its one folder (that has it); ``anywhere``: the last of any folder."""
    found = [n for n in names if PurePosixPath(n).name == "trend.bin"]
    if anywhere and found:
        return found[-1]
    if "trend.bin" in found:
        return "trend.bin"
    top = [n for n in found if len(PurePosixPath(n).parts) == 2]
    if len(top) != 1:
        raise NoSession("the bundle has no session, or more than one")
    return top[0]


def bundle_config(bundle: zipfile.ZipFile, anywhere: bool = False) -> dict:
    """The bundle's configuration, of the last name in order (``anywhere``: of the last member); empty if there is none that can be read."""
    names = [n for n in bundle.namelist() if n.endswith("-config.json")]
    try:
        found = json.loads(bundle.read(names[-1] if anywhere else max(names))) if names else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[str, zipfile.ZipFile]]:
    """The bundles of a batch by path: read in ranges (directory, then members in steps), or from their content where Spark has read it."""
    for k, path in enumerate(batch.column("path").to_pylist()):
        if "content" in batch.schema.names:
            stream = io.BytesIO(batch.column("content")[k].as_py())
        else:
            store, there = store_of(path)
            stream = store.open_input_file(there)
        with stream, zipfile.ZipFile(stream) as bundle:
            yield path, bundle


def _bundles(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """A bundle for each row, dealt to tasks; its content only where tasks can't open it."""
    found = files(spark, path, pattern)
    return found.select("path").repartition("path") if reachable(path) else found.select("path", "content")


def read_bundles(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, tolerant: bool = True, pattern: str = "*.fel", anywhere: bool = False) -> DataFrame:
    """Records of zipped sessions, with ``session_id`` after the bundle.

    A bundle is one task, as a packed member can't be entered in its middle; the member is unpacked in steps, and a step ends where a record may
    go on in the next, so memory doesn't grow with it. ``anywhere``: the last ``trend.bin`` of any folder.
    """
    columns = _known(columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, bundle in _opened(batch):
                with bundle.open(pick_trend(bundle.namelist(), anywhere)) as member:
                    for raw, offsets, first in unpacked(member, tolerant):
                        yield decode(raw, offsets, first, session_name(path), columns)

    return _bundles(spark, path, pattern).mapInArrow(task, _schema(columns))


def unpacked(member, tolerant: bool, step: int | None = None) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """(bytes, places of records in them, number of the first) of a stream that can't be entered in its middle."""
    rest, first = b"", 0
    while True:
        # small reads, joined once: what a member's own buffer holds on top of a step stays small
        parts, left = [rest], step or STEP
        while left and (more := member.read(min(left, PART))):
            parts.append(more)
            left -= len(more)
        more, rest = len(parts) > 1, b"".join(parts)
        del parts
        stop = last_start(len(rest))
        if tolerant:
            offsets, at = record_starts(rest, stop)
        else:
            offsets = np.arange(len(rest) // RECORD_BYTES) * RECORD_BYTES
            at = len(offsets) * RECORD_BYTES
            _all_magic(rest, offsets, first)
        yield rest, offsets, first
        first, rest = first + len(offsets), rest[at:]
        if not more:
            return


def read_configs(spark: SparkSession, path: str, pattern: str = "*-config.json") -> DataFrame:
    """``session_id`` (the folder) and what reports name, of the configurations under a path: of a folder's own name, else the first."""
    names = ["asset_name", "team_name", "type", "firmware_version"]
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("multiLine", True).schema(", ".join(f"{n} string" for n in names)).json(path)
    parts = F.split(F.input_file_name(), "/")
    rows = rows.select(F.element_at(parts, -2).alias("session_id"), F.element_at(parts, -1).alias("_file"), *names)
    best = F.min(F.struct((F.col("_file") != F.concat("session_id", F.lit("-config.json"))).alias("other"), "_file", *names))
    return rows.groupBy("session_id").agg(best.alias("b")).select("session_id", *[f"b.{n}" for n in names])


def open_session(spark: SparkSession, path: str, columns: list[str] | None = None, tolerant: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records and configuration of a session by its path: a CSV, a bundle (``.fel``), or a folder with a ``trend.bin``.

    Raises ``NoSession`` where the path is none of these, and ``FileNotFoundError`` where there is nothing.
    """
    none = spark.createDataFrame([], "session_id string, asset_name string, team_name string, type string, firmware_version string")
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(there):
        raise FileNotFoundError(path)
    if path.endswith(".csv"):
        return read_csv_session(spark, path), none
    if fs.isDirectory(there):
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(there, "trend.bin")):
            raise NoSession(f"{path} has no trend.bin")
        return read_trend(spark, path, columns, tolerant, "trend.bin"), read_configs(spark, path)
    if path.lower().endswith(".fel"):
        return read_bundles(spark, path, columns, tolerant), bundle_configs(spark, path)
    if path.endswith(".bin"):
        return read_trend(spark, path, columns, tolerant), none
    raise NoSession(f"{path} is neither a session's folder nor a bundle")


def bundle_configs(spark: SparkSession, path: str, pattern: str = "*.fel", anywhere: bool = False) -> DataFrame:
    """``session_id`` and what reports name, of the configurations in bundles; nulls where a bundle has none that can be read."""
    names = ["asset_name", "team_name", "type", "firmware_version"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, bundle in _opened(batch):
                found = bundle_config(bundle, anywhere)
                values = [found.get(n) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([session_name(path)]), *(pa.array([None if v is None else str(v)], pa.string()) for v in values)], ["session_id", *names])

    return _bundles(spark, path, pattern).mapInArrow(task, "session_id string, " + ", ".join(f"{n} string" for n in names))
