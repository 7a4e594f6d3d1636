"""Binary session files: records of 744 bytes, a 24-byte header and 180 float32 each.

``TrendSource`` is a data source (``spark.read.format("trend")``): files are cut into ranges of whole records, small ones share a
task, a task reads a step of a range at a time and decodes only the channels of the schema it is asked for. Sessions are pruned before
anything is read, and rows outside a time window before their channels are decoded.

Strict: a record with another magic number raises; a short tail ends the file. Tolerant: the scan steps on byte by byte to the next
magic number, each step counted, and a short tail and records with values that aren't finite are counted too. Ranges of damaged files are
scanned at once for every entry, and get the exact entry and record numbers by putting those together (``ranged.entered``).

Stores that tasks can't reach by themselves (``ranged.SCHEMES``) are read by Spark, a file a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from gridlens.sources import ranged
from gridlens.sources.ranged import BadMagic, files, last_start, reachable, record_starts, store_of
from gridlens.spec import CHANNELS, EPOCH_TICKS, FLOATS, HEADER_BYTES, INDEX, MAGIC, RECORD_BYTES

HEAD = ["session_id", "record_index", "t_start", "t_end"]
EVERY = list(CHANNELS.values())
STAMP = pa.timestamp("us", "UTC")


def good_offsets(raw: bytes, tolerant: bool) -> tuple[np.ndarray, dict[str, int]]:
    """Where the records of a whole file begin, and the counts of a scan."""
    size = len(raw)
    if not tolerant:
        n = size // RECORD_BYTES
        found = np.arange(n) * RECORD_BYTES
        _all_magic(raw, found, 0)
        at = n * RECORD_BYTES
    else:
        found, at = record_starts(raw, last_start(size))
    bad = at - RECORD_BYTES * len(found)
    return found, {"total_seen": len(found) + bad, "good": len(found), "bad_magic": bad, "truncated": int(at < size)}


def _all_magic(raw: bytes, offsets: np.ndarray, first: int) -> None:
    heads = np.frombuffer(raw, np.uint8)[offsets[:, None] + np.arange(len(MAGIC))]
    healthy = (heads == np.frombuffer(MAGIC, np.uint8)).all(1)
    if not healthy.all():
        raise BadMagic(f"record {first + int(np.argmin(healthy))} has another magic number")


def _ticks(words: np.ndarray) -> np.ndarray:
    """Microseconds since 1970 of times written as two 32-bit words, the high one first."""
    ticks = (words[:, 0].astype(np.uint64) << np.uint64(32)) | words[:, 1]
    return (ticks // np.uint64(10)).astype(np.int64) - EPOCH_TICKS // 10


class Window(NamedTuple):
    """Records that start at ``since`` or later and end at ``until`` or earlier, in microseconds since 1970."""

    since: int | None = None
    until: int | None = None

    def keeps(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        keep = np.ones(len(start), bool)
        if self.since is not None:
            keep &= start >= self.since
        if self.until is not None:
            keep &= end <= self.until
        return keep


def decode(raw: bytes, offsets: np.ndarray, first: int, session: str, columns: list[str], window: Window = Window()) -> pa.RecordBatch:
    """Records at these places of ``raw``, numbered from ``first``: head and channels."""
    data = np.frombuffer(raw, np.uint8)
    if len(offsets) and offsets[-1] - offsets[0] == (len(offsets) - 1) * RECORD_BYTES:  # side by side: no copy
        rows = data[offsets[0] : offsets[0] + len(offsets) * RECORD_BYTES].reshape(len(offsets), RECORD_BYTES)
    else:
        rows = data[offsets[:, None] + np.arange(RECORD_BYTES)]
    head = np.ascontiguousarray(rows[:, 4:20]).view("<u4")
    start, end, number = _ticks(head[:, 0:2]), _ticks(head[:, 2:4]), np.arange(first, first + len(rows))
    keep = window.keeps(start, end)
    if not keep.all():
        rows, start, end, number = rows[keep], start[keep], end[keep], number[keep]
    channels = [pa.array(np.ascontiguousarray(rows[:, at : at + 4]).view("<f4").reshape(-1)) for at in (HEADER_BYTES + 4 * INDEX[c] for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array([session] * len(rows), pa.string()), pa.array(number), pa.array(start).cast(STAMP), pa.array(end).cast(STAMP), *channels], [*HEAD, *columns])


def _schema(columns: list[str]) -> T.StructType:
    head = [T.StructField("session_id", T.StringType()), T.StructField("record_index", T.LongType()), T.StructField("t_start", T.TimestampType()), T.StructField("t_end", T.TimestampType())]
    return T.StructType(head + [T.StructField(c, T.FloatType()) for c in columns])


def session_name(path: str) -> str:
    """The folder a file is in, or the file's own name without its ending."""
    parts = path.rstrip("/").split("/")
    return parts[-2] if parts[-1] == "trend.bin" and len(parts) > 1 else parts[-1].rsplit(".", 1)[0]


# ------------------------------------------------------------------------------------------------ the data source


class Pieces(InputPartition):
    """(path, length, lo, hi) of the ranges that a task reads."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


class TrendReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]):
        self.columns, self.sessions = columns, None
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.pattern, self.by_path = options.get("pattern", "*.bin"), options.get("by_path") == "true"
        self.split = max(1, int(options.get("split", ranged.SPLIT)) // RECORD_BYTES) * RECORD_BYTES
        self.window = Window(*(int(options[k]) if k in options else None for k in ("since", "until")))

    def partitions(self) -> list[Pieces]:
        out, size = [[]], 0
        for path, length in (f for p in self.paths for f in ranged.listed(p, self.pattern)):
            if self.sessions is not None and session_name(path) not in self.sessions:
                continue
            for lo in range(0, last_start(length), self.split):
                hi = min(lo + self.split, length)
                if out[-1] and size + hi - lo > self.split:
                    out.append([])
                    size = 0
                out[-1].append((path, length, lo, hi))
                size += hi - lo
        return [Pieces(p) for p in out]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for path, length, lo, hi in partition.pieces:
            store, there = store_of(path)
            with store.open_input_file(there) as stream:
                for at in range(lo, min(hi, last_start(length)), ranged.STEP):
                    n = (min(at + ranged.STEP, hi, length) - at) // RECORD_BYTES
                    stream.seek(at)
                    raw, offsets = bytes(stream.read(n * RECORD_BYTES)), np.arange(n) * RECORD_BYTES
                    _all_magic(raw, offsets, at // RECORD_BYTES)
                    yield decode(raw, offsets, at // RECORD_BYTES, path if self.by_path else session_name(path), self.columns, self.window)


class PruningReader(TrendReader):
    """Takes the sessions that a query asks for, so that other files aren't read."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("session_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sessions = names if self.sessions is None else self.sessions & names
            else:
                yield f


class TrendSource(DataSource):
    """Options: ``path`` (or ``paths``, a JSON list), ``pattern``, ``since`` and ``until`` (microseconds), ``split`` (bytes), ``by_path``, ``prune``."""

    @classmethod
    def name(cls) -> str:
        return "trend"

    def schema(self) -> T.StructType:
        return _schema(EVERY)

    def reader(self, schema: T.StructType) -> TrendReader:
        columns = [n for n in schema.names if n not in HEAD]
        if schema.names[: len(HEAD)] != HEAD:
            raise ValueError(f"a schema of this source begins with {', '.join(HEAD)}")
        return (PruningReader if self.options.get("prune") == "true" else TrendReader)(_known(columns), dict(self.options))


def _known(columns: list[str] | None) -> list[str]:
    columns = list(columns or EVERY)
    if unknown := [c for c in columns if c not in INDEX]:
        raise ValueError(f"no such channel: {', '.join(unknown)}")
    return columns


def _micros(t: datetime | None) -> int | None:
    """A time without a zone is UTC."""
    if t is None:
        return None
    d = (t if t.tzinfo else t.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


# ------------------------------------------------------------------------------------------------ functions


def read_trend(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, tolerant: bool = False, pattern: str = "*.bin", since: datetime | None = None, until: datetime | None = None, split: int | None = None, by_path: bool = False) -> DataFrame:
    """Records of all session files under a path; ``columns`` prunes channels, ``since`` and ``until`` rows, before they leave the task.

    ``by_path``: ``session_id`` has the whole path of the file.
    """
    columns, window, split = _known(columns), Window(_micros(since), _micros(until)), split or ranged.SPLIT
    if not reachable(path):
        return _read_whole(spark, path, columns, tolerant, pattern, window, by_path)
    if tolerant:
        cut = ranged.entered(ranged.ranges(spark, path, pattern, split))
        # ranges of one file go to many tasks
        return cut.where("lo < hi").repartition("path", "lo").mapInArrow(_decode_ranges(columns, window, by_path), _schema(columns))
    spark.dataSource.register(TrendSource)
    options = {"paths": json.dumps([path] if isinstance(path, str) else path), "pattern": pattern, "split": split, "by_path": by_path, "prune": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    return spark.read.format("trend").schema(_schema(columns)).options(**options, **{k: v for k, v in window._asdict().items() if v is not None}).load()


def _decode_ranges(columns: list[str], window: Window, by_path: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, hi, entry, first in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "hi", "entry", "first")), strict=True):
                store, there = store_of(path)
                with store.open_input_file(there) as stream:
                    for raw, offsets, _ in ranged.steps(stream, entry, hi, length):
                        yield decode(raw, offsets, first, path if by_path else session_name(path), columns, window)
                        first += len(offsets)

    return task


def _read_whole(spark: SparkSession, path: str | list[str], columns: list[str], tolerant: bool, pattern: str, window: Window, by_path: bool) -> DataFrame:
    """As ``read_trend``, of files that only Spark can open, each in a row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = raw.as_py()
                offsets, _ = good_offsets(raw, tolerant)
                for lo in range(0, len(offsets), 8192):
                    yield decode(raw, offsets[lo : lo + 8192], lo, file if by_path else session_name(file), columns, window)

    return files(spark, path, pattern).select("path", "content").mapInArrow(task, _schema(columns))


STATS = ["total_seen", "good", "bad_magic", "truncated", "nonfinite"]


def scan_stats(spark: SparkSession, path: str | list[str], pattern: str = "*.bin", split: int | None = None) -> DataFrame:
    """Counts of a tolerant scan per file: ``session_id, total_seen, good, bad_magic, truncated, nonfinite``."""
    schema = "session_id string, " + ", ".join(f"{n} long" for n in STATS)
    if not reachable(path):
        return files(spark, path, pattern).select("path", "content").mapInArrow(_stats_whole, schema)
    cut = ranged.entered(ranged.ranges(spark, path, pattern, split or ranged.SPLIT))
    odd = cut.repartition("path", "lo").mapInArrow(_nonfinite, "path string, end long, good long, length long, nonfinite long").groupBy("path").agg(*[F.sum(c).alias(c) for c in ("end", "good", "length", "nonfinite")])
    bad = F.col("end") - RECORD_BYTES * F.col("good")
    return odd.select(_name_of("path").alias("session_id"), (F.col("good") + bad).alias("total_seen"), "good", bad.alias("bad_magic"), (F.col("end") < F.col("length")).cast("long").alias("truncated"), "nonfinite")


def _name_of(path: str):
    """``session_name`` as a column."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    return F.when((last == "trend.bin") & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(F.regexp_replace(last, r"\.[^.]*$", ""))


def _odd(raw: bytes, offsets: np.ndarray) -> int:
    floats = np.frombuffer(raw, np.uint8)[(offsets + HEADER_BYTES)[:, None] + np.arange(4 * FLOATS)].view("<f4")
    return int((~np.isfinite(floats[:, list(CHANNELS)])).any(1).sum())


def _nonfinite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range its records that hold values that aren't finite; of the row behind a file's last the scan's end and counts."""
    for batch in batches:
        for path, length, lo, hi, entry, first in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "lo", "hi", "entry", "first")), strict=True):
            n = 0
            if lo < hi:
                store, there = store_of(path)
                with store.open_input_file(there) as stream:
                    n = sum(_odd(raw, offsets[k : k + 8192]) for raw, offsets, _ in ranged.steps(stream, entry, hi, length) for k in range(0, len(offsets), 8192))
            last = lo == hi
            yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([x], pa.int64()) for x in (entry * last, first * last, length * last, n))], ["path", "end", "good", "length", "nonfinite"])


def _stats_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            raw = raw.as_py()
            offsets, stats = good_offsets(raw, True)
            stats["nonfinite"] = sum(_odd(raw, offsets[k : k + 8192]) for k in range(0, len(offsets), 8192))
            yield pa.RecordBatch.from_arrays([pa.array([session_name(file)]), *(pa.array([stats[n]], pa.int64()) for n in STATS)], ["session_id", *STATS])


def file_facts(spark: SparkSession, path: str | list[str], pattern: str = "*.bin") -> DataFrame:
    """Per file, without decoding it: its size in records, and whether bytes are left over."""
    size = F.col("length")
    return files(spark, path, pattern).select("path", F.floor(size / RECORD_BYTES).alias("records"), (size % RECORD_BYTES > 0).alias("has_tail"))


def first_last_times(spark: SparkSession, path: str | list[str], pattern: str = "*.bin") -> DataFrame:
    """``session_id, first_start, last_end`` of each file: start of its first and end of its last whole record, which are all that tasks read of it."""
    schema = "session_id string, first_start timestamp, last_end timestamp"
    found = files(spark, path, pattern)
    if reachable(path):
        return found.select("path", "length").repartition("path").mapInArrow(_peek, schema)
    return found.select("path", "length", "content").mapInArrow(_peek, schema)


def _peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, starts, ends = [], [], []
        for k, (path, length) in enumerate(zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)):
            n = length // RECORD_BYTES
            if not n:
                continue
            places = [0, (n - 1) * RECORD_BYTES]
            if "content" in batch.schema.names:
                whole = batch.column("content")[k].as_py()
                raw = b"".join(whole[p : p + RECORD_BYTES] for p in places)
            else:
                store, there = store_of(path)
                with store.open_input_file(there) as stream:
                    raw = b"".join(bytes(stream.read_at(RECORD_BYTES, p)) for p in places)
            offsets = np.array([0, RECORD_BYTES])
            _all_magic(raw, offsets, 0)
            got = decode(raw, offsets, 0, "", [])
            names.append(session_name(path))
            starts.append(got.column("t_start")[0])
            ends.append(got.column("t_end")[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.as_py() for x in starts], STAMP), pa.array([x.as_py() for x in ends], STAMP)], ["session_id", "first_start", "last_end"])


def encode_columns(t_start: np.ndarray, t_end: np.ndarray, channels: dict[str, np.ndarray]) -> bytes:
    """Records (start and end in microseconds since 1970, channels by name) as a file's bytes; channels that are missing are 0."""
    rows = np.zeros((len(t_start), RECORD_BYTES), np.uint8)
    rows[:, :4] = np.frombuffer(MAGIC, np.uint8)
    ticks = np.stack([t_start, t_end], 1).astype(np.int64) * 10 + EPOCH_TICKS
    words = np.stack([ticks >> 32, ticks & 0xFFFFFFFF], 2).reshape(len(rows), 4).astype("<u4")
    rows[:, 4:20] = words.view(np.uint8)
    floats = np.zeros((len(rows), FLOATS), "<f4")
    for name, values in channels.items():
        floats[:, INDEX[name]] = values
    rows[:, HEADER_BYTES:] = floats.view(np.uint8)
    return rows.tobytes()


def encode(records: list[tuple[int, int, list[float]]]) -> bytes:
    """Records (start and end in microseconds since 1970, up to 180 values in the order of channels) as a file's bytes."""
    names = [CHANNELS.get(i) for i in range(FLOATS)]
    values = np.zeros((len(records), FLOATS), "<f4")
    for k, (_, _, v) in enumerate(records):
        values[k, : len(v)] = v
    return encode_columns(np.array([r[0] for r in records], np.int64), np.array([r[1] for r in records], np.int64), {n: values[:, i] for i, n in enumerate(names) if n})
