"""Byte ranges of files, read by tasks, and what a scan for records finds in them.

A file is cut into ranges of bytes, each the work of one task. A healthy file has a record every ``RECORD_BYTES``, so ranges begin at
records. In a damaged one, where a range's first record begins depends on all before it: the scan enters a range somewhere in its
first ``RECORD_BYTES`` bytes. So each range is scanned for all these entries at once (``entries_of``), which gives where the scan leaves it
and how many records it finds; these functions, applied one after the other (``entered``), give the exact entry and first record number of
every range, the same as one scan from the start of the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.spec import MAGIC, RECORD_BYTES

#: Bytes of a range.
SPLIT = RECORD_BYTES * (1 << 17)
#: Bytes that a task holds at a time.
STEP = RECORD_BYTES * 8192
#: Stores whose files tasks can read in ranges; in others Spark reads whole files.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


class BadMagic(ValueError):
    """A record doesn't begin as records do."""


def reachable(path: str | list[str]) -> bool:
    return all((p.split(":", 1)[0] if ":" in p.split("/", 1)[0] else "") in SCHEMES for p in ([path] if isinstance(path, str) else path))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """A file's store and its path there."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))


def listed(path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path, size) of the files at, or anywhere under, a path (which may have ``*``, ``?`` and ``[]``), in order."""
    store, there = store_of(path)
    scheme = path[: path.index(":") + 1] if path.partition(":")[1] and "/" not in path.partition(":")[0] else ""
    there, magic = there.rstrip("/"), any(c in there for c in "*?[")
    top = there[: min(there.index(c) for c in "*?[" if c in there)].rpartition("/")[0] if magic else there
    info = store.get_file_info(top or "/")
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(top or "/", recursive=True))
    depth = there.count("/")
    hit = lambda p: not magic or fnmatch("/".join(p.split("/")[: depth + 1]), there)
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and fnmatch(f.base_name, pattern) and hit(f.path))


def files(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """Files as Spark lists and reads them: ``path, modificationTime, length, content``; what isn't selected isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def ranges(spark: SparkSession, path: str | list[str], pattern: str, split: int = SPLIT) -> DataFrame:
    """``path, length, lo, hi``: every file cut into ranges; the rows are dealt to tasks."""
    size = F.col("length")
    cut = F.explode_outer(F.when(size > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {split}"))))  # a file without bytes is one empty range
    out = files(spark, path, pattern).select("path", "length").select("path", "length", cut.alias("_k"))
    out = out.withColumn("_k", F.coalesce("_k", F.lit(0).cast("long")))
    return out.select("path", "length", (F.col("_k") * split).alias("lo"), F.least(size, (F.col("_k") + 1) * split).alias("hi"))


def record_starts(raw: bytes, stop: int) -> tuple[np.ndarray, int]:
    """Where records begin before ``stop``, scanning from the first byte; and where the scan is then, at ``stop`` or beyond.

    After a record the scan is behind it; where none begins it steps on byte by byte.
    """
    if stop <= 0:
        return np.zeros(0, np.int64), 0
    n = -(-stop // RECORD_BYTES)
    if n * RECORD_BYTES <= len(raw):  # healthy: side by side
        heads = np.frombuffer(raw, np.uint8, n * RECORD_BYTES).reshape(n, RECORD_BYTES)[:, :4]
        if (heads == np.frombuffer(MAGIC, np.uint8)).all():
            return np.arange(n) * RECORD_BYTES, n * RECORD_BYTES
    at, found = 0, []
    while at < stop:
        if raw.startswith(MAGIC, at):
            found.append(at)
            at += RECORD_BYTES
        else:
            step = raw.find(MAGIC, at + 1, stop + len(MAGIC) - 1)
            at = step if step >= 0 else stop
    return np.array(found, np.int64), at


def last_start(length: int) -> int:
    """The first place where no whole record can begin any more."""
    return max(0, length - RECORD_BYTES + 1)


def steps(stream, entry: int, hi: int, length: int, step: int | None = None) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """(bytes, places of records in them, the bytes' place in the file) of the records that begin in ``entry..hi-1``, a bounded step at a time."""
    at, stop, step = entry, min(hi, last_start(length)), step or STEP
    while at < stop:
        stream.seek(at)
        raw = bytes(stream.read(min(step + RECORD_BYTES - 1, length - at)))
        if not raw:
            break
        found, end = record_starts(raw, min(stop - at, step, last_start(len(raw))))
        yield raw, found, at
        at += max(end, 1)


def entries_of(raw: bytes, lo: int, hi: int, length: int) -> list[tuple[int, int, int]]:
    """(last, leaves, good): a scan that enters the range at ``last`` or before (but after the entry of the row before) leaves it there, with so many records.

    ``raw`` has the bytes from ``lo`` on, and the three behind ``hi``. A scan that meets no record leaves at the end (-1 stands for it), or where it entered if
    that is beyond. Scans that differ meet soon, and are one from there on: each row follows the records from its own first one.
    """
    stop = min(hi, last_start(length))
    found, at = [], raw.find(MAGIC)
    while 0 <= at < stop - lo:
        found.append(lo + at)
        at = raw.find(MAGIC, at + 1)
    places = np.array(found, np.int64)
    after = np.searchsorted(places, places + RECORD_BYTES)
    leaves, good = np.full(len(places), -1, np.int64), np.zeros(len(places), np.int64)
    out = []
    for k in range(min(len(places), int(np.searchsorted(places, lo + RECORD_BYTES)) + 1)):
        path, j = [], k
        while j < len(places) and leaves[j] < 0:
            path.append(j)
            j = int(after[j])
        for i in reversed(path):
            j = int(after[i])
            leaves[i], good[i] = (leaves[j], good[j] + 1) if j < len(places) else (max(places[i] + RECORD_BYTES, stop), 1)
        out.append((int(places[k]), int(leaves[k]), int(good[k])))
    return [*out, (length, -1, 0)]


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "lo", "hi")), strict=True):
            store, there = store_of(path)
            with store.open_input_file(there) as stream:
                stream.seek(lo)
                rows = entries_of(bytes(stream.read(min(hi + len(MAGIC) - 1, length) - lo)), lo, hi, length)
            cols = [[path], [length], [lo], [hi], *([list(c)] for c in zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c[:1], pa.string()) if k == 0 else pa.array(c, pa.int64() if k < 4 else pa.list_(pa.int64())) for k, c in enumerate(cols)], ["path", "length", "lo", "hi", "last", "leaves", "good"])


def _compose(table: pa.Table) -> pa.Table:
    """The ranges of a file in order: where the scan enters each, and the number of its first record. A row is a few numbers for each range."""
    rows = table.sort_by("lo").to_pylist()
    at, number, out = 0, 0, []
    for r in rows:
        out.append((r["path"], r["length"], r["lo"], r["hi"], at, number))
        k = int(np.searchsorted(r["last"], at))
        stop = min(r["hi"], last_start(r["length"]))
        if at < stop:
            at, number = (r["leaves"][k] if r["leaves"][k] >= 0 else stop), number + r["good"][k]
    # what comes behind the last range: where the scan ends, and how many records there are
    out.append((rows[-1]["path"], rows[-1]["length"], rows[-1]["length"], rows[-1]["length"], at, number))
    return pa.table(dict(zip(["path", "length", "lo", "hi", "entry", "first"], map(list, zip(*out, strict=True)), strict=True)))


def entered(cut: DataFrame) -> DataFrame:
    """``path, length, lo, hi, entry, first`` of the ranges, and one row behind the last of each file (``lo = hi = length``) with the scan's end."""
    each = cut.repartition("path", "lo").mapInArrow(_functions, "path string, length long, lo long, hi long, last array<long>, leaves array<long>, good array<long>")
    return each.groupBy("path").applyInArrow(_compose, "path string, length long, lo long, hi long, entry long, first long")
