"""Decoded sessions kept as Parquet, a table for each file, by what is in the file.

A manifest in the cache's folder lists its tables: which file each is of, the file's size, time of change and digest, what was asked for, and when it was
used last. A file whose size and time are unchanged isn't opened; one that was only moved or touched is digested, by a task, but not
decoded; only new and changed ones are decoded, all in one job. What the manifest doesn't list is never touched.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.sources.ranged import STEP, files, reachable, store_of
from gridlens.sources.trend import _name_of, _schema, _known, read_trend, session_name

MANIFEST = "manifest.json"
#: Tables that were used in the last so many seconds stay, as others may be reading them.
GRACE = 86_400
_held: WeakKeyDictionary = WeakKeyDictionary()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            store, there = store_of(path)
            digest = hashlib.sha256()
            with store.open_input_file(there) as stream:
                while part := stream.read(STEP):
                    digest.update(part)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "digest"])


class Manifest:
    """Tables by their key: ``where`` they are (under the folder), when ``used``; and files by path: size, time of change, digest."""

    def __init__(self, folder: str):
        self.store, self.top = store_of(folder)
        self.tables: dict[str, dict] = {}
        self.files: dict[str, list] = {}
        if self.store.get_file_info(f"{self.top}/{MANIFEST}").is_file:
            with self.store.open_input_stream(f"{self.top}/{MANIFEST}") as stream:
                held = json.loads(bytes(stream.read()))
            self.tables, self.files = held["tables"], held["files"]

    def save(self) -> None:
        """As a whole: readers see the one before or this one."""
        self.store.create_dir(self.top, recursive=True)
        new = f"{self.top}/{MANIFEST}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(new) as stream:
            stream.write(json.dumps({"tables": self.tables, "files": self.files}).encode())
        self.store.move(new, f"{self.top}/{MANIFEST}")

    def evict(self, keep: int, asked: set[str], grace: float) -> None:
        """Of the tables used least recently all but ``keep``; none that this call asked for, a DataFrame here holds, or was used of late."""
        open_ = asked | {k for keys in _held.values() for k in keys}
        old = sorted(self.tables, key=lambda k: -self.tables[k]["used"])[keep:]
        gone = [k for k in old if k not in open_ and time.time() - self.tables[k]["used"] >= grace]
        paths = [self.tables.pop(k)["where"] for k in gone]
        if gone:
            self.save()  # first, so that nobody is sent to what goes
        for path in paths:
            if self.store.get_file_info(f"{self.top}/{path}").type == fs.FileType.Directory:
                self.store.delete_dir(f"{self.top}/{path}")


def cached_trend(spark: SparkSession, path: str | list[str], folder: str, columns: list[str] | None = None, tolerant: bool = False, pattern: str = "*.bin", keep: int = 5, grace: float = GRACE) -> DataFrame:
    """``read_trend`` through a cache under ``folder``, which keeps at least the ``keep`` files' tables used last."""
    folder, columns = folder.rstrip("/"), _known(columns)
    if not reachable([folder, *([path] if isinstance(path, str) else path)]):
        raise ValueError("a cache needs files that tasks can open")
    manifest = Manifest(folder)
    # one row of metadata for each file, as a listing of Spark's has
    now = {r["path"]: [r["length"], r["changed"]] for r in files(spark, path, pattern).select("path", "length", F.unix_micros("modificationTime").alias("changed")).collect()}
    unknown = [p for p, facts in now.items() if manifest.files.get(p, [None] * 3)[:2] != facts]
    if unknown:
        rows = spark.createDataFrame([(p,) for p in unknown], "path string").repartition("path")
        manifest.files |= {r["path"]: [*now[r["path"]], r["digest"]] for r in rows.mapInArrow(_digests, "path string, digest string").collect()}
    asked = json.dumps([columns, tolerant])
    keys = {p: hashlib.sha256("\n".join((manifest.files[p][2], session_name(p), asked)).encode()).hexdigest() for p in sorted(now)}
    first = {k: p for p, k in reversed(keys.items())}  # equal sessions are decoded once
    missing = [(p, k) for k, p in first.items() if k not in manifest.tables]
    if missing:
        run = f"run-{uuid.uuid4().hex}"
        known = spark.createDataFrame(missing, "_path string, table string")
        rows = read_trend(spark, [p for p, _ in missing], columns, tolerant, pattern, by_path=True)
        rows = rows.withColumnRenamed("session_id", "_path").join(known, "_path").withColumn("session_id", _name_of("_path"))
        rows.select("session_id", *rows.columns[1:-2], "table").write.partitionBy("table").parquet(f"{folder}/{run}")
        there = {f.base_name for f in manifest.store.get_file_info(fs.FileSelector(f"{manifest.top}/{run}")) if not f.is_file}
        # a file without records has no folder
        manifest.tables |= {k: {"where": f"{run}/table={k}" if f"table={k}" in there else "", "used": 0.0} for _, k in missing}
    for k in keys.values():
        manifest.tables[k]["used"] = time.time()
    manifest.save()
    out = spark.read.schema(_schema(columns))
    where = [f"{folder}/{manifest.tables[k]['where']}" for k in first if manifest.tables[k]["where"]]
    out = out.parquet(*where) if where else spark.createDataFrame([], _schema(columns))
    _held[out] = set(first)
    manifest.evict(keep, set(first), grace)
    return out
