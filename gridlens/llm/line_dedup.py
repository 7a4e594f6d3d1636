"""Line dedup on levelled sorted runs of line hashes.

``LineRuns`` keeps, per level, runs: tables of (hash of a line, documents that have it), bucketed and sorted by hash in the shared
folder. ``ingest`` takes a batch: its lines are counted, merge-anti-joined with the runs (lines that a run already has in
``decided`` documents are known and counted no further), and what is left is added as the batch's own run. ``FANOUT`` runs of
a level are compacted into one of the next. With ``decided`` = 1 what a batch gets back is exactly its lines that no earlier batch has.
Runs have the buckets of the shuffle, so a batch's counts, once dealt, meet them where they are.

``drop_frequent`` takes all documents in so, batch by batch; lines that the runs hold in ``min_docs`` documents then go from
every document, by their places in it.

A line's key is the line without white space ``[\x20\x09-\x0D]`` at both ends, A-Z lower-cased; its hash has 128 bits. Null or
empty text: one empty line. Empty keys are never counted or dropped. Repeated lines of a document count once. Every row is a
document, also where rows share an id or have none. No documents, no rows. Columns ``n_lines`` and ``n_dropped`` of the input are
replaced. A line of a third of all documents is counted before it is dealt, and joined back without being dealt at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.common import SPACES, doc_key, join_hot, new_path, partitions, stage

FANOUT = 4
BATCHES = 4
MIN_DOCS = 10
MIN_CHARS = 1


def line_keys(text: str) -> list[bytes]:
    """The key of each line."""
    return [line.strip(SPACES).lower() for line in text.encode().split(b"\n")]


def _hashed(min_chars: int):
    """(h1, h2, places) of each distinct line of each row, with the row's other columns."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, digests, sizes, places = [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                found: dict[bytes, list[int]] = {}
                for n, key in enumerate(line_keys(text)):
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        found.setdefault(key, []).append(n)
                for key, at in found.items():
                    row.append(r)
                    digests.append(xxhash.xxh3_128_digest(key))
                    sizes.append(len(at))
                    places += at
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32()), pa.array(places, pa.int32()))
            rest = [n for n in batch.schema.names if n != "text"]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in rest), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), lists], [*rest, "h1", "h2", "places"])

    return task


def hashed(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The columns of ``rows`` but ``text``, and ``h1, h2, places`` of each distinct line of at least ``min_chars`` code points."""
    kept = [f for f in rows.schema if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_hashed(min_chars), schema)


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs)."""

    def __init__(self, spark: SparkSession, decided: int = 1, fanout: int = FANOUT):
        self.spark, self.decided, self.fanout = spark, decided, fanout
        self.levels: list[list[DataFrame]] = []
        self.buckets = partitions(spark)

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _run(self, counted: DataFrame) -> DataFrame:
        """Write a run; its name is only needed to tell Spark of its buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = counted.select("h1", "h2", "docs").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", new_path(self.spark, "lines")).saveAsTable(name)
        run = self.spark.read.table(name)
        self.spark.sql(f"drop table {name}")  # the files stay
        return run

    def _add(self, run: DataFrame) -> None:
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run, self.levels[level] = self._run(_sum(self.levels[level])), []
            level += 1

    def ingest(self, hashes: DataFrame) -> DataFrame:
        """Take in a batch (h1, h2 of each line of each document); (h1, h2, docs) of its lines that the runs have not decided."""
        new = hashes.groupBy("h1", "h2").agg(F.count("*").alias("docs"))
        for run in self._runs():
            new = new.join(run.where(F.col("docs") >= self.decided).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        run = self._run(new)
        self._add(run)
        return run

    def totals(self) -> DataFrame:
        """(h1, h2, docs) of all runs; of lines that were decided, the documents until then."""
        return _sum(self._runs())


def _sum(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.union(r)
    return out.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))


def _cut(fields: list[str]):
    """The rows without the lines at the places in ``_gone``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = batch.column("text").to_pylist(), [], []
            for k, gone in enumerate(batch.column("_gone")):
                if not gone.is_valid:
                    total.append(texts[k].count("\n") + 1)
                    dropped.append(0)
                    continue
                lines, out = texts[k].split("\n"), set(gone.values.to_pylist())
                texts[k] = "\n".join([x for n, x in enumerate(lines) if n not in out])
                total.append(len(lines))
                dropped.append(len(out))
            cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], [*fields, "n_lines", "n_dropped"])

    return task


def drop_frequent(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the kept ``text``; other columns stay."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"_id": doc_key(), "_sub": F.xxhash64("text")})
    batch = F.pmod(F.xxhash64("_id", "_sub"), F.lit(batches)).cast("int").alias("batch")
    lines = stage(hashed(rows.select("_id", "_sub", batch, "text"), min_chars), "hashes", by="batch")
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.ingest(lines.where(F.col("batch") == b))
    frequent = runs.totals().where(F.col("docs") >= min_docs)
    gone = join_hot(lines.select("_id", "_sub", "h1", "h2", "places"), frequent, ["h1", "h2"], lines.count(), count="docs", how="left_semi")
    gone = gone.groupBy("_id", "_sub").agg(F.flatten(F.collect_list("places")).alias("_gone"))
    fields = [f for f in rows.schema if f.name not in ("_id", "_sub")]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return rows.join(gone, ["_id", "_sub"], "left").select(*docs.columns, "_gone").mapInArrow(_cut([f.name for f in fields]), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with d as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), l as (
  select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d
), k as (
  select doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (
  select key from k where key <> '' group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(*) filter (where f.key is not null) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by doc_id
"""
