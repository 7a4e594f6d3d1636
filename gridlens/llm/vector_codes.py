"""Vector code compression: each part of a vector becomes the index of the nearest entry of that part's codebook.

All of it is whole numbers: a component x counts as floor(``SCALE`` * x), so codes, errors and codebooks are the same whatever the
partitions. Codebooks start as the parts of the vectors with the smallest ids; in each round every part goes to its nearest
entry and each entry becomes the floor of its parts' mean; entries without parts stay. Sums are made by task and by Spark;
what comes to the driver is one row per entry of a codebook, whatever the number of vectors.

The nearest entry is found in two steps (``nearest``):

* screening: a float32 matrix product gives |c|^2 - 2 p.c for all entries, each with an interval that holds the exact value
  whatever the order in which the product was summed;
* every entry whose interval reaches down to the lowest upper end is evaluated again in int64; of equal distances the lowest index wins.

Vectors that are null or hold null or non-finite components are left out. Shorter vectors count as filled up with zeros to the
length of the longest, and that to a multiple of the number of parts. Integers saturate at a limit (2**27 for up to 64 dimensions, so components of
half a million) that keeps a vector's error within 64 bits; a label's error that leaves them is null. With fewer vectors than entries a
codebook has one entry for each. Rows that share an id, or have none (smaller than any), are vectors of their own. Labels of any type; nulls
are one label. No vectors, no rows. The vectors are read once for each round and three times more, and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.common import doc_key, join_hot, stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
#: Vectors that a task takes at a time.
STEP = 4096
#: Half of the distance between neighbouring float32 numbers, relative, with room for the float64 roundings of the bound itself.
UNIT = 2.0**-24 * 1.01


class Codebooks(NamedTuple):
    """``entries``: part by entry by position, int64; ``width``: components of a vector, filled up."""

    entries: np.ndarray
    width: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole(vectors: DataFrame, embedding: str = "embedding") -> Column:
    """Whether a row has a vector without null and non-finite components."""
    fine = F.forall(embedding, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return F.col(embedding).isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as float64 rows of ``width``, short ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < np.diff(offsets)[:, None]] = flat
    return out


def integers(x: np.ndarray) -> np.ndarray:
    limit = float(math.isqrt(2**62 // max(1, x.shape[1])) // 2)
    return np.clip(np.floor(x * SCALE), -limit, limit).astype(np.int64)


def intervals(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2 p.c for each point and entry, from a float32 product.

    With d components and u = 2**-24: both factors rounded to float32 and the sum of d products in any order, fused or not, err by
    at most ((1 + u)**(d + 2) - 1) |p||c|; |c|^2 is rounded once, and so is the difference.
    """
    d = points.shape[1]
    squares = (book * book).sum(1).astype(np.float64)
    norms = np.sqrt((points * points).sum(1).astype(np.float64))
    value = squares.astype(np.float32)[None, :] - 2 * (points.astype(np.float32) @ book.astype(np.float32).T)
    radius = norms[:, None] * (UNIT * (2 * d + 16) * np.sqrt(squares))[None, :] + UNIT * 4 * squares[None, :]
    return value - radius, value + radius


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of ``book``, the lowest index on ties; all int64."""
    low, high = intervals(points, book)
    row, entry = np.nonzero(low <= high.min(1)[:, None])
    gap = points[row] - book[entry]
    exact = (gap * gap).sum(1)
    start = np.searchsorted(row, np.arange(len(points)))
    least = np.minimum.reduceat(exact, start) if len(points) else exact
    first = np.flatnonzero(exact == least[row])
    first = first[np.searchsorted(row[first], np.arange(len(points)))]
    return entry[first].astype(np.int64), least


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows with their vectors in integers."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            yield part, integers(matrix(part.column("embedding"), width))


def _gather(books: Codebooks):
    """(part, entry, n, total): the parts assigned to each entry, and their sum, of a task's vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, d = books.entries.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for _, x in _steps(batches, books.width):
            for p in range(parts):
                mine = x[:, p * d : (p + 1) * d]
                at, _ = nearest(mine, books.entries[p])
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, mine)
        p, e = np.nonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * d, pa.int32()), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), lists], ["part", "entry", "n", "total"])

    return task


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id: str = "vec_id") -> Codebooks | None:
    """Codebooks of ``vectors`` (an id and ``embedding``); none without vectors. ``entries``: 256 at most, so that a code is a byte."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = vectors.where(whole(vectors)).select(doc_key(id).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    d = -(-longest // parts)
    width = parts * d
    first = rows.orderBy("vec_id", "embedding").limit(entries).select("embedding").toArrow().column("embedding")
    start = integers(matrix(first, width)).reshape(len(first), parts, d).transpose(1, 0, 2)
    books = Codebooks(np.ascontiguousarray(start), width)
    for _ in range(rounds):
        sums = rows.select("embedding").mapInArrow(_gather(books), "part int, entry int, n long, total array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(d)])
        after = books.entries.copy()
        for r in sums.collect():
            after[r["part"], r["entry"]] = [r[f"t{k}"] // r["n"] for k in range(d)]
        books = Codebooks(after, width)
    return books


def encode(vectors: DataFrame, books: Codebooks, *more: str, id: str = "vec_id") -> DataFrame:
    """``vec_id, code, error`` and the columns ``more`` of each vector; ``code`` has one byte per part, ``error`` sums the squared distances."""
    rows = vectors.where(whole(vectors)).select(F.col(id).cast("long").alias("vec_id"), *more, F.col("embedding").cast("array<double>").alias("embedding"))
    schema = T.StructType(rows.drop("embedding").schema.fields[:]).add("code", "binary").add("error", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, d = books.entries.shape
        for part, x in _steps(batches, books.width):
            found = [nearest(x[:, p * d : (p + 1) * d], books.entries[p]) for p in range(parts)]
            code = np.stack([at for at, _ in found], 1).astype(np.uint8)
            kept = [part.column(c) for c in part.schema.names if c != "embedding"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(sum(far for _, far in found), pa.int64())], schema.names)

    return rows.mapInArrow(task, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``embedding``, what the codes stand for."""
    schema = T.StructType(codes.schema.fields[:]).add("embedding", T.ArrayType(T.FloatType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.arange(len(books.entries))
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(parts))
            x = (books.entries[parts, at].reshape(len(at), books.width) / SCALE).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * books.width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], schema.names)

    return codes.mapInArrow(task, schema)


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over the rows of equal ``label``; a label of a third of all rows is not dealt."""
    keyed = coded.withColumns({"_none": F.col(label).isNull(), "_label": F.coalesce(F.col(label).cast("string"), F.lit(""))})
    sums = keyed.groupBy("_none", "_label").agg(F.expr("try_sum(error)").alias("label_error"), F.count("*").alias("_k"))
    return join_hot(keyed, sums, ["_none", "_label"], coded.count(), "_k").drop("_none", "_label", "_k")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = learn(vectors)
    if books is None:
        return vectors.limit(0).selectExpr("cast(vec_id as long) vec_id", "'' code", "cast(0 as long) error", "cast(0 as long) label_error", "'' codebooks_sha256")
    coded = label_errors(stage(encode(vectors, books, "label"), "codes"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    far = "list_sum(list_transform(range(1, len(s) + 1), lambda i: (s[i] - c[i]) * (s[i] - c[i])))"
    steps = [
        f"""with v as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE:.0f} * x::double) as bigint)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select vec_id, k, q[k * (len(q) // {parts}) + 1 : (k + 1) * (len(q) // {parts})] as s from v, range({parts}) t(k)),
b0 as (select k, e, s as c from p join (select vec_id, row_number() over (order by vec_id) - 1 as e from v qualify e < {entries}) using (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select vec_id, k, min({far} * {entries} + e) as best from p join b{r} using (k) group by vec_id, k)")
        if r < rounds:
            steps.append(f"""m{r} as (select k, e, list((t - ((t % n) + n) % n) // n order by i) as c from (
    select k, best % {entries} as e, i, sum(s[i])::bigint as t, count(*) as n from (select k, best, s, unnest(range(1, len(s) + 1)) as i from p join a{r} using (vec_id, k)) group by 1, 2, 3) group by k, e),
b{r + 1} as materialized (select b{r}.k, b{r}.e, coalesce(m{r}.c, b{r}.c) as c from b{r} left join m{r} using (k, e))""")
    steps.append(f"""z as (select vec_id, string_agg(format('{{:02x}}', best % {entries}), '' order by k) as code, sum(best // {entries})::bigint as error from a{rounds} group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by k, e)) from b{rounds}) as codebooks_sha256 from z join v using (vec_id)""")
    return ",\n".join(steps).replace(",\nz as", ",\nz as")


SQL = _sql()
