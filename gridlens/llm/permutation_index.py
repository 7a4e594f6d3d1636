"""Approximate nearest neighbours by a permutation index: vectors are known by the order in which they see a set of pivots.

1. Pivots are vectors of the table, ``PIVOTS`` at most, from a bounded sample by hash. Each vector keeps its ``PREFIX`` nearest pivots in
   order. Nearest means the largest inner product, so that the index answers that question, vectors are first lifted to one length (one more
   component, zero for queries), where the largest inner product and the least distance are the same.
2. The vectors are dealt to shards by hash and the queries to blocks; each shard meets each block once. A shard posts its
   vectors in inverted files, one list per pivot of (vector, place of the pivot in its order).
3. A query runs through the lists of its own pivots, which adds up the footrule distance to every vector of the shard: the sum over
   pivots of the difference of places, where a pivot outside a prefix counts as just behind it. Those of least distance, a part of the
   shard so that ``WIDE * n ** POWER`` of all n vectors are taken, are ranked again by the exact inner product in double precision.
4. The best of all shards are put together by query.

Every vector is indexed and every query is searched in all shards, so more vectors only mean more shards. The copies that move are a vector for
each block of queries, and a query for each shard; no pair leaves its task but a query's ``K`` best of a shard.

Vectors that are null, empty, zero, or hold null or non-finite components take no part. Shorter vectors count as filled up with
zeros. Every row is a vector of its own, whatever its id: rows that share one find each other, and a row without an id is found, before all
others of its score. Ties, in footrule distance and in score, go to the smaller id. No queries or no other vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.common import doc_key, key_back, partitions, stage
from gridlens.llm.vector_codes import matrix, whole

K = 20
#: Queries of the registered query: vectors whose id this divides.
EVERY = 20
PIVOTS = 256
PREFIX = 64
#: Rows that the pivots are drawn from.
SAMPLE = 1024
#: Of n vectors so many are ranked by inner product for each query: WIDE * n ** POWER.
WIDE, POWER = 8.0, 0.6
#: Bytes of the vectors of a shard, and of the queries of a block.
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
#: Bytes of shards and blocks for each shuffle partition.
GROUP_BYTES = 64 << 20


class Pivots:
    """Pivots, lifted to the length ``most``, and the order in which vectors see them."""

    def __init__(self, sample: np.ndarray, most: float):
        self.most = max(most, 1e-300)
        self.points = np.unique(sample, axis=0)
        if len(self.points) > PIVOTS:  # by hash order the sample is in no order of its own
            keep = np.sort(np.random.default_rng(5).permutation(len(self.points))[:PIVOTS])
            self.points = self.points[keep]
        self.rest = self._lift(self.points)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.most - (x * x).sum(1)))

    def order(self, x: np.ndarray, lift: bool) -> np.ndarray:
        """The nearest pivots of each vector, nearest first; ``lift``: of indexed vectors, else of queries."""
        near = x @ self.points.T
        if lift:
            near += self._lift(x)[:, None] * self.rest[None, :]
        # equal vectors must see equal orders, whatever the rounding of the product
        near = np.rint(near * (2.0**40 / self.most) / 2**10)
        return np.argsort(-near, axis=1, kind="stable")[:, :PREFIX].astype(np.uint8)


def _index(pivots: Pivots, width: int):
    """Adds the orders: ``seen`` of a vector as it is indexed, ``asks`` of a query."""

    def blobs(order: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in order], pa.binary())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = matrix(part.column("embedding"), width)
                yield pa.RecordBatch.from_arrays([*part.columns, blobs(pivots.order(x, True)), blobs(pivots.order(x, False))], [*part.schema.names, "seen", "asks"])

    return task


class InvertedFiles:
    """For each pivot the vectors that have it in their prefix, with prefix length less its place."""

    def __init__(self, seen: np.ndarray, pivots: int):
        n, self.prefix = seen.shape
        pivot = seen.ravel()
        order = np.argsort(pivot, kind="stable")
        self.vector = np.repeat(np.arange(n), self.prefix)[order]
        self.weight = np.tile(self.prefix - np.arange(self.prefix), n)[order].astype(np.int32)
        self.start = np.searchsorted(pivot[order], np.arange(pivots + 1))
        self.n = n

    def footrule(self, asks: np.ndarray) -> np.ndarray:
        """The distance of every vector's order from the query's.

        A pivot at places a and b of both prefixes of length m takes (m - a) + (m - b) - |a - b| = 2 (m - max(a, b)) off what two
        prefixes without a common pivot are apart, which is m (m + 1).
        """
        m = self.prefix
        common = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(asks.tolist()):
            lo, hi = self.start[pivot], self.start[pivot + 1]
            common[self.vector[lo:hi]] += np.minimum(self.weight[lo:hi], m - place)  # a list has a vector once
        return m * (m + 1) - 2 * common


def _search(width: int, pivots: int, every: int, k: int):
    """(asker, query_id, vec_id, score): the best of a shard for each query of a block."""
    names = ["asker", "query_id", "vec_id", "score"]

    def group(table: pa.Table) -> pa.Table:
        asker = table.column("asks").is_valid().to_numpy()
        key, ids = table.column("key").to_numpy(), table.column("vec_id").to_numpy()
        x = matrix(table.column("embedding"), width)
        index, queries = np.flatnonzero(~asker), np.flatnonzero(asker)
        out: list[tuple] = []
        if len(index) and len(queries):
            index = index[np.lexsort((key[index], ids[index]))]  # so that the first of equals has the smaller id
            seen = np.frombuffer(b"".join(table.column("seen").take(pa.array(index)).to_pylist()), np.uint8).reshape(len(index), -1)
            files = InvertedFiles(seen, pivots)
            vectors, own, mine = x[index], key[index], ids[index]
            wide = min(len(index), int(np.ceil(WIDE * every**POWER * len(index) / every)) + 1)
            place = np.arange(len(index))
            for q, order in zip(queries.tolist(), table.column("asks").take(pa.array(queries)).to_pylist(), strict=True):
                rank = files.footrule(np.frombuffer(order, np.uint8)).astype(np.int64) * len(index) + place
                rank[own == key[q]] = np.iinfo(np.int64).max
                near = np.sort(np.argpartition(rank, wide - 1)[:wide])
                near = near[own[near] != key[q]]
                # row by row, so that equal vectors have equal scores
                score = (vectors[near] * x[q]).sum(1)
                best = np.argsort(-score, kind="stable")[:k]
                n = len(best)
                out.append((np.full(n, key[q]), np.full(n, ids[q]), mine[near[best]], score[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(names, cols, strict=True)))

    return group


def search(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (vec_id, embedding) that ``queries`` holds for, its ``k`` nearest found."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.where(whole(vectors) & F.exists("embedding", lambda v: v != 0))
    rows = rows.select(F.monotonically_increasing_id().alias("key"), doc_key("vec_id").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asking"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>").alias("embedding"))
    rows = stage(rows, "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, asking, width, most = rows.agg(F.count("*"), F.count_if("asking"), F.max(F.size("embedding")), F.max(square)).first()
    schema = "asker long, query_id long, vec_id long, score double"
    if n < 2 or not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("embedding").toArrow().column("embedding")
    pivots = Pivots(matrix(sample, width), most)
    index = stage(rows.mapInArrow(_index(pivots, width), T.StructType(rows.schema.fields[:]).add("seen", "binary").add("asks", "binary")), "index")
    size = 8 * width if kind != "float" else 4 * width
    shards, blocks = max(1, -(-n * size // SHARD_BYTES)), max(1, -(-asking * size // BLOCK_BYTES))
    of = lambda name, count, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(count)).cast("long").alias(name)
    all_ = lambda name, count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    posted = index.select(of("shard", shards, 1), all_("block", blocks), "key", "vec_id", "embedding", "seen", F.lit(None).cast("binary").alias("asks"))
    asked = index.where("asking").select(all_("shard", shards), of("block", blocks, 2), "key", "vec_id", "embedding", F.lit(None).cast("binary").alias("seen"), "asks")
    parts = min(shards * blocks, max(partitions(spark), (n * blocks + asking * shards) * size // GROUP_BYTES))
    met = posted.unionByName(asked).repartition(parts, "shard", "block")
    found = met.groupBy("shard", "block").applyInArrow(_search(width, len(pivots.points), n, k), schema)
    nearest = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return found.select(key_back("query_id"), F.col("rank").cast("int").alias("rank"), key_back("vec_id"), "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)
