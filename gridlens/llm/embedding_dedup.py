"""Embedding near-dedup by a subspace pigeonhole join.

Vectors of one label that are equal, component by component, collapse to one. Unit vectors are rotated (random signs and
Walsh-Hadamard, twice) and split into blocks of ``BLOCK`` dimensions. Cosine >= c is a squared distance of at most 2 - 2c, so at
least one block differs by no more than its proportional part of that: its radius, squared. So each block is range-joined:

* Between tasks, a grid over the first dimensions of each block, with cells as wide as two radii; a vector is in the cells
  that half a radius around it touches, 1.5 a dimension on average, and two vectors meet in the cell of the larger low ends. How
  many dimensions follows from the number of vectors of the label, so that cells stay near ``CHUNK``; labels of up to
  ``PARTS`` chunks need no grid, and all blocks are joined in one place. A vector has ``PARTS`` copies at most, or
  8 * 1.5 ** ``DEPTH`` with a grid at its deepest; more only in cells that are dense beyond that.
* In a cell, bit sets: for each dimension of a block and each bucket of its values, the vectors not further than the radius. A
  vector's candidates are the conjunction of its buckets' sets over a block, joined over the blocks; only for these are
  distances computed, exactly, in double precision. No pair leaves the task: what does is the number of links of each vector,
  and a spanning forest.

Cells with more than ``CHUNK`` vectors are cut into chunks, and each pair of chunks is a group of its own.

Labels: equal and not null. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
only vectors of equal length are compared. Every row is a vector of its own, whatever its id and also where rows are equal in
all: such rows link with each other like any others. ``component_id`` is the smallest id, none before all. No rows, no result. FLOAT components are kept, others compared as DOUBLE.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.common import components, doc_key, join_hot, key_back, mix, signed, stage

COSINE = 0.98
BLOCK = 8
CHUNK = 4096
#: Chunks of a label that are joined without a grid.
PARTS = 8
#: Dimensions of a grid at most, and the part of the vectors that the fullest cell of one more dimension holds.
DEPTH, FULLEST = 8, 0.45
BUCKETS = 64
SLACK = 1e-4
#: Vectors whose candidates are found at a time, and pairs verified at a time.
HOMES, PAIRS = 256, 100_000


@lru_cache(maxsize=16)
def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(71).integers(0, 2, (2, width)) * 2.0 - 1.0


def rotate(x: np.ndarray) -> np.ndarray:
    """Unit vectors in a fixed random rotation (padded to a power of two); element by element, so a row's result never depends on the rows around it."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    y /= np.sqrt((y * y).sum(1))[:, None]
    for sign in _signs(width):
        y = y * sign
        h = 1
        while h < width:
            y = y.reshape(len(x), -1, 2, h)
            y = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), 2).reshape(len(x), width)
            h *= 2
        y /= np.sqrt(width)
    return y


def blocks_of(width: int) -> list[slice]:
    return [slice(lo, min(width, lo + BLOCK)) for lo in range(0, width, BLOCK)]


def _budget(block: slice, width: int, cosine: float) -> float:
    return (2 - 2 * cosine + SLACK) * (block.stop - block.start) / width


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _ends(turned: np.ndarray, block: slice, depth: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest cell that half a radius around each vector touches, by dimension of the grid."""
    lead = turned[:, block][:, :depth]
    return np.floor((lead - radius / 2) / (2 * radius)).astype(np.int64), np.floor((lead + radius / 2) / (2 * radius)).astype(np.int64)


def _cells(cosine: float):
    """(key, cell, block, corner): the cells of each vector; the corner has a bit for each dimension where it is the higher cell."""
    names = ["key", "cell", "block", "corner"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([batch.column(c).to_numpy() for c in ("dims", "depth")], 1).astype(np.int64)
            for dims, depth in np.unique(kinds, axis=0).tolist():
                part = batch.filter(pa.array((kinds == (dims, depth)).all(1)))
                key, label = part.column("key").to_numpy(), part.column("label").to_numpy().astype(np.int64)
                seed = mix(label.view(np.uint64) * np.uint64(1_000_003) + np.uint64(dims * 4099))
                if not depth:
                    n = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signed(seed)), pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int32))], names)
                    continue
                turned = rotate(_matrix(part.column("embedding")))
                for b, block in enumerate(blocks_of(turned.shape[1])):
                    low, high = _ends(turned, block, depth, float(np.sqrt(_budget(block, turned.shape[1], cosine))))
                    for corner in range(1 << low.shape[1]):
                        up = np.array([corner >> d & 1 for d in range(low.shape[1])])
                        keep = ((low != high) | (up == 0)).all(1)
                        cell = mix(seed[keep] + np.uint64(b + 1))
                        for d, at in enumerate((low[keep] + up).T):
                            cell = mix(cell ^ mix((at + (d + 1) * 10_000).view(np.uint64).copy()))
                        n = int(keep.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(signed(cell)), pa.array(np.full(n, b, np.int32)), pa.array(np.full(n, corner, np.int32))], names)

    return task


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the least node it is connected with) for the edges a-b."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            return node, node[label]


class RangeSets:
    """For each bucket of the values of a dimension, the set of ``right`` rows that may lie within the radius of a row in it, as bits."""

    def __init__(self, left: np.ndarray, right: np.ndarray, radius: float):
        edges = np.unique(np.quantile(left, np.linspace(0, 1, min(BUCKETS, max(2, len(left) // 4)) + 1)))
        self.bucket = np.clip(np.searchsorted(edges, left, "right") - 1, 0, max(0, len(edges) - 2))
        low, high = edges[:-1] if len(edges) > 1 else edges, edges[1:] if len(edges) > 1 else edges
        near = (right >= low[:, None] - radius - 1e-9) & (right <= high[:, None] + radius + 1e-9)
        bits = np.packbits(near, axis=1, bitorder="little")
        self.sets = np.zeros((len(bits), -(-bits.shape[1] // 8)), np.uint64)
        self.sets.view(np.uint8)[:, : bits.shape[1]] = bits


def candidates(left: np.ndarray, right: np.ndarray, blocks: list[slice], radii: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of left, row of right) of all that may be within the radius in one of the blocks, each pair once."""
    sets = [[RangeSets(left[:, d], right[:, d], r) for d in range(s.start, s.stop)] for s, r in zip(blocks, radii, strict=True)]
    for lo in range(0, len(left), HOMES):
        every = None
        for block in sets:
            both = None
            for s in block:
                found = s.sets[s.bucket[lo : lo + HOMES]]
                both = found if both is None else np.bitwise_and(both, found, out=both)
            every = both if every is None else np.bitwise_or(every, both, out=every)
        octets = every.view(np.uint8)
        i, j = np.nonzero(octets)
        for at in range(0, len(i), PAIRS // 8):
            r, c = i[at : at + PAIRS // 8], j[at : at + PAIRS // 8]
            k, bit = np.nonzero(np.unpackbits(octets[r, c][:, None], axis=1, bitorder="little"))
            yield lo + r[k], c[k] * 8 + bit


def _verify(cosine: float):
    """(key, least, links, other, other_least) of one (cell, i, j): links of each vector, and a spanning forest."""
    names = ["key", "least", "links", "other", "other_least"]

    def joined(x: np.ndarray, part: np.ndarray, corner: np.ndarray, count: np.ndarray, block: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turned = rotate(x)
        width = turned.shape[1]
        blocks = blocks_of(width)
        budget = [_budget(s, width, cosine) for s in blocks]
        chosen = range(len(blocks)) if block < 0 else [block]
        norm = np.sqrt((x * x).sum(1))
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        links, a, b, held = np.zeros(len(x), np.int64), [], [], 0
        for p, q in candidates(turned[left], turned[right], [blocks[k] for k in chosen], [float(np.sqrt(budget[k])) for k in chosen]):
            p, q = left[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            if block >= 0:
                meet = (corner[p] & corner[q]) == 0
                p, q = p[meet], q[meet]
                gap = turned[p] - turned[q]
                gap *= gap
                # the first block that the pair passes is this one
                first = gap[:, blocks[block]].sum(1) <= budget[block]
                for k in range(block):
                    first &= gap[:, blocks[k]].sum(1) > budget[k]
                p, q = p[first], q[first]
            linked = (x[p] * x[q]).sum(1) / (norm[p] * norm[q]) >= cosine
            p, q = p[linked], q[linked]
            np.add.at(links, p, count[q])
            np.add.at(links, q, count[p])
            a.append(p)
            b.append(q)
            held += len(p)
            if held > 10 * PAIRS:
                a, b = ([c] for c in _forest(np.concatenate(a), np.concatenate(b)))
                held = len(a[0])
        if not a:
            return links, np.zeros(0, np.int64), np.zeros(0, np.int64)
        node, root = _forest(np.concatenate(a), np.concatenate(b))
        return links, node[node != root], root[node != root]

    def group(table: pa.Table) -> pa.Table:
        key, least, count, part, corner, block, label, dims, depth = (table.column(c).to_numpy() for c in ("key", "least", "cnt", "part", "corner", "block", "label", "dims", "depth"))
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        # what only shares the cell's hash is kept apart
        kind = np.stack([label, dims, block, depth], 1).astype(np.int64)
        out: list[tuple] = []
        for k in np.unique(kind, axis=0):
            rows = np.flatnonzero((kind == k).all(1))
            x, b, deep = _matrix(table.column("embedding").take(pa.array(rows))), int(k[2]), int(k[3])
            places = np.zeros(len(rows), np.int64)
            if b >= 0:
                turned = rotate(x)
                s = blocks_of(turned.shape[1])[b]
                low, _ = _ends(turned, s, deep, float(np.sqrt(_budget(s, turned.shape[1], cosine))))
                cell = low + (corner[rows][:, None] >> np.arange(low.shape[1]) & 1)
                places = np.unique(cell, axis=0, return_inverse=True)[1].reshape(-1)
            for place in range(int(places.max()) + 1):
                mine = np.flatnonzero(places == place)
                at = rows[mine]
                if len(at) < 2 or not (part[at] == i).any() or not (part[at] == j).any():
                    continue
                links, a, o = joined(x[mine], part[at], corner[at], count[at], b, i, j)
                some = np.flatnonzero(links)
                none = np.zeros(len(some), np.int64)
                out.append((key[at][some], least[at][some], links[some], key[at][some], none))
                out.append((key[at][a], least[at][a], np.zeros(len(a), np.int64), key[at][o], least[at][o]))
        return pa.table(dict(zip(names, (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 5)), strict=True)))

    return group


def near_groups(vectors: DataFrame, cosine: float = COSINE, id: str = "vec_id") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (vec_id, label, embedding)."""
    element = vectors.schema["embedding"].dataType.elementType
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    rows = vectors.select(doc_key(id).alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("embedding", lambda v: v != 0)
    sound = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    valid = rows.where(sound).withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64("embedding", "label")})
    classes = valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("cnt"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = stage(classes.withColumns({"key": F.monotonically_increasing_id(), "dims": F.size("embedding").cast("long")}), "vectors")
    n = classes.count()
    sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("k"))
    deep = F.least(F.lit(DEPTH), F.ceil(F.log(F.col("k") / CHUNK) / float(-np.log(FULLEST))))
    sizes = sizes.withColumn("depth", F.when(F.col("k") <= PARTS * CHUNK, 0).otherwise(deep).cast("long"))
    placed = stage(join_hot(classes, sizes, ["label", "dims"], n).select("key", "label", "dims", "depth", "embedding").mapInArrow(_cells(cosine), "key long, cell long, block int, corner int"), "cells")
    full = placed.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1")
    placed = join_hot(placed, full.withColumn("parts", F.ceil(F.col("k") / CHUNK).cast("int")), ["cell"], placed.count())
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("key", "cell", "block", "corner", "part", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"))
    deep = join_hot(classes, sizes, ["label", "dims"], n).select("key", "least", "cnt", "label", "dims", "depth", "embedding")
    found = placed.join(deep, "key").groupBy("cell", "i", "j").applyInArrow(_verify(cosine), "key long, least long, links long, other long, other_least long")
    found = stage(found, "found")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    node = lambda least, key: F.struct(F.col(least).alias("least"), F.col(key).alias("key"))
    group = components(found.where("key <> other").select(node("least", "key").alias("a"), node("other_least", "other").alias("b")))
    known = classes.join(links, "key", "left").join(group.select(F.col("id.key").alias("key"), F.col("component.least").alias("component_id")), "key", "left")
    known = known.select("h1", "h2", F.col("cnt").alias("k"), (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_hot(valid.select("vec_id", "h1", "h2"), known, ["h1", "h2"], valid.count()).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.select(key_back("vec_id"), "n_links", key_back("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach as (
  select a as id, b as other from link union select r.id, l.b from reach r join link l on r.other = l.a
), n as (select a, count(*) as n_links from link group by a), c as (select id, min(other) as least from reach group by id)
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(c.least, vec_id)) as component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join c on c.id = vec_id
"""
