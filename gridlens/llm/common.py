"""What the operators of this subpackage share: ids, staging, hot keys, vectorised words and hashes, connected components.

Conventions.  Every row is a document of its own. A document's id is a LONG; a null id is carried as ``NULL_ID``, smaller than any,
inside a job and turned back at the end. Rows that share an id, or have none, have no order between them: neither is earlier
than the other. Of rows that are equal in id and text each gets the same result. A null text is an empty text. Columns other
than those an operator names are ignored.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)

#: The white space of every word pattern here: ``[\x20\x09-\x0D]``.
SPACES = b" \t\n\x0b\x0c\r"
#: Text bytes that one vectorised step takes at a time; bounds a task's memory (a longer document is one step).
STEP_BYTES = 2 << 20

#: Bases of the two lanes of Rabin-Karp hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Words of more bytes get a cryptographic digest, others are mixed 8 bytes at a time.
LONG_WORD = 64


# ------------------------------------------------------------------------------------------------ Spark


def doc_key(name: str = "doc_id") -> Column:
    """The id of a row, never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def key_back(name: str, alias: str | None = None) -> Column:
    """The id as it was read."""
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(alias or name)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (never null), ``text`` (never null) and the columns named."""
    return docs.select(doc_key().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


#: Shared ids are known by their hash modulo this, so what is broadcast to tell their rows apart is bounded by as many numbers.
SLOTS = 1 << 20


def told_apart(docs: DataFrame, *more: str) -> DataFrame:
    """``texts`` with ``sub``: 0 where no other row has the id, else a hash of the text that tells the rows of the id apart.

    Ids that only share a slot with a shared one get a hash as well; that costs bytes and changes nothing.
    """
    slot = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    ids = docs.select(doc_key().alias("doc_id")).groupBy("doc_id").count().where("count > 1")
    shared = stage(ids.select(slot().alias("_slot")).distinct().withColumn("_shared", F.lit(True)), "shared")
    rows = texts(docs, *more).withColumn("_slot", slot()).join(F.broadcast(shared), "_slot", "left")
    return rows.select("doc_id", F.when(F.col("_shared"), F.xxhash64("text")).otherwise(F.lit(0)).alias("sub"), "text", *more)


@lru_cache(maxsize=4)
def _own_dir(app: str) -> str:
    there = tempfile.mkdtemp(prefix="gridlens-")
    atexit.register(shutil.rmtree, there, ignore_errors=True)
    return there


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where both are one process may it be unset; the folder is removed at exit then."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir(sc.applicationId)


_folders: WeakKeyDictionary = WeakKeyDictionary()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark's setting for whether a query's shuffle files go when it ends; else they stay until the driver's JVM happens to collect its garbage.
NO_LEFTOVERS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder (``by``: in folders by a column) and read it back: lineage ends here, and a lost executor costs no recomputation.

    What the write shuffled is removed with its end, so the disk holds no more than one step's shuffles beside what is staged.
    """
    spark = df.sparkSession
    path, before = new_path(spark, tag), spark.conf.get(NO_LEFTOVERS, None)
    spark.conf.set(NO_LEFTOVERS, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(NO_LEFTOVERS)
        else:
            spark.conf.set(NO_LEFTOVERS, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that nothing will read any more."""
    for df in staged:
        if path := _folders.pop(df, None):
            sc = df.sparkSession.sparkContext
            there = sc._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Text bytes for each shuffle partition whose rows a task gathers.
PART_BYTES = 8 << 20


def partitions_for(spark: SparkSession, size: int) -> int:
    """Shuffle partitions for so many bytes of text."""
    return max(partitions(spark), -(-size // PART_BYTES))


#: Keys with more than this part of all rows are hot; there are at most as many of them.
HOT = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, count: str = "k", how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) to ``keyed``, which has each key once and in ``count`` how many of the ``total`` rows have it.

    A key of more than a ``HOT``-th of the rows would fill one task. There are at most ``HOT`` of those, so they are broadcast
    and their rows stay where they are; only the rest is dealt by key.
    """
    hot = F.broadcast(keyed.where(F.col(count) * HOT > total).drop(count))
    cold = keyed.where(F.col(count) * HOT <= total).drop(count)
    return rows.join(hot, keys, how).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: ``id``, ``component`` (the smallest id reachable) for each id that has an edge.

    Large-star and small-star in turn; each is a minimum per node, joined back to the edges, with the edges of hubs left where
    they are (``join_hot``). Edges shrink to one per node at the end. Ids may be of any type that has an order.
    """
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        n = e.count()
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        large = stage(join_hot(both, low, ["u"], 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = join_hot(large, low, ["u"], large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        after = stage(small, "stars")
        discard(e, large)
        # done once no node is both somebody's parent and somebody's child: every edge is (node, root)
        if after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and not _two_parents(after):
            return after.select(F.col("u").alias("id"), F.col("v").alias("component")).union(after.select("v", "v").distinct())
        e = after


def _two_parents(e: DataFrame) -> bool:
    return not e.groupBy("u").agg(F.min("v").alias("l"), F.max("v").alias("h")).where("l <> h").isEmpty()


# ------------------------------------------------------------------------------------------- text as arrays


def chunks(batches: Iterator[pa.RecordBatch], size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``size`` text bytes: (rows, bytes of their texts, offsets of each text and the end)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        buf = text.buffers()[2]
        data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def _pow(n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the lane's base, and of its inverse, modulo 2**64."""
    if lane not in _powers or len(_powers[lane][0]) < n:
        made = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers[lane] = made[0], made[1]
    up, down = _powers[lane]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _mix_2(x: np.ndarray) -> np.ndarray:
    """Another way to spread them."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(values: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every ``size`` consecutive values (uint64); each lane has a base of its own."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _pow(n + 1, lane)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=c[1:])
    return mix((c[size:] - c[: n - size + 1]) * down[: n - size + 1])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, is_space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without white space) of concatenated texts: byte starts, byte ends, and each text's first word's index."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~is_space[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the words between these bytes. The two lanes are functions that share nothing, so both make 128 bits.

    A step takes 8 bytes and is no linear function of them: words that differ in letters of one pattern only (which sums of powers
    of a base can't tell apart) differ in their hashes like any others.
    """
    spread, seed, step = ((mix, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25), (_mix_2, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))[lane]
    length = (ends - starts).astype(np.int64)
    h = spread(length.astype(np.uint64) * np.uint64(step) + np.uint64(seed))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at, live = 0, np.flatnonzero((length > 0) & (length <= LONG_WORD))
    while len(live):
        part = eight[starts[live] + at]
        left = length[live] - at
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[live] = spread((h[live] ^ part) * np.uint64(step) if lane else (h[live] + part) * np.uint64(step))
        at += 8
        live = live[left > 8]
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=16).digest()
        h[k] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return h


def inside(offs: np.ndarray, size: int, n: int) -> np.ndarray:
    """For n - size + 1 windows over concatenated sequences: which lie within one sequence."""
    m = n - size + 1
    if m <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(offs[1:], np.diff(offs))[:m]
    return np.arange(size, size + m) <= ends


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """The index of the least of every ``size`` consecutive uint32 values, the first on ties."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.int64)
    m = (values.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    s = 1
    while 2 * s <= size:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if s < size:
        m = np.minimum(m[: n - size + 1], m[size - s : size - s + n - size + 1])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open index ranges of the True runs."""
    x = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(x == 1), np.flatnonzero(x == -1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def merge_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges, as maximal disjoint ones in order."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    if not len(lo):
        return lo, hi
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))]


def pack(cols: list[np.ndarray]) -> tuple[bytes, int]:
    """Columns of numbers as one compressed blob, and its size before."""
    head = np.array([c.nbytes for c in cols], np.int64).tobytes()
    # bytes of a number's column lie together, which packs better
    raw = head + b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in cols)
    return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True), len(raw)


def unpack(blob: bytes, size: int, kinds: list) -> list[np.ndarray]:
    """The columns, of these kinds, that ``pack`` was given."""
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, size, asbytes=True), np.uint8)
    sizes, at, out = raw[: 8 * len(kinds)].view(np.int64), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n].reshape(width, -1).T).reshape(-1).view(kind))
        at += n
    return out
