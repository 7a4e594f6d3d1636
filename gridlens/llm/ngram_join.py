"""N-gram Jaccard join: blocked sparse products of document by n-gram incidence, and the components of the links.

1. Documents with the same set of shingles collapse to one within a task (a task's rows of a group of copies are one).
2. Blocks: two sets with Jaccard similarity t differ in at most ``d = (1-t)/(1+t) * (|x|+|y|)`` shingles. Dealing all shingles
   to ``d + 1 + SPARE`` classes by hash, one class at least is equal in both, and with the spare ones a non-empty one unless both
   have more than SPARE empty classes, in which case empty ones count too. d depends on size, so a document deals its
   shingles for its size band and for the next; a pair that can link is in one band or in neighbouring ones. What is
   equal in a class meets by hash (shingles that very many documents have are left out, which the bound allows). Up to
   ``FEW`` documents that meet are pairs, and stay candidates if the parities of their shingles' counts by hash differ in no more
   than d places, a lower bound of what the sets differ in; more of them are candidates as a star. The components of the
   candidates are the blocks.
3. In a block the incidence matrix of documents by shingles that at least two of them hold is multiplied with its transpose,
   block of columns by block of columns, which accumulates the overlap counts. After each, pairs are discarded whose overlap,
   with all that is left of the smaller of both, stays below the bound that their sizes give, and documents without a pair
   leave the product; what remains after the last is linked. Counts are whole numbers.
   Blocks over ``TILE`` documents are cut into tiles and every pair of tiles is a task: first each with the first tile, and
   only where that leaves more than one component, all others. A tile pair returns a spanning forest of its links, not the pairs.
4. The components of those edges are the answer, whatever the number of links in a group.

Words are ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased. Fewer words than a shingle: the whole sequence is one. No words
(null, empty): an empty set, linked with nothing. Every row is a document of its own, whatever its id; a component is named by the
smallest doc_id in it, and no id is smaller than any. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.common import chunks, components, discard, inside, join_hot, key_back, lower_ascii, mix, pack, partitions, partitions_for, rolling, signed, stage, texts, unpack, word_hashes, words

SIZE = 4
PERCENT = 85
SPARE = 3
TILE = 256
SLAB = 8192
#: Shingles that a sample of documents finds in more than this share of them take no part in dealing; their number is bounded by
#: the shingles of a document over this share. It steers which documents meet by chance, not which pairs can be found.
COMMON = 0.002
SAMPLE_DOCS = 8000
#: So many documents that meet are taken pair by pair.
FEW = 8
#: Text bytes from which a task pre-aggregates and hands on what it has.
HOLD_BYTES = 6 << 20
#: Shingles in blocks that are multiplied together.
HOLD_SHINGLES = 1_000_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's distinct shingles, ordered by row and hash."""
    data = lower_ascii(data)
    starts, ends, first = words(data, offs)
    n, count = len(starts), np.diff(first)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(data, starts, ends)
    rows, hashes = [], []
    for k in range(1, size + 1):
        found = rolling(h, k)
        pos = np.flatnonzero(inside(first, k, n)) if k <= n else np.zeros(0, np.int64)
        row = np.searchsorted(first, pos, "right") - 1
        if k < size:  # a text of k words only
            pos, row = pos[count[row] == k], row[count[row] == k]
        rows.append(row)
        hashes.append(found[pos] ^ mix(np.full(len(pos), k, np.uint64)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))
    return row[new], h[new]


def bands(most: int, percent: int) -> np.ndarray:
    """The first size of each band; sizes that can link are in one band or in neighbouring ones."""
    first = [1]
    while first[-1] <= most:
        first.append(first[-1] * 100 // percent + 1)
    return np.array(first, np.int64)


def differ_most(n, percent: int):
    """How many shingles two sets of ``n`` together may differ in and still link."""
    return n * (100 - percent) // (100 + percent)


def classes_of(last: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes for sets of up to ``last`` shingles, and the spare ones among them: more than a set leaves empty by chance."""
    t = percent / 100
    empty = np.exp(-t * t * (1 + t) / (2 * (1 - t)) / 1.1) if t < 1 else 0.0
    d = differ_most(2 * last, percent)
    spare = np.where(d > 0, SPARE + np.ceil(1.2 * empty * d + 3 * np.sqrt(empty * d)).astype(np.int64), 0)
    return d + 1 + spare, spare


def common_shingles(rows: DataFrame, n: int, size: int, share: float = COMMON, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Sorted hashes of the shingles in more than ``share`` of a bounded sample of ``n`` documents."""
    few = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(1, n))))
    least = max(8, int(share * min(n, sample_docs)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [shingle_sets(data, offs, size)[1] for _, data, offs in chunks(batches)]
        if found:
            h, k = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(k)], ["h", "n"])

    got = few.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("h").toArrow()
    return np.sort(got.column("h").to_numpy().astype(np.int64).view(np.uint64))


_names = ["key", "kind", "doc_id", "other", "n", "blob", "size"]
_ROW = "key long, kind byte, doc_id long, other long, n long, blob binary, size long"
#: Signatures to bring together; candidates for certain; candidates by pairs; a document, its chief, set size and parities.
MEET, NEAR, PAIR, SAME = 0, 1, 2, 3
#: Buckets of signatures per shuffle partition.
BUCKETS = 4


def _rows(key: np.ndarray, kind: int, doc: np.ndarray, other: np.ndarray, n: np.ndarray | None = None, blob: pa.Array | None = None) -> pa.RecordBatch:
    n = np.zeros(len(doc), np.int64) if n is None else n
    blob = pa.nulls(len(doc), pa.binary()) if blob is None else blob
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(doc), kind, np.int8)), pa.array(doc), pa.array(other), pa.array(n), blob, pa.nulls(len(doc), pa.int64())], _names)


def _blobs(key: np.ndarray, doc: np.ndarray, many: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted (signature, document, whether it stands for many) by bucket of the signature, a blob for each."""
    bucket = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((key.view(np.uint64), bucket))
    key, doc, many, bucket = key.view(np.uint64)[order], doc[order], many[order], bucket[order]
    at = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    packed = [pack([np.diff(key[lo:hi], prepend=np.uint64(0)), doc[lo:hi], many[lo:hi]]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
    m = len(packed)
    none = pa.nulls(m, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), pa.array(np.full(m, MEET, np.int8)), none, none, none, pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.int64())], _names)


def _spread(doc: np.ndarray, other: np.ndarray) -> np.ndarray:
    return signed(mix(doc.view(np.uint64) * np.uint64(3) + other.view(np.uint64)))


def _groups(key: np.ndarray, doc: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows by key and document, each once; the number of each row's group, its size, and whether it stands for many."""
    order = np.lexsort((doc, key))
    key, doc, many = key[order], doc[order], many[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    keep = new | np.concatenate(([True], doc[1:] != doc[:-1]))
    group = (np.cumsum(new) - 1)
    flag = np.zeros(int(group[-1]) + 1, bool)
    flag[group[many > 0]] = True
    key, doc, group = key[keep], doc[keep], group[keep]
    size = np.bincount(group)
    return key, doc, group, size, flag | (size > FEW)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (larger, smaller) of different documents, each once."""
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def parities(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set, whether the number of its shingles in each of 2^k hash classes is odd, as bits; 2^k is at least its size."""
    bits = np.where(n > 0, 1 << np.maximum(3, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)), 0)
    at = np.cumsum(bits) - bits
    cell = at[row] + (mix(h ^ np.uint64(0x9FB21C651E98DF25)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(cell, minlength=int(bits.sum())) & 1).astype(np.uint8)
    raw = np.packbits(odd, bitorder="little").tobytes()
    return [raw[a : a + k] for a, k in zip((at // 8).tolist(), (bits // 8).tolist(), strict=True)]


def _differ(a: bytes, b: bytes) -> int:
    """In how many shingles two sets differ at least."""
    while len(a) != len(b):  # fold the longer one
        a, b = (a, b) if len(a) > len(b) else (b, a)
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "little") ^ int.from_bytes(a[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def _close_enough(percent: int):
    """The pairs (doc_id, other) that their parities don't rule out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            most = differ_most(n + m, percent).tolist()
            keep = [_differ(a, b) <= d for a, b, d in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), most, strict=True)]
            yield batch.select(["doc_id", "other"]).filter(pa.array(keep, pa.bool_()))

    return task


def _signatures(size: int, percent: int, buckets: int, common: np.ndarray):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        base, rows, hashes, ids = 0, [], [], []
        for row, h, doc in held:
            rows.append(row + base)
            hashes.append(h)
            ids.append(doc)
            base += len(doc)
        row, h, doc = np.concatenate(rows), np.concatenate(hashes), np.concatenate(ids)
        m = len(doc)
        n = np.bincount(row, minlength=m).astype(np.int64)
        one, two = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        np.add.at(one, row, mix(h))
        np.add.at(two, row, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
        # documents with the same set, within this task
        order = np.lexsort((doc, n, two, one))
        new = np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0) | (np.diff(n[order]) != 0)))
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        chief = np.empty(m, np.int64)
        chief[order] = head
        other = np.where(n > 0, doc[chief], doc)
        yield _rows(_spread(doc, other), SAME, doc, other, n, pa.array(parities(row, h, n), pa.binary()))
        live = (chief == np.arange(m)) & (n > 0)
        if not live.any():
            return
        mine = live[row] & ~np.isin(h, common)
        row, h = row[mine], h[mine]
        first = bands(int(n.max()), percent)
        band = np.searchsorted(first, n, "right") - 1
        deal = mix(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(20)
        value = mix(h + np.uint64(0x632BE59BD9B4E019))
        keys, docs = [], []
        for up in (0, 1):
            group = band + up
            classes, spare = classes_of(first[group] * 100 // percent, percent)
            width = np.where(live, classes, 0)
            at = np.cumsum(width) - width
            cell = at[row] + (deal % width[row].astype(np.uint64)).astype(np.int64)
            total, filled = np.zeros(int(width.sum()), np.uint64), np.zeros(int(width.sum()), bool)
            np.add.at(total, cell, value)
            filled[cell] = True
            owner = np.repeat(np.arange(m), width)
            empty = width - np.bincount(owner[filled], minlength=m)
            send = filled | (empty > spare)[owner]
            place = np.arange(len(owner)) - at[owner]
            keys.append(mix(total[send] ^ mix((group[owner[send]] * 1_000_003 + place[send] + 1).astype(np.uint64))))
            docs.append(doc[owner[send]])
        key, who, group, size, many = _groups(signed(np.concatenate(keys)), np.concatenate(docs), np.zeros(sum(map(len, keys)), np.int8))
        # of many documents of one signature the smallest stands for all
        lead = np.concatenate(([True], group[1:] != group[:-1]))
        send = lead | ~many[group]
        yield _blobs(key[send], who[send], many[group[send]].astype(np.uint8), buckets)
        a, b = _pairs(who[~send], who[np.flatnonzero(lead)][group[~send]])
        if len(a):
            yield _rows(_spread(a, b), NEAR, a, b)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for part, data, offs in chunks(batches):
            held.append((*shingle_sets(data, offs, size), part.column("doc_id").to_numpy()))
            size_held += len(data)
            if size_held >= HOLD_BYTES:
                yield from flush(held)
                held, size_held = [], 0
        if held:
            yield from flush(held)

    return task


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: dict[int, list] = {}
    for b in batches:
        kind = b.column("kind").to_numpy()
        rest = b.filter(pa.array(kind != MEET))
        if rest.num_rows:
            yield rest
        part = b.filter(pa.array(kind == MEET))
        for bucket, *blob in zip(*(part.column(c).to_pylist() for c in ("key", "blob", "size")), strict=True):
            met.setdefault(bucket, []).append(blob)
    while met:
        parts = [unpack(*blob, [np.uint64, np.int64, np.uint8]) for blob in met.popitem()[1]]
        key = signed(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]))
        key, doc, group, size, many = _groups(key, *(np.concatenate([p[k] for p in parts]) for k in (1, 2)))
        first = np.cumsum(size) - size
        a, b = _pairs(doc, np.where(many[group], doc[first[group]], doc))
        if len(a):
            yield _rows(a, NEAR, a, b)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(2, FEW + 1):
            at = first[(size == k) & ~many]
            i, j = np.triu_indices(k, 1)
            left.append(doc[at[:, None] + i].ravel())
            right.append(doc[at[:, None] + j].ravel())
        a, b = _pairs(np.concatenate(left), np.concatenate(right))
        if len(a):
            yield _rows(a, PAIR, a, b)


def link_block(hashes: np.ndarray, row: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """For the documents of one block: the smallest document, by row, that each is linked to through others."""
    b = len(n)
    label = np.arange(b)
    kinds, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = count > 1
    if not shared.any():
        return label
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, row = place[column[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
    overlap, left = np.zeros((b, b), np.int32), np.bincount(row, minlength=b)
    alive = np.minimum(left[:, None], left[None, :]) >= need
    np.fill_diagonal(alive, False)
    for lo in range(0, int(column[-1]) + 1, SLAB):
        live = np.flatnonzero(alive.any(1))
        if not len(live):
            break
        i, j = np.searchsorted(column, (lo, lo + SLAB))
        place = np.full(b, -1)
        place[live] = np.arange(len(live))
        mine = place[row[i:j]]
        slab = np.zeros((len(live), min(SLAB, int(column[-1]) + 1 - lo)), np.float32)
        slab[mine[mine >= 0], column[i:j][mine >= 0] - lo] = 1
        at = np.ix_(live, live)
        overlap[at] += (slab @ slab.T).astype(np.int32)  # exact: a slab has fewer columns than float32 counts
        left -= np.bincount(row[i:j], minlength=b)
        alive[at] &= overlap[at] + np.minimum(left[live][:, None], left[live][None, :]) >= need[at]
    while True:
        lower = np.where(alive, label[None, :], b).min(1)
        lower = np.minimum(label, lower)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return label
        label = lower


def _multiply(size: int, percent: int):
    """(doc_id, other): spanning forests of the links in each (block, i, j); its rows come sorted by these."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        base, rows, hashes, ids, blocks = 0, [], [], [], []
        for row, h, doc, block in held:
            rows.append(row + base)
            hashes.append(h)
            ids.append(doc)
            blocks.append(block)
            base += len(doc)
        row, h, doc, block = np.concatenate(rows), np.concatenate(hashes), np.concatenate(ids), np.concatenate(blocks)
        n = np.bincount(row, minlength=len(doc)).astype(np.int64)
        at = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
        edge = np.searchsorted(row, at)
        a, b = [], []
        for lo, hi, i, j in zip(at[:-1], at[1:], edge[:-1], edge[1:], strict=True):
            label = link_block(h[i:j], row[i:j] - lo, n[lo:hi], percent)
            moved = np.flatnonzero(label != np.arange(hi - lo))
            a.append(doc[lo + moved])
            b.append(doc[lo + label[moved]])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["doc_id", "other"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, serial, last = [], 0, 0, None
        for part, data, offs in chunks(batches):
            key = np.stack([part.column(c).to_numpy() for c in ("block", "i", "j")], 1)
            new = np.concatenate(([last is None or (key[0] != last).any()], (key[1:] != key[:-1]).any(1)))
            block, last = serial + np.cumsum(new), key[-1]
            serial = int(block[-1])
            held.append((*shingle_sets(data, offs, size), part.column("doc_id").to_numpy(), block))
            count += len(held[-1][0])
            if count >= HOLD_SHINGLES and block[0] != block[-1]:
                # all but the block that may go on
                row, h, doc, block = held.pop()
                cut = int(np.searchsorted(block, block[-1]))
                k = int(np.searchsorted(row, cut))
                yield from flush([*held, (row[:k], h[:k], doc[:cut], block[:cut])])
                held, count = [(row[k:] - cut, h[k:], doc[cut:], block[cut:])], len(row) - k
        if held:
            yield from flush(held)

    return task


def _links(placed: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within each (block, i, j) of documents placed there."""
    placed = placed.repartition(partitions(placed.sparkSession), "block", "i", "j").sortWithinPartitions("block", "i", "j", "doc_id")
    return placed.mapInArrow(_multiply(size, percent), "doc_id long, other long")


def row_groups(rows: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (the smallest doc_id reachable by links) of rows with a number of their own each; staged, and all it was made of is removed."""
    spark = rows.sparkSession
    docs, bytes_ = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    rows = texts(rows)
    p = partitions_for(spark, bytes_ or 0)
    sent = rows.mapInArrow(_signatures(size, percent, p * BUCKETS, common_shingles(rows, docs, size)), _ROW).repartition(p, "key")
    met = stage(sent.mapInArrow(_meet, _ROW).drop("key", "size"), "met")
    same = met.where(F.col("kind") == SAME).select("doc_id", "other", "n")
    # joins that grow with the corpus: one plan at every size, by merging
    sketch = met.where((F.col("kind") == SAME) & (F.col("n") > 0)).select("doc_id", "n", F.col("blob").alias("x"))
    pairs = met.where(F.col("kind") == PAIR).select("doc_id", "other").distinct()
    pairs = pairs.join(sketch.hint("merge"), "doc_id").join(sketch.hint("merge").select(F.col("doc_id").alias("other"), F.col("n").alias("m"), F.col("x").alias("y")), "other")
    close = pairs.mapInArrow(_close_enough(percent), "doc_id long, other long")
    near = met.where(F.col("kind") == NEAR).select("doc_id", "other").union(close)

    block = components(near, "doc_id", "other")
    sizes = block.groupBy(F.col("component").alias("block")).agg(F.count("*").alias("members")).withColumn("k", F.col("members"))
    tiled = join_hot(block.select(F.col("id").alias("doc_id"), F.col("component").alias("block")), sizes, ["block"], block.count())
    tiles = F.ceil(F.col("members") / TILE).cast("long")
    tiled = tiled.select("doc_id", "block", tiles.alias("tiles"), F.pmod(F.xxhash64("doc_id"), tiles).alias("tile"))
    # the texts of candidates move once; what comes after reads them from there
    asked = stage(rows.join(tiled.hint("merge"), "doc_id"), "candidates")
    zero = F.lit(0).cast("long")
    # each tile with the first; the first tile's documents go to all of them
    to = F.when(F.col("tile") == 0, F.sequence(F.least(F.lit(1), F.col("tiles") - 1), F.col("tiles") - 1)).otherwise(F.array("tile"))
    links = [stage(_links(asked.select("doc_id", "text", "block", zero.alias("i"), F.explode(to).alias("j")), size, percent), "links")]
    large = asked.where("tiles > 2").select("doc_id", "block")
    if not large.isEmpty():
        part = components(links[0], "doc_id", "other")
        parts = large.join(part, large.doc_id == part.id, "left").select("block", F.coalesce("component", large.doc_id).alias("part"))
        open_ = parts.groupBy("block").agg(F.min("part").alias("l"), F.max("part").alias("h")).where("l <> h").select("block")
        rest = asked.where("tiles > 2 and tile > 0").join(open_, "block")
        rest = rest.select("doc_id", "text", "block", "tile", F.explode(F.sequence(zero + 1, F.col("tiles") - 1)).alias("k"))
        rest = rest.select("doc_id", "text", "block", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"))
        links.append(stage(_links(rest, size, percent), "links"))
    discard(asked)
    group = components(reduce(DataFrame.union, [*links, same.where("doc_id <> other").select("doc_id", "other")]), "doc_id", "other")
    out = same.join(group, same.doc_id == group.id, "left")
    out = stage(out.select(same.doc_id, F.col("n").alias("n_shingles"), F.coalesce("component", same.doc_id).alias("component_id")), "groups")
    discard(met, *links)
    return out


def join_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (the smallest doc_id reachable by links) per row of ``docs``."""
    rows = stage(texts(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = row_groups(rows.select(F.col("row").alias("doc_id"), "text"), size, percent).withColumnRenamed("doc_id", "row")
    found = found.join(rows.select("row", "doc_id"), "row").drop("row")
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("k"))
    out = join_hot(found, least, ["component_id"], rows.count())
    return out.select(key_back("doc_id"), "n_shingles", key_back("least", "component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), p as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from p),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach as (select a as id, b as other from link union select r.id, l.b from reach r join link l on r.other = l.a),
c as (select id, min(other) as least from reach group by id)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) as component_id from d left join n using (doc_id) left join c on c.id = d.doc_id
"""
