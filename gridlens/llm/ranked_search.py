"""Ranked lexical search: for each item the documents of highest score, by branch and bound over a tree of maxima.

1. Index: documents are cut into ranges of ``RANGE_DOCS`` at most (fewer if they hold many postings). A range keeps, for the terms that some item
   has, (document, occurrences), and of each document its id and number of terms. Documents are read and cut into terms once.
2. Counts: the number of documents with a term and of all terms, and in how many documents each of the items' terms is. With these
   every posting has its impact, the whole-number share of the score that the term gives the document.
3. Search, range by range: each term has a tree over the range's documents (``FAN`` children a node) whose nodes hold the highest impact
   below them. A node's bound for an item is the sum over its terms. Best first, the node of highest bound is opened, which gives
   its children's bounds by the same sum; a document's bound is its score. Documents of a range are in order of length, so that those of a
   node are alike in impact. A node below the score of the item's ``k``-th best is never
   opened; one of equal bound is, as it may hold a document of that score with a smaller id. What is best is carried from range to
   range in a task, so that most trees end at their root.
4. The best of all tasks are put together by item.

Terms are maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased, told apart by 128 bits of hash. Items are searched in
shards of ``SHARD_BYTES`` of text, one pass over the documents each, so that what is sent to the tasks and held by the driver is bounded
whatever the number of items. Every row of items is an item of its own, and every row of documents a document, whatever their ids;
null ids stay null and come first among equals. Null or empty texts have no terms: such documents count for nothing, such items find nothing.
Repeated terms of an item count once. No documents or no items: no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.common import chunks, discard, doc_key, key_back, lower_ascii, pack, stage, texts, unpack, word_hashes, words

K = 10
RANGE_DOCS = 4096
#: Postings from which a range is closed; bounds a task's memory.
RANGE_POSTINGS = 1 << 20
FAN = 16
#: Nodes that are opened in a step.
TOGETHER = 16
SHARD_BYTES = 4 << 20

_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KINDS = [np.int64, np.int64, np.int32, np.int32, np.int32]


class Terms(NamedTuple):
    """Distinct terms of some items, by the first half of their hash; and for each item its row number and its terms."""

    first: np.ndarray
    second: np.ndarray
    items: list[tuple[int, np.ndarray]]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which terms they are."""
        if not len(starts) or not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.first, h), len(self.first) - 1)
        hit = np.flatnonzero(self.first[at] == h)
        hit = hit[self.second[at[hit]] == word_hashes(data, starts[hit], ends[hit], 1)]
        return hit, at[hit]


def terms_of(rows: list[tuple[int, str]]) -> Terms:
    """The terms of items given as (row number, text)."""
    text = [t.encode() for _, t in rows]
    data = lower_ascii(np.frombuffer(b"".join(text), np.uint8))
    starts, ends, first = words(data, np.cumsum([0, *map(len, text)]), _NO_TERM)
    h = [word_hashes(data, starts, ends, lane) if len(starts) else np.zeros(0, np.uint64) for lane in (0, 1)]
    known, at = np.unique(np.stack(h, 1), axis=0, return_inverse=True)
    at = at.reshape(-1)
    return Terms(known[:, 0].copy(), known[:, 1].copy(), [(n, np.unique(at[first[k] : first[k + 1]])) for k, (n, _) in enumerate(rows)])


def _build(sent):
    """(docs, terms, postings, blob, size): ranges of documents with their postings, in order of term and document."""
    names = ["docs", "terms", "postings", "blob", "size"]

    def close(held: list[tuple]) -> pa.RecordBatch:
        base, ids, sizes, term, doc, tf = 0, [], [], [], [], []
        for i, n, t, d, f in held:
            ids.append(i)
            sizes.append(n)
            term.append(t)
            doc.append(d + base)
            tf.append(f)
            base += len(i)
        ids, sizes, term, doc, tf = (np.concatenate(c) for c in (ids, sizes, term, doc, tf))
        by_length = np.argsort(sizes, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_length] = np.arange(len(ids))
        ids, sizes, doc = ids[by_length], sizes[by_length], place[doc]
        order = np.lexsort((doc, term))
        blob, size = pack([ids, sizes, term[order].astype(np.int32), doc[order].astype(np.int32), tf[order].astype(np.int32)])
        return pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([int(sizes.sum())]), pa.array([len(term)]), pa.array([blob], pa.binary()), pa.array([size])], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, docs, postings = sent.value, [], 0, 0
        for part, data, offs in chunks(batches):
            data = lower_ascii(data)
            starts, ends, first = words(data, offs, _NO_TERM)
            hit, term = known.find(data, starts, ends)
            size, ids = np.diff(first), part.column("doc_id").to_numpy()
            keep = np.flatnonzero(size > 0)  # documents without terms are none
            place = np.cumsum(size > 0) - 1
            doc = place[np.searchsorted(first, hit, "right") - 1]
            # a row of the table at a time would be slow: a chunk's documents are cut where a range is full
            key, tf = np.unique(doc * max(1, len(known.first)) + term, return_counts=True)
            doc, term = np.divmod(key, max(1, len(known.first)))
            for lo in range(0, len(keep), RANGE_DOCS):
                hi = min(lo + RANGE_DOCS, len(keep))
                a, b = np.searchsorted(doc, (lo, hi))
                if docs and (docs + hi - lo > RANGE_DOCS or postings + b - a > RANGE_POSTINGS):
                    yield close(held)
                    held, docs, postings = [], 0, 0
                held.append((ids[keep[lo:hi]], size[keep[lo:hi]], term[a:b], doc[a:b] - lo, tf[a:b]))
                docs, postings = docs + hi - lo, postings + b - a
        if docs:
            yield close(held)

    return task


class Counts(NamedTuple):
    """Over all documents: those with terms, their terms with repeats, and how many documents hold each of the shard's terms."""

    docs: int
    terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * n + 1))) for n in self.df.tolist()], np.int64)

    def impacts(self, weight: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a term of this weight gives a document of so many terms; all whole numbers."""
        if len(size) and int(size.max()) * 90 * self.docs >= 2**63:
            length = np.array([10 + 90 * n * self.docs // self.terms for n in size.tolist()], np.int64)
        else:
            length = 10 + (90 * size * self.docs) // max(1, self.terms)
        return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * length))


def count(index: DataFrame, terms: int) -> Counts:
    """Sums over the index; what comes to the driver is a row for each term of the shard's items."""
    docs, all_terms = index.agg(F.sum("docs"), F.sum("terms")).first()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, np.int64)
        for batch in batches:
            for blob, size in zip(batch.column("blob").to_pylist(), batch.column("size").to_pylist(), strict=True):
                n += np.bincount(unpack(blob, size, _KINDS)[2], minlength=terms)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    got = index.select("blob", "size").mapInArrow(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(terms, np.int64)
    df[got.column("term").to_numpy().astype(np.int64)] = got.column("n").to_numpy()
    return Counts(docs or 0, all_terms or 0, df)


class MaxTree:
    """For each term the highest impact under every node of a tree over documents 0..n-1; only nodes with a posting are kept.

    Level 0 are the documents. A level is the sorted keys ``term * nodes + node`` with their values, so the children of a node are
    neighbours in each term's part of the level below.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n: int):
        self.nodes, self.keys, self.values = [n], [term.astype(np.int64) * n + doc], [impact]
        while self.nodes[-1] > 1 or len(self.nodes) == 1:
            nodes = -(-self.nodes[-1] // FAN)
            node = self.keys[-1] % self.nodes[-1] // FAN
            key = self.keys[-1] // self.nodes[-1] * nodes + node
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            self.values.append(np.maximum.reduceat(self.values[-1], first) if len(first) else self.values[-1])
            self.keys.append(key[first])
            self.nodes.append(nodes)
        self.top = len(self.nodes) - 1

    def bounds(self, terms: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
        """Summed maxima of these terms for the children of some nodes of a level: a row of ``FAN`` for each node."""
        n, keys = self.nodes[level - 1], self.keys[level - 1]
        low = (terms * n + nodes[:, None] * FAN).ravel()
        start = np.searchsorted(keys, low)
        size = np.searchsorted(keys, np.minimum(low + FAN, ((terms + 1) * n)[None, :].repeat(len(nodes), 0).ravel())) - start
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        out = np.zeros(len(nodes) * FAN, np.int64)
        np.add.at(out, keys[at] % n - np.repeat(np.repeat(nodes * FAN - np.arange(len(nodes)) * FAN, len(terms)), size), self.values[level - 1][at])
        return out.reshape(-1, FAN)

    def search(self, terms: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Put what is better into ``best``, a heap of (score, -id) of k at most; returns the number of nodes opened.

        ``TOGETHER`` nodes of one level at most are opened in a step, the next in order of bound, none below the k-th best score.
        """
        opened, queue = 0, [(-(1 << 62), -self.top, 0)]
        while queue:
            least = best[0][0] if len(best) == k else 1
            bound, level, node = heapq.heappop(queue)
            if -bound < least:
                break
            nodes = [node]
            while queue and len(nodes) < TOGETHER and queue[0][1] == level and -queue[0][0] >= least:
                nodes.append(heapq.heappop(queue)[2])
            opened += len(nodes)
            nodes, level = np.array(nodes), -level
            bounds = self.bounds(terms, level, nodes)
            row, child = np.nonzero(bounds >= least)
            found, child = bounds[row, child], nodes[row] * FAN + child
            if level > 1:
                for x in zip((-found).tolist(), [1 - level] * len(found), child.tolist(), strict=True):
                    heapq.heappush(queue, x)
            else:  # documents, and their scores
                for score, doc in zip(found.tolist(), ids[child].tolist(), strict=True):
                    put(best, score, doc, k)
        return opened


def put(best: list[tuple[int, int]], score: int, doc: int, k: int) -> None:
    if len(best) < k:
        heapq.heappush(best, (score, -doc))
    elif (score, -doc) > best[0]:
        heapq.heapreplace(best, (score, -doc))


def _search(sent, counts: Counts, k: int):
    """(item, doc_id, score): a task's best for each item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = sent.value, counts.weights()
        best: list[list[tuple[int, int]]] = [[] for _ in known.items]
        for batch in batches:
            for blob, size in zip(batch.column("blob").to_pylist(), batch.column("size").to_pylist(), strict=True):
                ids, sizes, term, doc, tf = unpack(blob, size, _KINDS)
                tree = MaxTree(term, doc, counts.impacts(weight[term], tf.astype(np.int64), sizes[doc]), len(ids))
                for (_, terms), held in zip(known.items, best, strict=True):
                    tree.search(terms, ids, held, k)
        rows = [(n, -doc, score) for (n, _), held in zip(known.items, best, strict=True) for score, doc in held]
        cols = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    return task


def search(docs: DataFrame, items: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` (item_id, text) its ``k`` documents of highest score above 0."""
    spark = docs.sparkSession
    rows = texts(docs)
    asked = stage(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, found = max(1, -(-size // shard_bytes)), None
    for s in range(shards):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == s).select("item", "text").collect()
        known = terms_of([tuple(r) for r in mine])
        sent = spark.sparkContext.broadcast(known)
        index = stage(rows.mapInArrow(_build(sent), "docs long, terms long, postings long, blob binary, size long"), "postings")
        best = index.select("blob", "size").mapInArrow(_search(sent, count(index, len(known.first)), k), "item long, doc_id long, score long")
        if shards > 1:
            best = stage(best, "best")
            sent.destroy()
            discard(index)
        found = best if found is None else found.union(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = found.join(asked.select("item", "item_id"), "item")
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), key_back("doc_id"), "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
with d as materialized (select doc_id, {_WORDS} as w from documents), size as (select doc_id, len(w) as n from d where len(w) > 0),
every as (select count(*) as docs, sum(n)::bigint as terms from size),
q as (select item_id, list_distinct({_WORDS}) as w from benchmark), asked as (select item_id, unnest(w) as term from q),
tf as materialized (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d) where term in (select term from asked) group by all),
weight as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from tf, every group by term, docs),
impact as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) as x from tf join weight using (term) join size using (doc_id), every),
score as (select item_id, doc_id, sum(x)::bigint as score from asked join impact using (term) group by item_id, doc_id having sum(x) > 0)
select item_id, rank, doc_id, score from (select item_id, doc_id, score, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from score) where rank <= {K}
"""
