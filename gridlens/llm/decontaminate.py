"""Benchmark decontamination: a BM25 inverted index of test items with block maxima; every training passage is a query.

The items' index goes to the tasks; documents never move and are read once. Its size is checked: items of more than
``SHARD_BYTES`` of text are indexed in shards of about that, one pass over the documents each, one shard at a time: its pairs
are written and its index let go before the next is made, so neither driver nor tasks hold more, however large the benchmark.
What a score depends on (number of items, how many have a word, mean length) and the longest item are counted over all items
before, in a table of which a shard takes its own words, so shards change no result.

A document is read as overlapping passages long enough to hold the longest item whole. A passage is a query of its distinct words.
Impacts are BM25 weights divided by the score an item gets from its own text, so that one threshold fits all items. Posting
lists are in order of items, in blocks of ``BLOCK`` items, each with its highest impact; passages are searched many at a time:

* pivot: a passage's words in ascending order of their highest impact; those before the pivot cannot reach the threshold by
  themselves, so only the lists of the others name blocks, and a passage whose words all lie before it names none;
* block maxima: a block is kept if its own highest impacts, over all of the passage's words, reach the threshold;
* score: the postings in the blocks left, exactly; all items at or above the threshold are retrieved.

Verification: the shares of an item's word 5-grams that the document holds, for the question, the answer and both together. A
document is contaminated by an item if the question and the answer, wherever they are in it, or both as one, have a share of
at least ``OVERLAP``. An item that is not retrieved is not verified: less than half of its weight lies in one passage then.

The answer is the item's last line, or the last quarter of its words if it has one line only, unless the caller names columns.
Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null or empty documents match nothing; items without
words are left out; repeated items are matched each; no items, no match. Every row of documents is judged by itself. Null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.common import chunks, discard, lower_ascii, rolling, signed, stage, word_hashes, words

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
GRAM = 5
BLOCK = 8
#: Bytes of items' text in one index (its arrays take about as much).
SHARD_BYTES = 32 << 20
PASSAGE = 64
#: Passages that are searched at a time; bounds a task's memory.
PASSAGES = 2048

_NO_WORD = np.ones(256, bool)
_NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = False


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lower_ascii(data)
    starts, ends, first = words(data, offs, _NO_WORD)
    return (word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _tokens(raw, np.array([0, len(raw)]))[0]


def grams(h: np.ndarray) -> np.ndarray:
    """Distinct hashes of the 5-grams, of all words if there are fewer."""
    return np.unique(rolling(h, min(GRAM, max(1, len(h))))) if len(h) else np.zeros(0, np.uint64)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item given as one text."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    w = text.split()
    cut = len(w) - max(1, len(w) // 4) if w else 0
    return " ".join(w[:cut]), " ".join(w[cut:])


def _item(*given: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the question and the answer of an item given as two texts or as one."""
    q, a = given if len(given) == 2 else split_item(given[0] or "")
    return _hashes(q or ""), _hashes(a or "")


class Statistics(NamedTuple):
    """What is counted over all items that have words: how many, their mean and greatest length, the items that have each term (of those a shard has)."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch (term, items that have it), and one row without a term: items, their words, words of the longest."""
    for b in batches:
        parts = [np.concatenate(_item(*given)) for given in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        parts = [h for h in parts if len(h)]
        if parts:
            terms, df = np.unique(np.concatenate([np.unique(h) for h in parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(df.astype(np.int64)), pa.nulls(len(df), pa.int64()), pa.nulls(len(df), pa.int64())], ["term", "items", "words", "longest"])
            sizes = [len(h) for h in parts]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, len(sizes), sum(sizes), max(sizes))], ["term", "items", "words", "longest"])


def statistics(items: DataFrame) -> tuple[Statistics, DataFrame]:
    """The sums over all items, and the table (term, items); ``items`` has the columns of text only."""
    rows = items.mapInArrow(_count, "term long, items long, words long, longest long").groupBy("term")
    rows = stage(rows.agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "terms")
    every, none = rows.where("term is null").collect(), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not every:
        return Statistics(0, 1.0, 0, *none), rows
    return Statistics(every[0]["items"], every[0]["words"] / every[0]["items"], every[0]["longest"], *none), rows


def _own_terms(every: Statistics, table: DataFrame, items: list[tuple]) -> Statistics:
    """``every`` with the counts of the terms of these items."""
    own = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, *parts in items for h in parts)]))
    asked = table.sparkSession.createDataFrame(pa.table({"term": pa.array(signed(own))}))
    got = table.join(asked, "term", "left_semi").toArrow()
    terms = got["term"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(terms)
    return every._replace(terms=terms[order], df=got["items"].to_numpy().astype(np.int64)[order])


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, index in it) of all indices in these ranges."""
    count = end - start
    of = np.repeat(np.arange(len(start)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(value, first)


class Index:
    """Posting lists of some items; ``every`` counts all items, of other shards too."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], every: Statistics):
        items = sorted((x for x in items if len(x[1]) + len(x[2])), key=lambda x: len(x[1]) + len(x[2]))  # items alike in length share a block
        self.ids = [x[0] for x in items]
        self.longest = every.longest
        self.parts = [(grams(np.concatenate((q, a))), grams(q), grams(a)) for _, q, a in items]
        self.gram_sizes = [{min(GRAM, len(x)) for x in (q, a, np.concatenate((q, a))) if len(x)} for _, q, a in items]
        found = [np.unique(np.concatenate((q, a)), return_counts=True) for _, q, a in items]
        term = np.concatenate([t for t, _ in found]) if items else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(t) for t, _ in found])
        n = np.concatenate([c for _, c in found]) if items else np.zeros(0, np.int64)
        length = np.array([len(q) + len(a) for _, q, a in items], np.float64)
        df = every.df[np.searchsorted(every.terms, term)] if items else n
        weight = np.log(1 + (every.items - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * (length[item] if items else 0.0) / every.mean))
        own = np.bincount(item, weights=weight, minlength=len(items))
        order = np.lexsort((item, term))
        self.terms, which = np.unique(term[order], return_inverse=True)
        self.item, self.impact = item[order], (weight / own[item])[order]
        # blocks: a list's postings of BLOCK neighbouring items, with their highest impact; their key is term and block
        self.blocks = -(-len(items) // BLOCK)
        key = which.reshape(-1) * self.blocks + self.item // BLOCK
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.block_key, self.block_start, self.block_end = key[first], first, np.append(first[1:], len(key)).astype(np.int64)
        self.block_top = np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        self.list_start = np.searchsorted(self.block_key, np.arange(len(self.terms)) * self.blocks)
        self.list_end = np.append(self.list_start[1:], len(self.block_key)).astype(np.int64)
        self.top = np.maximum.reduceat(self.block_top, self.list_start) if len(self.terms) else self.impact

    def retrieve(self, passage: np.ndarray, term: np.ndarray, count: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above the threshold; ``passage`` and ``term`` are the known words of ``count`` passages, in order."""
        least = threshold - 1e-9
        order = np.lexsort((self.top[term], passage))
        passage, term = passage[order], term[order]
        reach = np.cumsum(self.top[term])
        start = np.searchsorted(passage, np.arange(count + 1))
        before = np.concatenate(([0.0], reach))[start[:-1]]
        reach -= before[passage]
        names = reach >= least  # from the pivot on
        of, at = _spread(self.list_start[term[names]], self.list_end[term[names]])
        pair = np.unique(passage[names][of] * self.blocks + self.block_key[at] % self.blocks)
        near, block = np.divmod(pair, self.blocks)
        # the bound of each named block, over all words of its passage
        of, at = _spread(start[near], start[near + 1])
        want = term[at] * self.blocks + block[of]
        place = np.minimum(np.searchsorted(self.block_key, want), len(self.block_key) - 1)
        held = self.block_key[place] == want
        of, place = of[held], place[held]
        bound = np.bincount(of, weights=self.block_top[place], minlength=len(pair))
        live = bound[of] >= least
        of, place = of[live], place[live]
        number, at = _spread(self.block_start[place], self.block_end[place])
        key, score = _sums(near[of[number]] * max(1, len(self.ids)) + self.item[at], self.impact[at])
        key, score = key[score >= least], score[score >= least]
        return key // max(1, len(self.ids)), key % max(1, len(self.ids)), score

    def search(self, h: np.ndarray, first: np.ndarray, threshold: float) -> dict[tuple[int, int], float]:
        """The best score of each (document's row, item) that some passage retrieves."""
        step = max(PASSAGE, self.longest)
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(1, -(-(n - 2 * step) // step) + 1), 0)
        row = np.repeat(np.arange(len(n)), count)
        best: dict[tuple[int, int], float] = {}
        if not len(row) or not len(self.terms):
            return best
        lo = first[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * step
        hi = np.minimum(lo + 2 * step, first[1:][row])
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == h)
        a, b = np.searchsorted(known, lo), np.searchsorted(known, hi)
        for s in range(0, len(row), PASSAGES):
            e = min(s + PASSAGES, len(row))
            of, place = _spread(a[s:e], b[s:e])
            passage, term = np.divmod(np.unique(of * len(self.terms) + at[known[place]]), len(self.terms))
            if not len(passage):
                continue
            for p, item, score in zip(*(x.tolist() for x in self.retrieve(passage, term, e - s, threshold)), strict=True):
                pair = int(row[s + p]), item
                best[pair] = max(best.get(pair, 0.0), score)
        return best

    def matches(self, data: np.ndarray, offs: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
        """(document's row, item_id, score, shares of both, question and answer) of all that are contaminated."""
        h, first = _tokens(data, offs)
        out, held = [], {}
        for (row, item), score in sorted(self.search(h, first, threshold).items()):
            mine = h[first[row] : first[row + 1]]
            for k in self.gram_sizes[item]:
                if (row, k) not in held:
                    held[row, k] = np.unique(rolling(mine, k))
            seen = np.concatenate([held[row, k] for k in self.gram_sizes[item]])
            both, question, answer = (float(np.isin(g, seen).mean()) if len(g) else 0.0 for g in self.parts[item])
            if both >= overlap or min(question, answer) >= overlap:
                out.append((row, self.ids[item], score, both, question, answer))
        return out


class Shards(NamedTuple):
    """The items, which of ``count`` shards each is in, and what is counted over all."""

    items: DataFrame
    count: int
    every: Statistics
    terms: DataFrame

    def index(self, k: int) -> Index:
        rows = self.items.where(F.col("_shard") == k).drop("_shard")
        items = [(r[0], *_item(*r[1:])) for r in rows.orderBy(*rows.columns).collect()]
        return Index(items, _own_terms(self.every, self.terms, items))


def indexes(benchmark: DataFrame, question: str | None = None, answer: str | None = None, shard_bytes: int = SHARD_BYTES) -> Shards:
    """The items in as many shards as their size asks for."""
    cols = [question, answer] if question and answer else ["text"]
    size = sum(x or 0 for x in benchmark.agg(*[F.sum(F.octet_length(c)).alias(c) for c in cols]).first())
    shards = max(1, -(-size // shard_bytes))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), *cols).withColumn("_shard", F.pmod(F.xxhash64("item_id", *cols), F.lit(shards)))
    return Shards(stage(items, "items", "_shard"), shards, *statistics(benchmark.select(*cols)))


def find_leaks(docs: DataFrame, shards: Shards, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, item_id, score, overlap, question_overlap, answer_overlap`` of every document and item that it leaks."""
    names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    rows, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for k in range(shards.count):
        sent = docs.sparkSession.sparkContext.broadcast(shards.index(k))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part, data, offs in chunks(batches):
                got = index.matches(data, offs, threshold, overlap)
                if got:
                    cols = list(zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names)

        part = rows.mapInArrow(task, schema)
        if shards.count > 1:
            part = stage(part, "leaks")
            sent.destroy()
        found = part if found is None else found.union(part)
    return found


def drop_leaks(docs: DataFrame, shards: Shards, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the contaminated documents."""
    for k in range(shards.count):
        sent = docs.sparkSession.sparkContext.broadcast(shards.index(k))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part, data, offs in chunks(batches):
                keep = np.ones(part.num_rows, bool)
                keep[[m[0] for m in index.matches(data, offs, threshold, overlap)]] = False
                yield part.filter(pa.array(keep))

        left = docs.mapInArrow(task, docs.schema)
        if shards.count > 1:
            left = stage(left, "left")
            sent.destroy()
            if k:
                discard(docs)
        docs = left
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
