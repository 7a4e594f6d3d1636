"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: lower case, look-alike letters of other scripts and full-width forms to Latin ones, invisible characters out, digits
and signs that stand in for letters within or before a word to those letters (``l`` and ``i`` fold together, as ``1`` may be
either), everything that is no letter to one space. The lexicon holds whole words and word beginnings with a weight (log odds),
learned from labelled documents; a hit counts once per word, at its highest weight, unless an exception phrase covers it. Exception
phrases are pairs of neighbouring words, one of them a hit, that labelled documents have mostly where they are not toxic; a caller
may add phrases. The sum of weights is divided by the logarithm of the length and turned into a probability by monotone
regression; for that the labelled documents are dealt into folds, and those of a fold are scored with what the others teach.

Null or empty text: no hit, the score of texts without hits. Labels that repeat for a document: the highest. Rows that share an id
count once in what is learned, by one of their texts, and are scored each. No labels at all, or none of these documents: an empty
lexicon and score 0. No documents, no rows. A column ``score`` of the input is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.common import stage

#: The classifier is fitted on a sample of labelled rows: this many at most, chosen by a hash of doc_id.
MAX_TRAIN = 12_000
#: Folds of the labelled documents, for the calibration.
FOLDS = 4
PREFIXES = (4, 5, 6)
#: A pattern enters if the lower bound of its share of toxic documents (Wilson, this z) is over half.
Z = 2.5
THRESHOLD = 0.3
BINS, BIN = 64, 0.25

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
        "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ı": "i", "ɡ": "g", "ɑ": "a",
        "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
        "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
    }
    | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
    | {chr(0xFF10 + i): chr(48 + i) for i in range(10)}
)
# Digits and signs that stand in for letters.
STAND_INS = str.maketrans("013457@$!", "oieastasi")

_inside = re.compile(r"(?<=[^\W\d_])[0-9@$!]+(?=[^\W\d_])|(?<![\w@$!])[0-9@$]+(?=[^\W\d_])")
_odd = re.compile(r"[0-9@$!]")
_other = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The folded text: words of letters between single spaces, with one at both ends."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(LOOK_ALIKES)
    if _odd.search(text):
        text = _inside.sub(lambda m: m[0].translate(STAND_INS), text)
    return f" {_other.sub(' ', text).strip().replace('l', 'i')} "


def patterns_of(folded: str) -> set[str]:
    """What a document may add to the lexicon: its words, and beginnings of longer words."""
    found = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            found.add(f" {w} ")
            found.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return found


class Scorer:
    """A lexicon and its exceptions; ``raw`` is the length-normalised sum of weights."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()):
        import ahocorasick

        self.size = len(weights)
        self.machine = ahocorasick.Automaton()
        for p, w in weights.items():
            self.machine.add_word(p, (len(p), w))
        for e in exceptions:
            self.machine.add_word(p := fold(e), (len(p), None))
        self.machine.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """The highest weight at each place of a folded text, places in exceptions left out."""
        hits: dict[int, float] = {}
        spared = []
        if self.size and len(folded) > 2:
            for end, (n, w) in self.machine.iter(folded):
                start = end - n + 1
                if w is None:
                    spared.append((start, end))
                elif w > hits.get(start, 0.0):
                    hits[start] = w
        if spared:
            covered = bytearray(len(folded))
            for lo, hi in spared:
                covered[lo:hi] = b"\1" * (hi - lo)
            hits = {s: w for s, w in hits.items() if not covered[s]}
        return hits

    def raw(self, text: str) -> float:
        folded = fold(text)
        hits = self.hits(folded)
        return sum(hits.values()) / math.log2(2 + len(folded) / 600) if hits else 0.0

    def phrases(self, text: str) -> set[str]:
        """A document's pairs of neighbouring words of which one is a hit."""
        folded = fold(text)
        found = set()
        for start in self.hits(folded):
            end = folded.index(" ", start + 1)
            word = folded[start + 1 : end]
            before, after = folded[:start].rsplit(" ", 1)[-1] if start else "", folded[end + 1 :].split(" ", 1)[0]
            found.update(x for x in (before and f"{before} {word}", after and f"{word} {after}") if x)
        return found


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(raw / BIN), BINS - 1).astype(int)


def monotone(pos: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Rates per bin, smoothed towards ``base`` and pooled until they never fall."""
    pools: list[list[float]] = []
    for p, k in zip(pos + base, n + 1.0, strict=True):
        pools.append([p, k, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            p2, k2, m2 = pools.pop()
            pools[-1] = [pools[-1][0] + p2, pools[-1][1] + k2, pools[-1][2] + m2]
    return np.concatenate([np.full(int(m), p / k) for p, k, m in pools])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(train: DataFrame, of) -> DataFrame:
    """(pattern, fold, pos, n): toxic documents and all documents with each of the strings ``of()`` finds in a text; '' for all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pos, both = of(), [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]
        for b in batches:
            for text, y, k in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                found = [*find(text), ""]
                both[k].update(found)
                if y:
                    pos[k].update(found)
        for k in range(FOLDS):
            n = len(both[k])
            yield pa.RecordBatch.from_arrays([pa.array([*both[k]], pa.string()), pa.array([k] * n, pa.int32()), pa.array([pos[k][p] for p in both[k]], pa.int64()), pa.array([*both[k].values()], pa.int64())], ["pattern", "fold", "pos", "n"])

    sums = train.mapInArrow(count, "pattern string, fold int, pos long, n long").groupBy("pattern", "fold").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    return stage(sums, "patterns")


def _without(sums: DataFrame, fold: int) -> DataFrame:
    """The sums over all folds but one (-1: over all)."""
    return sums.where(F.col("fold") != fold).groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def _bound(pos: Column, n: Column, side: int) -> Column:
    """The Wilson bound below (side -1) or above (1) of a share."""
    z2, share = Z * Z, pos / n
    return (share + z2 / (2 * n) + side * Z * F.sqrt((share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, exceptions: tuple[str, ...] = ()) -> tuple[dict[str, float], list[float], tuple[str, ...]]:
    """(weights, rate per bin, exception phrases) from labelled documents that aren't held out; ``max_train`` of them at most.

    All patterns and phrases that pass their bound are in the model. Each is in several documents of the sample, which bounds them.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # the first by hash, so that each pass and each retry gets the same ones
    few = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    # bounded by max_train rows of two numbers, so a broadcast; only their texts move, one for each id
    train = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "_id")
    train = stage(train.groupBy("_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")), "train")
    train = train.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(FOLDS)).cast("int"))
    sums = _counted(train, lambda: lambda text: patterns_of(fold(text)))
    lexicons, phrases, base = {}, {}, 0.0
    for k in (-1, *range(FOLDS)):
        low = _bound(F.col("pos"), F.col("n"), -1)
        best = _without(sums, k).withColumn("low", low).where("pattern = '' or low > 0.5").orderBy(F.col("pattern") != "", F.desc("low"), "pattern").collect()
        if not best:
            lexicons[k] = {}
            continue
        rate = (best[0]["pos"] + 0.5) / (best[0]["n"] + 1)
        base = rate if k < 0 else base
        lexicons[k] = {r["pattern"]: math.log((r["pos"] + 0.5) / (r["n"] - r["pos"] + 0.5)) - math.log(rate / (1 - rate)) for r in best[1:]}
    weights = lexicons[-1]
    if not base:
        return {}, [0.0] * BINS, ()
    found = _counted(train, lambda: Scorer(weights).phrases)
    for k in lexicons:
        high = _without(found, k).where("pattern <> ''").withColumn("high", _bound(F.col("pos"), F.col("n"), 1)).where("high < 0.5")
        phrases[k] = exceptions + tuple(r["pattern"] for r in high.orderBy("high", "pattern").collect())

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(lexicons[k], phrases[k]) for k in range(FOLDS)]
        pos, n = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            at = bin_of(np.array([scorers[k].raw(t) for t, k in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]))
            np.add.at(n, at, 1)
            np.add.at(pos, at, b.column("toxic").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(pos), pa.array(n)], ["bin", "pos", "n"])

    got = {r["bin"]: r for r in train.mapInArrow(bins, "bin int, pos double, n double").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()}
    side = lambda c: np.array([got[i][c] if i in got else 0.0 for i in range(BINS)])
    return weights, monotone(side("pos"), side("n"), base).tolist(), phrases[-1]


@lru_cache(maxsize=2)
def _scorer(weights: tuple, exceptions: tuple) -> Scorer:
    return Scorer(dict(weights), exceptions)


def score(docs: DataFrame, model: tuple[dict[str, float], list[float], tuple[str, ...]]) -> DataFrame:
    """``docs`` with ``score``: the probability that a text is toxic."""
    weights, rates, exceptions = tuple(model[0].items()), np.array(model[1]), model[2]
    fields = docs.schema
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name != "score"] + ["score double"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(weights, exceptions)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = np.array([scorer.raw(t or "") for t in part.column("text").to_pylist()])
                at = bin_of(raw)
                # within a bin a little higher for more, never above the next bin's rate
                top = np.maximum(rates[np.minimum(at + 1, BINS - 1)], rates[at])
                p = rates[at] + (top - rates[at]) * 0.5 * np.clip(raw / BIN - at + 1, 0, 1) * (raw > 0)
                names = [n for n in part.schema.names if n != "score"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(np.clip(p, 0, 1))], [*names, "score"])

    return docs.mapInArrow(task, out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
