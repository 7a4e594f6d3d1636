"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; each of its documents then starts with ``target / source size`` copies, and the
fractional parts are rounded in pairs: two documents trade words until one of them is taken or left out as a whole.
Which way they trade is drawn so that each document's expected copies stay what they were, while the sum of the words of
both never changes; so a source's words stay at its target until the last document, whose fraction is drawn alone.
Pairs are made within leaves of about ``LEAF`` documents (largest first, so that what is left over is small), and the one
document that a leaf leaves open goes up a tree of fan-in ``FAN_IN`` until a source has none.

A document with a good part of the words in its leaf, or in its node of the tree, is paired with all the others there at once before
that: one rule for every source and every level.

Draws come from a generator seeded by the leaf's name, and leaves from a hash of what is known of a document (id, source, size, a
caller's own numbers) and its place among those equal in all of it: reruns agree, whatever the partitions, and rows without an id,
or with one id, spread over leaves as others do. Null text: 0 words. Null source: a source of its own, last. Documents without
words are never taken more than 0 words. Every row is a document of its own; no documents, no rows. What the driver holds is one
row per source: weights are a catalogue of sources, and its length is the bound.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.common import stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
LEAF = 1024
FAN_IN = 64
SEED = 17
#: A document with so much of what the others of its leaf hold is paired with all of them at once.
LARGE = 0.02
#: Equal rows are numbered so many at a time.
EQUAL = 4096


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """Split ``total`` by weight; what is above a cap is reshared by weight until none is above."""
    out, left, open_ = [0.0] * len(weights), float(total), set(range(len(weights)))
    while open_ and left > 0:
        w = sum(weights[i] for i in open_)
        if w <= 0:
            break
        full = {i for i in open_ if left * weights[i] / w >= caps[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        open_ -= full
    return out


def _settle_large(sizes: np.ndarray, parts: np.ndarray, rng: np.random.Generator) -> None:
    """Pair each document of a good part of the words with all the others, whose fractions then move by as much, as long as they can.

    A single partner could not take what a dominant document gives, and it would stay open to the end.
    """
    open_ = np.flatnonzero((parts > 0) & (parts < 1))
    for k, i in enumerate(open_[:-1]):
        others = open_[k + 1 :]
        p, s, rest = parts[i], sizes[i], sizes[others].sum()
        if s < LARGE * rest or parts[others].max() + p * s / rest > 1 or parts[others].min() - (1 - p) * s / rest < 0:
            break
        parts[i] = float(rng.random() < p)
        parts[others] += (p - parts[i]) * s / rest


def settle(sizes: np.ndarray, parts: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Round the fractions ``parts`` of documents in this order; without ``last`` one may stay open."""
    out, draws = parts.copy(), rng.random(len(parts) + 1)
    _settle_large(sizes, out, rng)
    i, x, s = -1, 0.0, 0.0  # the open document, its words taken, its size
    for j in range(len(out)):
        y, t = out[j] * sizes[j], float(sizes[j])
        if not 0.0 < out[j] < 1.0:
            continue
        if i < 0:
            i, x, s = j, y, t
            continue
        give, take = min(x, t - y), min(y, s - x)  # words that i can give to j, and take from it
        if draws[j] * (give + take) < take:
            x, y = (0.0, y + x) if x <= t - y else (x - (t - y), t)
        else:
            x, y = (x + y, 0.0) if y <= s - x else (s, y - (s - x))
        if x <= 0.0 or x >= s:
            out[i] = 1.0 if x >= s else 0.0
            i, x, s = (j, y, t) if 0.0 < y < t else (-1, 0.0, 0.0)
            if i < 0:
                out[j] = 1.0 if y >= t else 0.0
        else:
            out[j] = 1.0 if y >= t else 0.0
    if i >= 0:
        out[i] = (1.0 if draws[-1] * s < x else 0.0) if last else x / s
    return out


def _rounder(name: str, last: bool, keys: list[str]):
    def round_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", *keys], ascending=[False] + [True] * len(keys), kind="stable")
        rng = np.random.default_rng(zlib.crc32(f"{name}/{pdf['source'].iloc[0]!r}/{pdf['leaf'].iloc[0]}".encode()))
        return pdf.assign(part=settle(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), rng, last))

    return round_leaf


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> pd.DataFrame:
    """One row per source: ``source, source_size, docs, target``. ``weights``: by source, or a cycle over sources in code-point order."""
    rows = sorted(docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    of = [float(weights[r["source"]]) for r in rows] if isinstance(weights, dict) else [float(weights[k % len(weights)]) for k in range(len(rows))]
    sizes = [int(r["size"]) for r in rows]
    goal = share_out(share * sum(sizes), of, [cap * s for s in sizes])
    return pd.DataFrame({"source": [r["source"] for r in rows], "source_size": sizes, "docs": [int(r["docs"]) for r in rows], "target": goal})


def _numbered(sized: DataFrame) -> DataFrame:
    """``sized`` with ``nth``, the place of a row among those equal to it; so many equal rows that one task must not make them are made by several."""
    names = sized.columns
    groups = sized.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {EQUAL}"))))
    many = F.col("_n") > EQUAL
    lo = F.col("_k") * EQUAL
    nth = F.explode(F.sequence(lo, F.least(lo + EQUAL, F.col("_n")) - 1))
    return groups.where(~many).select(*names, nth.alias("nth")).unionByName(groups.where(many).repartition("_k").select(*names, nth.alias("nth")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every document, and the columns of ``keep``.

    ``keep`` names numbers that tell rows of one doc_id (or of none) apart; leaves go by them too.
    """
    spark = docs.sparkSession
    keys = ["doc_id", *keep, "nth"]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), *keep)
    sized = stage(_numbered(sized), "sizes")
    plan = targets(sized, weights, share, cap)
    if plan.empty:
        return sized.select("doc_id", "source", "size", *[F.lit(0).cast("long").alias(c) for c in ("source_size", "copies", "taken")], F.lit(0.0).alias("target"), *keep)
    schema = "source string, source_size long, target double, whole long, part double, leaves long"
    catalogue = []
    for r in plan.itertuples(index=False):
        copies = r.target / r.source_size if r.source_size else 0.0
        whole = min(math.floor(copies + 1e-12), math.floor(cap))
        catalogue.append((r.source, int(r.source_size), float(r.target), int(whole), max(0.0, copies - whole) if copies - whole > 1e-12 else 0.0, -(-int(r.docs) // LEAF)))
    sources = spark.createDataFrame(catalogue, schema)
    rows = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("part", F.when(F.col("size") > 0, F.col("part")).otherwise(0.0))
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64(*keys, "size"), "leaves")).drop("leaves")
    fields = rows.schema
    most, level, done = max(c[-1] for c in catalogue), 0, []
    while True:
        last = most == 1
        rows = stage(rows.groupBy("source", "leaf").applyInPandas(_rounder(f"{seed}/{level}", last, keys), fields), "rounded")
        done.append(rows.where("part = 0 or part = 1"))
        if last:
            break
        rows = rows.where("part > 0 and part < 1").withColumn("leaf", F.expr(f"leaf div {FAN_IN}"))
        most, level = -(-most // FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    copies = (F.col("whole") + F.col("part")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
