"""Token counts by rank-synchronous merging of byte pairs.

A task splits its texts into pre-tokens, looks up those it has counted before, and encodes the rest together: all
of them lie in one ragged numpy array of symbols, and in each round every pre-token applies its own lowest-ranked pair
(all places of it, from the left, without overlap) at the same time. What is left of a pre-token when no pair of it has
a rank is its count. Each round shrinks the array; finished pre-tokens leave it.

Null text: empty, 0 tokens. Every row is counted, whatever its id; no documents, no rows; other columns are left out. The table of
counted pre-tokens of a task is emptied when it holds ``CACHE`` entries, and pre-tokens of over ``LONG`` characters aren't put in,
so that memory doesn't follow the vocabulary of the corpus. A vocabulary file of another kind is refused.
"""

from __future__ import annotations

import json
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 512
#: Pre-tokens whose counts one Python worker remembers.
CACHE = 1_000_000
LONG = 64
#: What a vocabulary file must say for its counts to be those of this module.
KIND = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte (public convention)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


class PairMerger:
    """Merge ranks of a byte-level BPE vocabulary, and the counts they give."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k, v in KIND.items() if model.get(k, v) != v and not (v is None and model.get(k) == "")]
        odd += [k for k, v in (("type", "ByteLevel"), ("add_prefix_space", False), ("use_regex", True)) if split.get(k) != v]
        odd += ["normalizer"] if spec.get("normalizer") else []
        odd += [t["content"] for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
        if odd:
            raise ValueError(f"{path} is no plain byte-level vocabulary: {', '.join(odd)}")
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.first = np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.first[b] = vocab[c]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.rank = pairs[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], np.int64(1) << 40)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols that each pre-token ends with."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        out = lengths.copy()
        none = np.int64(1) << 40
        sym = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), lengths)
        rank = np.full(len(sym), none)
        same = seq[1:] == seq[:-1]
        rank[:-1][same] = self.ranks(sym[:-1][same], sym[1:][same])
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate((starts, [len(sym)])))
            done = least == none
            out[seq[starts[done]]] = sizes[done]
            if done.all():
                break
            if done.any():
                live = np.repeat(~done, sizes)
                sym, seq, rank = sym[live], seq[live], rank[live]
                least, sizes = least[~done], sizes[~done]
            hit = rank == np.repeat(least, sizes)
            # a run of overlapping places (a pair of two equal symbols): take every other one, from the left
            at = np.flatnonzero(hit)
            new = np.concatenate(([True], np.diff(at) != 1))
            within = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            at = at[within % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            at = place[at]
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            stale = np.unique(np.concatenate((at, at[at > 0] - 1)))
            rank[stale] = none
            stale = stale[stale + 1 < len(sym)]
            stale = stale[seq[stale] == seq[stale + 1]]
            rank[stale] = self.ranks(sym[stale], sym[stale + 1])
        return out


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import regex

    merger = PairMerger(path)
    pattern = regex.compile(public_tokenizers.PATTERN)
    special = regex.compile("|".join(map(regex.escape, sorted(merger.special, key=len, reverse=True)))) if merger.special else None
    return merger, pattern, special, {}


def count_texts(path: str, strings: list[str]) -> list[int]:
    """Tokens of each text; a special string inside a text is one token, as the library's default has it."""
    merger, pattern, special, known = _encoder(path)
    found, extra = [], []
    for text in strings:
        parts = special.split(text) if special else [text]
        extra.append(len(parts) - 1)
        found.append(pattern.findall(text) if len(parts) == 1 else [t for p in parts for t in pattern.findall(p)])
    if len(known) > CACHE:
        known.clear()
    new = list(set().union(*found) - known.keys()) if found else []
    counted = known
    if new:
        counts = dict(zip(new, merger.count([t.encode() for t in new]).tolist(), strict=True))
        long = {t: n for t, n in counts.items() if len(t) > LONG}
        known.update((t, n) for t, n in counts.items() if t not in long)
        counted = ChainMap(known, long) if long else known
    return [n + sum(map(counted.__getitem__, tokens)) for n, tokens in zip(extra, found, strict=True)]


def count_tokens(docs: DataFrame, path: str, limit: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                strings = [t or "" for t in part.column("text").to_pylist()]
                n = count_texts(path, strings)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in strings], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(tokenizer))
