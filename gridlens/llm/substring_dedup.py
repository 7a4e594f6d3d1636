"""Substring dedup over word windows: Rabin-Karp hashes of every fixed-length window, counted in Spark.

1. Every window of ``size`` words has an anchor: the word 8-gram of least hash in it. Equal windows have equal anchors, so a
   window can repeat in another document only if its anchor does. Spark counts anchors (about one per 22 words): least and
   greatest doc_id by hash.
2. Documents get back which of their anchors repeat. Every window on such an anchor is hashed (two rolling hashes of
   different bases over different word hashes, 128 bits in all), and Spark finds each hash's least doc_id: a window of a greater one is removed.
3. A document's repeated windows merge into maximal removal intervals of words.

Before either shuffle a task keeps one row per hash (the smallest document) and says at once what it knows to repeat, so a
passage of a third of all documents is as many rows as there are tasks. Words are ``[^\x20\x09-\x0D]+``. Null text: no words.
Texts shorter than a window lose nothing. Repeats within one document only lose nothing. No id is smaller than any. Rows that
share a doc_id, or have none, are documents with no order between them: none loses what another of them has too. No
documents, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.common import chunks, inside, join_hot, key_back, merge_ranges, mix, partitions_for, rolling, signed, sliding_argmin, stage, told_apart, word_hashes, words

WINDOW = 50
GRAM = 8
#: Rows that a task gathers before it pre-aggregates and hands them on; bounds its memory.
HOLD = 1_000_000


def _anchored(data: np.ndarray, offs: np.ndarray, size: int, twice: bool = False) -> tuple:
    """Of each whole window: its first word, its document's row, its anchor's hash, its own hash, and (``twice``) another one."""
    starts, ends, first = words(data, offs)
    n = len(starts)
    if n < size:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
    h = word_hashes(data, starts, ends)
    gram = min(GRAM, size)
    grams = rolling(h, gram)
    at = sliding_argmin((grams >> np.uint64(32)).astype(np.uint32), size - gram + 1)
    pos = np.flatnonzero(inside(first, size, n))
    row = np.searchsorted(first, pos, "right") - 1
    other = rolling(word_hashes(data, starts, ends, 1), size, 1)[pos] if twice else h[:0]
    return pos - first[row], row, grams[at[pos]], rolling(h, size)[pos] if twice else h[:0], other


def _batch(schema: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema)


def _new(*cols: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = False
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def _anchor_rows(size: int):
    """(h, doc_id, sub, told): one row per anchor and task, and one (told) per document of an anchor that this task knows to repeat."""
    names = ["h", "doc_id", "sub", "told"]

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, doc, sub = (np.concatenate(c) for c in zip(*held, strict=True))
        h = signed(h)
        order = np.lexsort((sub, doc, h))
        h, doc, sub = h[order], doc[order], sub[order]
        keep = _new(h, doc, sub)
        h, doc, sub = h[keep], doc[keep], sub[keep]
        first = np.flatnonzero(_new(h))
        last = np.append(first[1:], len(h)) - 1
        group = np.repeat(np.arange(len(first)), last - first + 1)
        told = (doc[first] != doc[last])[group]
        # documents that share the least id are told apart: each needs to hear of smaller ids elsewhere
        send = ~told
        send[first] = True
        yield _batch(names, h[send], doc[send], sub[send], np.zeros(send.sum(), bool))
        yield _batch(names, h[told], doc[told], sub[told], np.ones(told.sum(), bool))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for part, data, offs in chunks(batches):
            ids, subs = part.column("doc_id").to_numpy(), part.column("sub").to_numpy()
            _, row, anchor, _, _ = _anchored(data, offs, size)
            if not len(row):
                continue
            new = _new(anchor, row)
            held.append((anchor[new], ids[row[new]], subs[row[new]]))
            count += int(new.sum())
            if count >= HOLD:
                yield from flush(held)
                held, count = [], 0
        if held:
            yield from flush(held)

    return task


def _window_rows(size: int):
    """(h1, h2, doc_id, sub, starts, hi): windows to count, a row for each hash and document; and ranges of window starts (one
    start, and hi, which is else -1) that this task found repeated, under a hash of their own."""
    names = ["h1", "h2", "doc_id", "sub", "starts", "hi"]

    def batch(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, sub: np.ndarray, starts: np.ndarray, first: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(starts)), pa.int32()), pa.array(starts))
        return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(doc), pa.array(sub), lists, pa.array(hi)], names)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, sub, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        h1, h2 = signed(h1), signed(h2)
        order = np.lexsort((pos, sub, doc, h2, h1))
        h1, h2, doc, sub, pos = h1[order], h2[order], doc[order], sub[order], pos[order]
        new = _new(h1, h2)
        again = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        if again.any():
            d, s, lo, hi = _ranges(doc[again], sub[again], pos[again])
            spread = signed(mix(d.view(np.uint64) ^ mix(lo.view(np.uint64).copy())))
            yield batch(spread, np.full(len(d), -1), d, s, lo, np.arange(len(d)), hi)
        h1, h2, doc, sub, pos = h1[~again], h2[~again], doc[~again], sub[~again], pos[~again]
        first = np.flatnonzero(_new(h1, h2, doc, sub))
        yield batch(h1[first], h2[first], doc[first], sub[first], pos, first, np.full(len(first), -1, np.int64))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for part, data, offs in chunks(batches):
            ids, subs = part.column("doc_id").to_numpy(), part.column("sub").to_numpy()
            wanted = np.unique(part.column("hs").flatten().to_numpy())
            pos, row, anchor, h1, h2 = _anchored(data, offs, size, twice=True)
            hit = np.isin(signed(anchor), wanted)
            if hit.any():
                held.append((h1[hit], h2[hit], ids[row[hit]], subs[row[hit]], pos[hit]))
                count += int(hit.sum())
            if count >= HOLD:
                yield from flush(held)
                held, count = [], 0
        if held:
            yield from flush(held)

    return task


def _ranges(doc: np.ndarray, sub: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive positions of a document, as (doc, sub, first, one past the last)."""
    order = np.lexsort((pos, sub, doc))
    doc, sub, pos = doc[order], sub[order], pos[order]
    new = _new(doc, sub)
    new[1:] |= pos[1:] > pos[:-1] + 1
    at = np.flatnonzero(new)
    return doc[at], sub[at], pos[at], pos[np.append(at[1:] - 1, len(pos) - 1)] + 1


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sub, lo, hi) of batches of repeated windows; those side by side as one."""
    names = ["doc_id", "sub", "lo", "hi"]
    for b in batches:
        doc, sub, hi = (b.column(c).to_numpy() for c in ("doc_id", "sub", "hi"))
        offs = b.column("starts").offsets.to_numpy().astype(np.int64)
        values = b.column("starts").values.to_numpy()
        told = hi >= 0
        if told.any():
            yield _batch(names, doc[told], sub[told], values[offs[:-1][told]], hi[told])
        count = np.where(told, 0, np.diff(offs))
        if count.sum():
            each = np.arange(count.sum()) + np.repeat(offs[:-1] - (np.cumsum(count) - count), count)
            yield _batch(names, *_ranges(np.repeat(doc, count), np.repeat(sub, count), values[each]))


def repeated_windows(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, sub, spans``: ranges (lo, hi) of the starts of windows that a smaller doc_id also has; ``rows`` are told apart."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    p = partitions_for(rows.sparkSession, total)
    anchors = stage(rows.mapInArrow(_anchor_rows(size), "h long, doc_id long, sub long, told boolean"), "anchors")
    asked = anchors.where("not told")
    twice = asked.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("h", "k")
    wanted = join_hot(asked.select("doc_id", "sub", "h"), twice, ["h"], asked.count(), how="left_semi").unionByName(anchors.where("told").select("doc_id", "sub", "h"))
    wanted = wanted.groupBy("doc_id", "sub").agg(F.collect_list("h").alias("hs"))
    hashed = rows.join(wanted, ["doc_id", "sub"]).mapInArrow(_window_rows(size), "h1 long, h2 long, doc_id long, sub long, starts array<long>, hi long")
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    found = hashed.repartition(p, "h1", "h2").withColumn("least", least).where("hi >= 0 or doc_id > least")
    found = found.select("doc_id", "sub", "starts", "hi").mapInArrow(_spans, "doc_id long, sub long, lo long, hi long")
    return found.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _cut(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            spans = batch.column("spans")
            for k, text in enumerate(batch.column("text")):
                tokens = (text.as_py() or "").encode().split()
                n, kept, gone = len(tokens), tokens, 0
                if spans[k].is_valid:
                    flat = spans[k].values
                    lo, hi = merge_ranges(flat.field("lo").to_numpy(), flat.field("hi").to_numpy() + size - 1)
                    kept, at = [], 0
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        kept += tokens[at:a]
                        gone, at = gone + min(b, n) - a, b
                    kept += tokens[at:]
                joined = b" ".join(kept)
                for c, v in zip(out, (n, gone, hashlib.sha256(joined).hexdigest(), joined.decode() if gone else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return task


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and ``kept``, the words left (null where nothing was removed)."""
    rows = told_apart(docs)
    out = rows.join(repeated_windows(rows, size), ["doc_id", "sub"], "left").select("doc_id", "text", "spans")
    out = out.mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumn("doc_id", key_back("doc_id"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("kept")


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as i from d
), s as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from win),
least as (select s, min(doc_id) as m from s group by s having min(doc_id) <> max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as pos from s join least using (s) where doc_id > m),
x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
k as (select x.doc_id, count(*) as n_words, count(gone.pos) as n_removed, coalesce(string_agg(word, ' ' order by x.pos) filter (where gone.pos is null), '') as kept
  from x left join gone on x.doc_id = gone.doc_id and x.pos = gone.pos group by x.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""
