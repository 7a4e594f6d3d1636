"""Suffix dedup: remove every byte that lies in a 100-byte string which also starts earlier in the corpus.

A distributed merge sort of suffixes that keeps what it knows about common prefixes:

* Only the suffixes at anchors are sorted: the anchor of a 100-byte window is its 20-byte gram of least hash, so equal windows
  have it at the same offset, and a run of neighbouring windows shares one. A record is the suffix from the anchor on, as far as
  its windows reach, and the bytes before it, backwards.
* Where records come thick (text that repeats itself every few bytes), windows that equal the one a short period before are
  repeats at once, and no records are made of them.
* A task sorts its records into runs of ``RUN_RECORDS`` at most, keeps the earliest of equal ones (the windows of the others are
  repeats, whole), cuts the runs at splitters, front-codes them (length of the prefix shared with the suffix before, and the
  rest) and sends them off.
* The other side merges the runs of a range with a loser tree that compares the known common prefix lengths first and
  bytes only beyond them, never the known prefixes; the merged sequence comes out with its longest common prefixes.
* Suffixes that share 20 bytes or more form a group. At each offset of the anchor in a window, two records of a group hold the
  same window if they agree on so many bytes to the right (prefix lengths) and to the left; all but the earliest are repeats.

Anchors that a sample finds in a large share of all records (a passage in very many contexts) would fill one range: their
windows are sent one by one instead, by a hash of all 100 bytes. The sample steers only where records go, not results.

Order is doc_id (no id before all others), then the byte at which a string starts. Null text: no bytes. Texts under 100 bytes lose
nothing. Matches never cross documents. Rows that share a doc_id, or have none, are documents with no order between them: none
loses what another of them has too, whatever their texts. No documents, no rows. A long text is read in pieces that overlap by
99 bytes; no window is lost between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.common import STEP_BYTES, byte_values, chunks, inside, key_back, merge_ranges, mix, pack, partitions_for, rolling, signed, sliding_argmin, told_apart, unpack

LENGTH = 100
GRAM = 20
BACK = LENGTH - GRAM
#: Text bytes from which a task makes sorted runs, and records of a run at most.
RUN_BYTES = 6 << 20
RUN_RECORDS = 1 << 18
#: Ranges per shuffle partition, sampled documents that place them, and anchors of each at most.
RANGES = 4
SAMPLE_DOCS = 2000
SAMPLE_ANCHORS = 512
#: Records for each byte from which a text is looked at for short periods.
THICK = 1 / 16
_sent = ["bucket", "run", "size", "doc_id", "sub", "lo", "hi"]
SENT = "bucket long, run binary, size long, doc_id long, sub long, lo long, hi long"


def _periodic(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each window start: whether its text also has the window some 1 to ``GRAM`` - 1 bytes earlier."""
    n, m = len(data), len(data) - LENGTH + 1
    found = np.zeros(m, bool)
    for p in range(1, GRAM):
        same = np.zeros(n - p + 1, np.int32)
        np.cumsum(data[p:] == data[:-p], out=same[1:])
        hit = same[LENGTH:] - same[: n - p + 1 - LENGTH] == LENGTH  # of the starts from p on
        edge = (offs[:, None] + np.arange(p)).ravel() - p  # the window before would be of another text
        hit[edge[(edge >= 0) & (edge < len(hit))]] = False
        found[p:] |= hit
    return found


def _records(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per record: its document's row, first window, last window and anchor, as byte positions in ``data``; and window starts that repeat, by row."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return (none,) * 6
    grams = (rolling(byte_values(data), GRAM) >> np.uint64(32)).astype(np.uint32)
    at = sliding_argmin(grams, LENGTH - GRAM + 1)
    del grams
    pos = np.flatnonzero(inside(offs, LENGTH, n))
    if not len(pos):
        return (none,) * 6
    gone = none
    anchor = at[pos]
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    if new.sum() > THICK * n:
        again = _periodic(data, offs)[pos]
        gone, pos = pos[again], pos[~again]
        anchor = at[pos]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (pos[1:] != pos[:-1] + 1)))
    new = np.flatnonzero(new)
    last = np.concatenate((new[1:] - 1, [len(pos) - 1]))
    row = np.searchsorted(offs, pos[new], "right") - 1
    return row, pos[new], pos[last], anchor[new], np.searchsorted(offs, gone, "right") - 1, gone


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offs in chunks(batches):
        row, first, last, anchor, _, _ = _records(data, offs)
        if len(anchor):
            start = np.searchsorted(row, row)
            step = np.bincount(row)[row] // SAMPLE_ANCHORS + 1
            few = (np.arange(len(row)) - start) % step == 0
            first, last, anchor = first[few], last[few], anchor[few]
            grams = sliding_window_view(data, GRAM)[anchor]
            whole = rolling(byte_values(data), LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(signed(whole[first] ^ mix(whole[last].copy())))], ["gram", "context"])


def place(rows: DataFrame, docs: int, buckets: int, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of the ranges, and the grams of anchors that come in too many contexts for one.

    From about ``sample_docs`` rows, whatever their ids, and ``SAMPLE_ANCHORS`` of each: so much at most comes to the driver.
    """
    few = rows.sample(min(1.0, sample_docs / max(1, docs)), seed=5)
    got = few.mapInArrow(_sample, "gram binary, context long").distinct().toArrow()
    grams = np.array([g.ljust(GRAM, b"\0") for g in got.column("gram").to_pylist()], f"S{GRAM}")
    if not len(grams):
        return np.zeros(0, f"S{GRAM}"), grams
    grams.sort()
    kinds, count = np.unique(grams, return_counts=True)
    hot = kinds[count > max(8, len(grams) * RANGES / (2 * buckets))]
    rest = grams[~np.isin(grams, hot)]
    cut = rest[(np.arange(1, buckets) * len(rest)) // buckets] if len(rest) else rest
    return np.unique(cut), hot


_kinds = [np.uint8, np.uint8, np.uint8, np.int64, np.int64, np.int64, np.uint8, np.uint8]


def _told(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Ranges of window starts that are known to be repeats, each dealt to a bucket of its own."""
    doc, sub, lo, hi = _joined(doc, sub, lo, hi)
    m = len(doc)
    bucket = signed(mix(doc.view(np.uint64) + lo.view(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), *map(pa.array, (doc, sub, lo, hi))], _sent)


def _make_runs(buckets: int, cuts: np.ndarray, hot: np.ndarray):
    """Sorted, front-coded runs of a task's records, by bucket; and the ranges of window starts it knows to be repeats."""

    def run(data: np.ndarray, doc: np.ndarray, sub: np.ndarray, zero: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((anchor - zero, sub, doc))
        doc, sub, zero, first, last, anchor, bucket = (x[order] for x in (doc, sub, zero, first, last, anchor, bucket))
        n = len(doc)
        right, left = last + LENGTH - anchor, anchor - first
        key = np.zeros((n, 4 + LENGTH + BACK), np.uint8)
        key[:, :4] = bucket.astype(">u4").view(np.uint8).reshape(n, 4)
        key[:, 4 : 4 + LENGTH] = sliding_window_view(data, LENGTH)[anchor]
        key[:, 4 : 4 + LENGTH][np.arange(LENGTH) >= right[:, None]] = 0
        key[:, 4 + LENGTH :] = sliding_window_view(data, BACK)[anchor - BACK][:, ::-1]
        key[:, 4 + LENGTH :][np.arange(BACK) >= left[:, None]] = 0
        order = np.argsort(key.view(f"S{key.shape[1]}").reshape(-1), kind="stable")
        key = key[order]
        doc, sub, bucket, right, left = doc[order], sub[order], bucket[order], right[order], left[order]
        at, first, last = (anchor - zero)[order], (first - zero)[order], (last - zero)[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]).any(1) | (right[1:] != right[:-1]) | (left[1:] != left[:-1])))
        # of equal records the earliest; one for each document that shares its id
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        one = new | ((doc == least) & np.concatenate(([False], sub[1:] != sub[:-1])))
        head = np.flatnonzero(one)[np.cumsum(one) - 1]
        gone = ~one & ((doc != doc[head]) | (sub != sub[head]) | (at != at[head]))
        if gone.any():
            yield _told(doc[gone], sub[gone], first[gone], last[gone] + 1)
        suffix, before = key[one, 4 : 4 + LENGTH], key[one, 4 + LENGTH :]
        doc, sub, bucket, right, left, at = doc[one], sub[one], bucket[one], right[one], left[one], at[one]
        n = len(doc)
        prefix = np.zeros(n, np.int64)
        differ = suffix[1:] != suffix[:-1]
        prefix[1:] = np.where(differ.any(1), differ.argmax(1), LENGTH)
        ends = np.concatenate((np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [n]))
        prefix[np.concatenate(([0], ends[:-1]))] = 0
        tail = (np.arange(LENGTH) >= prefix[:, None]) & (np.arange(LENGTH) < right[:, None])
        side = np.arange(BACK) < left[:, None]
        out, lo = [[], [], []], 0
        for hi in ends.tolist():
            part = slice(lo, hi)
            blob, size = pack([prefix[part].astype(np.uint8), right[part].astype(np.uint8), left[part].astype(np.uint8), doc[part], sub[part], at[part], suffix[part][tail[part]], before[part][side[part]]])
            for c, v in zip(out, (int(bucket[lo]), blob, size), strict=True):
                c.append(v)
            lo = hi
        m = len(out[0])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), *[pa.nulls(m, pa.int64())] * 4], _sent)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        data = np.concatenate([np.zeros(BACK, np.uint8), *(h[0] for h in held), np.zeros(LENGTH, np.uint8)])
        base = np.cumsum([BACK, *(len(h[0]) for h in held)])
        join = lambda k: np.concatenate([h[k] for h in held])
        moved = np.concatenate([np.full(len(h[1]), b) for h, b in zip(held, base[:-1], strict=True)])
        doc, sub, zero, first, last, anchor = join(1), join(2), join(3) + moved, join(4) + moved, join(5) + moved, join(6) + moved
        gram = np.ascontiguousarray(sliding_window_view(data, GRAM)[anchor]).view(f"S{GRAM}").reshape(-1)
        bucket = np.searchsorted(cuts, gram, "right")
        many = np.isin(gram, hot) if len(hot) else np.zeros(len(gram), bool)
        # the windows of a hot anchor are records of their own; so many records at a time
        turn = np.cumsum(np.where(many, last - first + 1, 1)) // RUN_RECORDS
        for k in np.unique(turn).tolist():
            mine, single = (turn == k) & ~many, np.flatnonzero((turn == k) & many)
            count = (last - first + 1)[single]
            each = np.repeat(single, count)
            alone = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            code = np.zeros(len(alone), np.uint64)
            up = np.cumprod(np.full(LENGTH, 0x9E3779B97F4A7C15, np.uint64))
            for j in range(LENGTH if len(alone) else 0):
                code += (data[alone + j].astype(np.uint64) + np.uint64(1)) * up[j]
            by = buckets + (mix(code) % np.uint64(buckets)).astype(np.int64)
            yield from run(data, *(np.concatenate((x[mine], y)) for x, y in ((doc, doc[each]), (sub, sub[each]), (zero, zero[each]), (first, alone), (last, alone), (anchor, anchor[each]), (bucket, by))))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(bytes, offsets, ids, subs, where the first text begins); a long text comes in pieces."""
        for part, data, offs in chunks(batches, STEP_BYTES):
            doc, sub = part.column("doc_id").to_numpy(), part.column("sub").to_numpy()
            if len(offs) > 2 or len(data) <= 2 * STEP_BYTES:
                yield data, offs, doc, sub, 0
                continue
            for lo in range(0, len(data), STEP_BYTES):
                piece = data[lo : lo + STEP_BYTES + LENGTH - 1]
                yield piece, np.array([0, len(piece)]), doc, sub, -lo

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for data, offs, doc, sub, zero in pieces(batches):
            row, first, last, anchor, gone_row, gone = _records(data, offs)
            if len(gone):
                lo = gone - offs[gone_row] - zero
                yield _told(doc[gone_row], sub[gone_row], lo, lo + 1)
            if len(row):
                held.append((data, doc[row], sub[row], offs[row] + zero, first, last, anchor))
                size += len(data)
            if size >= RUN_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return task


def _joined(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of a document that touch, as one."""
    order = np.lexsort((lo, sub, doc))
    doc, sub, lo, hi = doc[order], sub[order], lo[order], hi[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (lo[1:] > hi[:-1])))
    at = np.flatnonzero(new)
    return doc[at], sub[at], lo[at], np.maximum.reduceat(hi, at)


def read_run(prefix: np.ndarray, right: np.ndarray, tails: np.ndarray) -> list[bytes]:
    """The suffixes of a front-coded run, padded to one length."""
    raw, out, last, at = tails.tobytes(), [], b"", 0
    pad = bytes(LENGTH)
    for p, r in zip(prefix.tolist(), right.tolist(), strict=True):
        if r > p:
            last = last[:p] + raw[at : at + r - p] + pad[r:]
            at += r - p
        else:
            last = last[:p] + pad[p:]
        out.append(last)
    return out


def merge_runs(runs: list[list[bytes]], prefixes: list[list[int]]) -> tuple[list[int], list[int]]:
    """Loser-tree merge of sorted runs of equally long strings: of each string in order, its run and the length of the prefix
    that it shares with the one before.

    ``prefixes[r][i]`` is what string i of run r shares with string i - 1. A head's shared length is always with the last string
    put out; the longer wins unseen, and only for equal lengths are bytes beyond them compared.
    """
    width = 1
    while width < len(runs):
        width *= 2
    loser, shared = [-1] * width, [-1] * width  # by node: the run that lost there, and what it shares
    now = [r[0] if r else b"" for r in runs] + [b""] * (width - len(runs))
    todo = [iter(r) for r in runs]
    more = [iter(p) for p in prefixes]
    for r, (t, m) in enumerate(zip(todo, more, strict=True)):
        next(t, None), next(m, None)
        if not runs[r]:
            now[r] = None
    number = int.from_bytes

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """(winner, its shared length, loser, its shared length)"""
        if ha > hb:
            return a, ha, b, hb
        if hb > ha:
            return b, hb, a, ha
        if ha < 0:
            return a, ha, b, hb
        x, y = now[a][ha:], now[b][ha:]
        if x == y:
            return (a, ha, b, ha + len(x)) if a < b else (b, hb, a, ha + len(x))
        k = ha + len(x) - (((number(x) ^ number(y)).bit_length() + 7) >> 3)
        return (a, ha, b, k) if x < y else (b, hb, a, k)

    level = [(r, 0 if r < len(runs) and runs[r] else -1) for r in range(width)]
    nodes = list(range(width, 2 * width))
    while len(level) > 1:
        up = []
        for j in range(0, len(level), 2):
            w, hw, lose, hl = play(*level[j], *level[j + 1])
            loser[nodes[j] >> 1], shared[nodes[j] >> 1] = lose, hl
            up.append((w, hw))
        nodes, level = [nodes[j] >> 1 for j in range(0, len(nodes), 2)], up
    r, h = level[0]
    from_run, common = [], []
    put, put_common = from_run.append, common.append
    while h >= 0:
        put(r)
        put_common(h)
        h = next(more[r], -1)
        if h >= 0:
            now[r] = next(todo[r])
        node = (r + width) >> 1
        while node:
            ho = shared[node]
            if ho > h:
                o = loser[node]
                loser[node], shared[node] = r, h
                r, h = o, ho
            elif ho == h and h >= 0:
                o = loser[node]
                x, y = now[r][h:], now[o][h:]
                if x == y:
                    k = LENGTH
                    first = r < o
                else:
                    k = LENGTH - (((number(x) ^ number(y)).bit_length() + 7) >> 3)
                    first = x < y
                if first:
                    shared[node] = k
                else:
                    loser[node], shared[node] = r, k
                    r = o
            node >>= 1
    return from_run, common


def _repeats(runs: list[tuple[bytes, int]]) -> tuple[np.ndarray, ...]:
    """Of the runs of one range: (doc_id, sub, lo, hi), ranges of window starts that are repeats."""
    parts = [unpack(blob, size, _kinds) for blob, size in runs]
    from_run, common = merge_runs([read_run(p[0], p[1], p[6]) for p in parts], [p[0].tolist() for p in parts])
    from_run, common = np.array(from_run), np.array(common)
    order = np.empty(len(from_run), np.int64)  # the j-th of a run, in merged order
    order[np.argsort(from_run, kind="stable")] = np.arange(len(from_run))
    col = lambda k: np.concatenate([p[k] for p in parts])[order].astype(np.int64)
    same = common >= GRAM
    grouped = same | np.concatenate((same[1:], [False]))
    if not grouped.any():
        return (np.zeros(0, np.int64),) * 4
    right, left, doc, sub, at = (col(k)[grouped] for k in (1, 2, 3, 4, 5))
    common = common[grouped]
    n = len(doc)
    sizes = np.concatenate([p[2] for p in parts]).astype(np.int64)
    stops = np.cumsum(sizes)
    pool = np.concatenate([*(p[7] for p in parts), np.zeros(BACK, np.uint8)])
    back = sliding_window_view(pool, BACK)[(stops - sizes)[order][grouped]]
    back[np.arange(BACK) >= left[:, None]] = 0
    back_order = np.argsort(back.view(f"S{BACK}").reshape(-1), kind="stable")
    back = back[back_order]
    differ = back[1:] != back[:-1]
    back_common = np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), BACK)))
    back_place = np.empty(n, np.int64)
    back_place[back_order] = np.arange(n)
    # earliest first; a row that repeats a document is the same place; windows of a hot anchor have one place, but ends of their own
    place = np.lexsort((left, right, at, sub, doc))
    place = place[np.concatenate(([True], np.any([np.diff(c[place]) != 0 for c in (doc, sub, at, right, left)], axis=0)))]
    right, left, doc, sub, at, back_place = right[place], left[place], doc[place], sub[place], at[place], back_place[place]
    shared = bool(((doc[1:] == doc[:-1]) & (sub[1:] != sub[:-1])).any())
    flags = np.zeros((len(place), BACK + 3), np.int8)  # by window start - anchor + BACK + 1
    for o in range(int(max(0, LENGTH - right.max())), int(left.max()) + 1):
        act = np.flatnonzero((o <= left) & (o >= LENGTH - right))
        if len(act) < 2:
            continue
        to_right = np.cumsum(common < LENGTH - o)[place[act]]
        to_left = np.cumsum(back_common < o)[back_place[act]]
        window = to_right * (n + 1) + to_left
        again = pd.Series(window).duplicated().to_numpy()
        if shared:  # of the documents that share the first one's id, each has a first window
            _, first, which = np.unique(window, return_index=True, return_inverse=True)
            peer = doc[act] == doc[act][first][which]
            again &= ~peer | pd.DataFrame({"w": window, "s": sub[act]}).duplicated().to_numpy()
        flags[act, BACK - o + 1] = again
    turn = np.diff(flags, axis=1)
    row, lo = np.nonzero(turn == 1)
    _, hi = np.nonzero(turn == -1)
    return doc[row], sub[row], at[row] + lo - BACK, at[row] + hi - BACK


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "sub", "lo", "hi"]
    runs: dict[int, list[tuple[bytes, int]]] = {}
    for b in batches:
        told = b.filter(b.column("run").is_null())
        if told.num_rows:
            yield told.select(names)
        for k, run, size in zip(*(b.column(c).to_pylist() for c in ("bucket", "run", "size")), strict=True):
            if run is not None:
                runs.setdefault(k, []).append((run, size))
    while runs:
        found = _repeats(runs.popitem()[1])
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)


def repeated_strings(rows: DataFrame) -> DataFrame:
    """``doc_id, sub, spans``: ranges (lo, hi) of starts of 100-byte strings that also start earlier; ``rows`` are told apart."""
    docs, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    p = partitions_for(rows.sparkSession, size or 0)
    cuts, hot = place(rows, docs, p * RANGES)
    sent = rows.mapInArrow(_make_runs(p * RANGES, cuts, hot), SENT)
    # as many ranges to each partition; a hash of them would give some twice the mean
    sent = sent.repartitionById(p, F.pmod("bucket", F.lit(p)).cast("int"))
    return sent.mapInArrow(_merge_task, "doc_id long, sub long, lo long, hi long").groupBy("doc_id", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        spans = batch.column("spans")
        for k, text in enumerate(batch.column("text")):
            raw = (text.as_py() or "").encode()
            n, gone, found, left = len(raw), 0, 0, raw
            if spans[k].is_valid:
                flat = spans[k].values
                lo, hi = merge_ranges(flat.field("lo").to_numpy(), flat.field("hi").to_numpy() + LENGTH - 1)
                found, kept, at = len(lo), [], 0
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    kept.append(raw[at:a])
                    gone, at = gone + min(b, n) - a, b
                left = b"".join([*kept, raw[at:]])
            for c, v in zip(out, (n, gone, found, left), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array([hashlib.sha256(x).hexdigest() for x in out[3]]), pa.array([x if g else None for x, g in zip(out[3], out[1], strict=True)], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, the bytes left (null where nothing was removed)."""
    rows = told_apart(docs)
    out = rows.join(repeated_strings(rows), ["doc_id", "sub"], "left").select("doc_id", "text", "spans")
    out = out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", key_back("doc_id"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("kept")


#: Windows are told apart by their MD5 here; bytes are written as hexadecimal digits.
SQL = r"""
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), s as (
  select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as s from (select doc_id, h, unnest(range(0, n - 99)) as i from d where n >= 100)
), first as (select s, min(doc_id) as m from s group by s), own as (select s, doc_id, min(i) as m from s group by s, doc_id having count(*) > 1),
bad as (
  select s.doc_id, i from s join first using (s) where s.doc_id > first.m
  union select s.doc_id, i from s join own on s.s = own.s and s.doc_id = own.doc_id where i > own.m
), cut as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from bad),
run as (select doc_id, min(i) as a, max(i) + 100 as b from (select *, sum(new) over (partition by doc_id order by i) as r from cut) group by doc_id, r),
part as (select r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) over (partition by r.doc_id order by a), 0) + 1, 2 * (a - coalesce(lag(b) over (partition by r.doc_id order by a), 0))) as kept from run r join d on r.doc_id = d.doc_id),
k as (select doc_id, sum(b - a) as removed, count(*) as spans, max(b) as last, string_agg(kept, '' order by a) as kept from part group by doc_id)
select d.doc_id, n as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join k using (doc_id)
"""
