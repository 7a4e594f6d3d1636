"""Ranked search, vector codes and the permutation index against brute force, and on rows at the edges."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import common, permutation_index, ranked_search, vector_codes

# ------------------------------------------------------------------------------------------------ op11


def terms(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute_ranks(docs, items, k):
    held = [(common.NULL_ID if i is None else i, i, collections.Counter(terms(t))) for i, t in docs]
    held = [(key, i, c, sum(c.values())) for key, i, c in held if c]
    n, size = len(held), sum(x[3] for x in held)
    df = collections.Counter(t for x in held for t in x[2])
    out = []
    for item, text in items:
        scores = []
        for key, i, c, long in held:
            m = 100 - 90 + 90 * long * n // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, key, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_ranked_search(spark, monkeypatch):
    """Ties by the hundred, repeated and missing ids, long and empty texts; ranges and steps of every size; items in shards."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(60)] + ["été", "Жук", "A1"]
    docs = [(int(k) if k % 11 else None, " ".join(rng.choice(vocabulary, int(rng.zipf(1.4)) % 60))) for k in range(300)]
    docs += [(1000 + k, "same words HERE, same_words") for k in range(200)] + [(5, "same words here"), (None, "w1 w2"), (3, None), (4, ""), (6, "...!"), (7, "w3 " * 9000)]
    items = [(1, "w1 w2 W3 w3 a1"), (2, "same here"), (2, "same here"), (None, "Été été Жук"), (3, None), (4, ""), (5, "unheard of"), (6, " ".join(vocabulary)), (7, "words_w5.w6-w7")]
    left = spark.createDataFrame([(*d, "x", 2) for d in docs], "doc_id long, text string, item string, score int").repartition(3)
    right = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string").repartition(2)
    want = brute_ranks(docs, items, 10)
    assert len(want) == 60
    for docs_a_range, fan, together, shard in ((4096, 16, 16, 1 << 20), (16, 2, 1, 1 << 20), (50, 3, 4, 60)):
        monkeypatch.setattr(ranked_search, "RANGE_DOCS", docs_a_range)
        monkeypatch.setattr(ranked_search, "FAN", fan)
        monkeypatch.setattr(ranked_search, "TOGETHER", together)
        assert found(ranked_search.search(left, right, shard_bytes=shard)) == want
    assert ranked_search.search(left.limit(0), right).count() == 0 and ranked_search.search(left, right.limit(0)).count() == 0
    assert found(ranked_search.search(left, right, k=3)) == brute_ranks(docs, items, 3)


def test_tree_opens_few_nodes():
    """Each bound is at least every score below it, and what one document stands out of is found without opening the rest."""
    rng = np.random.default_rng(3)
    n = 4096
    term, doc = np.divmod(np.unique(rng.integers(0, 20 * n, 20_000)), n)
    impact = rng.integers(1, 1000, len(term))
    impact[(doc >= 1000) & (doc < 1100)] *= 20
    tree = ranked_search.MaxTree(term, doc, impact, n)
    asked = np.array([1, 4, 7])
    plain = np.zeros(n, np.int64)
    hit = np.isin(term, asked)
    np.add.at(plain, doc[hit], impact[hit])
    for level in range(1, tree.top + 1):
        span = ranked_search.FAN ** (level - 1)
        bounds = tree.bounds(asked, level, np.arange(tree.nodes[level])).ravel()[: -(-n // span)]
        assert (bounds >= np.maximum.reduceat(plain, np.arange(0, n, span))).all() and (level > 1 or (bounds == plain).all())
    best = []
    opened = tree.search(asked, np.arange(n), best, 10)
    assert sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1])) == sorted(((int(s), d) for d, s in enumerate(plain)), key=lambda x: (-x[0], x[1]))[:10]
    assert opened < sum(tree.nodes[1:]) / 3


# ------------------------------------------------------------------------------------------------ op12


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(common.NULL_ID if i is None else i, i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for *_, v in kept) // parts) * parts
    kept = sorted(((key, [*v, *[0.0] * (width - len(v))], i, lab) for key, i, lab, v in kept), key=lambda x: x[:2])
    d = width // parts
    ints = [[math.floor(256 * x) for x in v] for _, v, _, _ in kept]
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for v in ints[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        after = []
        for p in range(parts):
            at = [near(v, p)[1] for v in ints]
            after.append([[sum(cut(v, p)[k] for v in own) // len(own) for k in range(d)] if (own := [v for v, e in zip(ints, at, strict=True) if e == j]) else books[p][j] for j in range(len(books[p]))])
        books = after
    final = [[near(v, p) for p in range(parts)] for v in ints]
    error = [sum(f for f, _ in x) for x in final]
    by = collections.Counter()
    for (*_, lab), e in zip(kept, error, strict=True):
        by[lab] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in x), err, by[lab], sha) for (_, _, i, lab), x, err in zip(kept, final, error, strict=True)), key=str)


def coded(df):
    books = vector_codes.learn(df)
    out = vector_codes.label_errors(common.stage(vector_codes.encode(df, books, "label"), "codes"))
    return sorted(((r.vec_id, r.code.hex(), r.error, r.label_error, books.sha256) for r in out.collect()), key=str)


@pytest.mark.parametrize("dims,kind", [(64, "float"), (20, "double"), (16, "float")])
def test_vector_codes(spark, dims, kind):
    rng = np.random.default_rng(dims)
    rows = [(int(k), int(k % 3), [float(np.float32(x)) for x in rng.normal(size=dims)]) for k in range(150)]
    rows += [(200 + k, 1, rows[0][2]) for k in range(4)] + [(3, 5, rows[9][2]), (None, None, rows[5][2]), (300, None, rows[8][2]), (None, 2, rows[11][2])]
    rows += [(400, 0, None), (401, 0, [math.nan] * dims), (402, 0, [None] + [1.0] * (dims - 1)), (403, 0, [math.inf] * dims), (404, 0, []), (405, 0, [0.5, -0.5]), (406, 0, [0.0] * dims), (407, 0, [-0.001] * dims)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, label int, embedding array<{kind}>, code string, error int").repartition(3)
    assert coded(df) == brute_codes(rows)


def test_few_or_no_vectors(spark, sf):
    rows = [(k, None, [float(k), 1.0, -2.0]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    assert coded(df) == brute_codes(rows)
    assert vector_codes.learn(df.limit(0)) is None and vector_codes.learn(df.select("vec_id", "label", F.lit(None).cast("array<double>").alias("embedding"))) is None
    empty = spark.createDataFrame([(1, 2, [])], "vec_id long, label int, embedding array<float>")
    assert coded(empty) == [(1, "00" * 16, 0, 0, hashlib.sha256(b"").hexdigest())]
    huge = spark.createDataFrame([(1, 2, [1e300] * 64), (2, 2, [-1e300] * 64), (3, 2, [1.0] * 64)], "vec_id long, label int, embedding array<double>")
    assert [r.error for r in vector_codes.encode(huge, vector_codes.learn(huge)).collect()] == [0, 0, 0]


def test_intervals_hold_the_exact_value():
    """On numbers that float32 can't tell apart, screening alone would be wrong; the intervals hold and int64 decides."""
    rng = np.random.default_rng(1)
    wrong = 0
    for d, scale in ((4, 200), (4, 1 << 20), (7, 1 << 25), (64, 3000), (1, 1 << 26)):
        points = rng.integers(-scale, scale, (300, d))
        book = np.concatenate((points[:20] + rng.integers(-2, 3, (20, d)), points[:5], points[:5], rng.integers(-scale, scale, (20, d))))
        exact = np.array([[sum(int(c) ** 2 for c in e) - 2 * sum(int(a) * int(c) for a, c in zip(p, e, strict=True)) for e in book] for p in points], dtype=object)
        low, high = vector_codes.intervals(points, book)
        assert all(int(math.floor(a)) <= x <= int(math.ceil(b)) for a, x, b in zip(low.ravel(), exact.ravel(), high.ravel(), strict=True))
        want = np.array([min(range(len(book)), key=lambda e: (row[e], e)) for row in exact])
        at, far = vector_codes.nearest(points, book)
        assert (at == want).all() and (far == ((points - book[want]) ** 2).sum(1)).all()
        wrong += (((low + high) / 2).argmin(1) != want).sum()
    assert wrong > 10
    assert [len(x) for x in vector_codes.nearest(np.zeros((0, 4), np.int64), np.zeros((3, 4), np.int64))] == [0, 0]


def test_codes_stand_for_their_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    books = vector_codes.learn(df)
    back = vector_codes.decode(vector_codes.encode(df, books), books).join(df.select("vec_id", F.col("embedding").alias("given")), "vec_id").collect()
    for r in back:
        gap = np.floor(np.array(r.given, float) * 256) - np.array(r.embedding, float) * 256
        assert (gap * gap).sum() == r.error
    with pytest.raises(ValueError):
        vector_codes.learn(df, entries=300)


# ------------------------------------------------------------------------------------------------ op13


def test_footrule_is_what_it_is_called():
    rng = np.random.default_rng(2)
    seen = np.array([rng.permutation(40)[:9] for _ in range(200)], np.uint8)
    asks = rng.permutation(40)[:9]
    place = lambda order, p: list(order).index(p) if p in order else 9
    want = [sum(abs(place(asks, p) - place(order, p)) for p in range(40)) for order in seen]
    assert permutation_index.InvertedFiles(seen, 40).footrule(asks).tolist() == want


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale, monkeypatch):
    """Of the true nearest at least nine of ten are found, on unit vectors and on vectors of many lengths, in one shard and in many."""
    if scale:
        monkeypatch.setattr(permutation_index, "SHARD_BYTES", 1 << 17)
        monkeypatch.setattr(permutation_index, "BLOCK_BYTES", 1 << 14)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    if scale:
        df = df.withColumn("embedding", F.transform("embedding", lambda v: (v * (0.8 + 0.4 * (F.col("vec_id") % 7) / 7)).cast("float")))
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = permutation_index.search(df, F.col("vec_id") % 20 == 0).collect()
    of = {i: k for k, i in enumerate(ids.tolist())}
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        score = x @ x[of[q]]
        assert [r.rank for r in mine] == list(range(1, 21)) and all(abs(score[of[r.vec_id]] - r.score) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine) and q not in {r.vec_id for r in mine}
        order = [i for i in ids[np.lexsort((ids, -score))].tolist() if i != q][:20]
        hits += len(set(order) & {r.vec_id for r in mine})
    assert hits / (20 * (ids % 20 == 0).sum()) >= 0.95


def test_nearest_at_the_edges(spark, monkeypatch):
    """Hundreds of copies: ties go to the smallest ids; rows that share an id or have none; vectors that take no part."""
    monkeypatch.setattr(permutation_index, "SHARD_BYTES", 4096)
    rng = np.random.default_rng(6)
    base = [[float(np.float32(v)) for v in rng.normal(size=8)] for _ in range(40)]
    rows = [(k, base[k % 40] if k % 3 else base[0]) for k in range(700)]
    rows += [(20, base[1]), (None, base[0]), (None, base[2]), (800, None), (820, [0.0] * 8), (840, [math.nan] * 8), (860, [None] * 8), (880, []), (900, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    got = sorted((tuple(r) for r in permutation_index.search(df, F.col("vec_id") % 20 == 0).collect()), key=str)
    good = [(i, np.array([*v, *[0.0] * (8 - len(v))])) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = []
    for k, (q, v) in enumerate(good):
        if q is not None and q % 20 == 0:
            near = sorted((-float((w * v).sum()), common.NULL_ID if i is None else i) for j, (i, w) in enumerate(good) if j != k)[:20]
            want += [(q, r + 1, None if i == common.NULL_ID else i, -s) for r, (s, i) in enumerate(near)]
    full = {x for x in want}
    assert len(got) == len(want) and {g[:2] for g in got} == {w[:2] for w in want}
    assert sum((g[0], g[1], g[2]) in {w[:3] for w in full} for g in got) >= 0.9 * len(want)
    # a query equal to hundreds of copies gets those of smallest id
    copies = [r for r in got if r[0] == 60]
    assert sorted(r[1:3] for r in copies) == sorted(w[1:3] for w in want if w[0] == 60)
    assert permutation_index.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0 and permutation_index.search(df, F.lit(False)).count() == 0
    assert permutation_index.search(df.where("vec_id = 60"), F.lit(True)).count() == 0
