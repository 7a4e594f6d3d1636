"""The dealt operators against brute force or SQL: on the smallest tables, and on rows that are null, empty, tied, repeated or long."""

import collections
import hashlib
import json
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridlens.llm import common, decontaminate, embedding_dedup, line_dedup, mixing, ngram_join, queries, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter

from ..helpers import table

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
RUN = "lorem ipsum dolor sit amet " * 30
ODD = [
    (1, RUN + "tail one"), (2, "start " + RUN), (3, None), (4, ""), (5, "  \n\t "), (6, RUN + "tail one"), (7, "x"), (8, "A b c"), (9, "a B c"), (10, "é" * 150 + RUN[:200]), (11, "\x00" * 120 + "q"),
    (12, "\x00" * 121), (13, "word " * 4000), (14, "one two three four five six seven"), (14, "one two three four five six seven"), (None, RUN), (15, "ONE two three FOUR five six seven"), (16, "ab" * 3000),
    # ids that repeat, and none, over different texts; short periods; a long text in pieces is in its own test
    (5, "other " + RUN[:400]), (5, "alone " * 3 + " ".join(f"q{k}" for k in range(90))), (None, " ".join(f"q{k}" for k in range(90))), (None, "mine " + RUN[:500]), (None, "abc" * 200), (17, "zabc" + "abc" * 100 + "ab"), (2, "xy" + "ab" * 400),
    (17, " ".join(f"u{k}" for k in range(70))), (17, "v " + " ".join(f"u{k}" for k in range(70))), (18, " ".join(f"u{k}" for k in range(70))), (None, None), (5, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Texts at the edges, with columns whose names clash with what operators add."""
    rows = [(i, t, "x", k, "y") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, h int, n_removed string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))


def texts_of(df):
    return sorted(((common.NULL_ID if r.doc_id is None else r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()))


def none_id(i):
    return None if i == common.NULL_ID else i


def brute_bytes(pairs, size=100):
    """A window repeats if a document with a smaller id has it, or the same row earlier."""
    least, out = {}, []
    for i, t in pairs:
        raw = t.encode()
        for p in range(len(raw) - size + 1):
            w = raw[p : p + size]
            least[w] = min(least.get(w, i), i)
    for i, t in pairs:
        raw, seen = t.encode(), set()
        gone = np.zeros(len(raw) + 2, int)
        for p in range(len(raw) - size + 1):
            w = raw[p : p + size]
            if least[w] < i or w in seen:
                gone[p + 1 : p + size + 1] = 1
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[gone[1:-1] == 0])
        out.append((none_id(i), len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_dedup(odd, docs, hot, monkeypatch):
    if hot:  # every anchor's windows one by one
        real = suffix_dedup.place
        monkeypatch.setattr(suffix_dedup, "place", lambda rows, docs, n: (real(rows, docs, n)[0], np.unique(np.array([r.gram.ljust(20, b"\0") for r in rows.mapInArrow(suffix_dedup._sample, "gram binary, context long").collect()], "S20"))))
    frames = [odd] if hot else [odd, docs]
    for df in frames:
        got = rows_of(suffix_dedup.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted(brute_bytes(texts_of(df)), key=lambda t: tuple((x is not None, x) for x in t))


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    """Texts longer than a step, in pieces and runs; uniform and periodic ones; empty tables; columns that clash."""
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "RUN_RECORDS", 40)
    rng = np.random.default_rng(8)
    noise = "".join(chr(97 + k) for k in rng.integers(0, 26, 5000))
    rows = [(1, noise), (2, noise[2000:2600] + "-" + noise[600:900]), (3, "x" * 4000), (4, "y" + "x" * 1500 + "y" * 300), (5, "abcdefg" * 400), (6, noise[:1000] + "abcdefg" * 90), (6, "x" * 900), (None, noise[4000:] * 2)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, sub int, bucket int").repartition(2)
    got = rows_of(suffix_dedup.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute_bytes(texts_of(df)), key=lambda t: tuple((x is not None, x) for x in t))
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_uniform_text_makes_few_records():
    data = np.full(300_000, 97, np.uint8)
    offs = np.array([0, 100_000, 300_000])
    row, first, last, anchor, gone_row, gone = suffix_dedup._records(data, offs)
    assert len(row) == 2 and len(gone) == 99_900 + 199_900 and list(np.bincount(gone_row)) == [99_900, 199_900]


def test_loser_tree():
    rng = np.random.default_rng(3)
    runs = [sorted(bytes(rng.integers(97, 99, 100, dtype=np.uint8)) if rng.random() < 0.5 else b"a" * int(rng.integers(0, 100)) + b"b" * 100 for _ in range(int(rng.integers(0, 40)))) for _ in range(7)]
    runs = [[s[:100].ljust(100, b"\0") for s in r] for r in runs]
    share = lambda a, b: next((k for k in range(100) if a[k] != b[k]), 100)
    sent = [[0] + [share(a, b) for a, b in zip(r, r[1:], strict=False)] for r in runs]
    order, common_ = suffix_dedup.merge_runs(runs, [s[: len(r)] for s, r in zip(sent, runs, strict=True)])
    at = [iter(r) for r in runs]
    merged = [next(at[k]) for k in order]
    assert merged == sorted(s for r in runs for s in r)
    assert common_[1:] == [share(a, b) for a, b in zip(merged, merged[1:], strict=False)]


def brute_words(pairs, size=50):
    least, out = {}, []
    for i, t in pairs:
        w = t.encode().split()
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            least[key] = min(least.get(key, i), i)
    for i, t in pairs:
        w = t.encode().split()
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - size + 1):
            gone[p : p + size] |= least[tuple(w[p : p + size])] < i
        out.append((none_id(i), len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def test_substring_dedup(odd, docs):
    for df in (odd, docs):
        got = rows_of(substring_dedup.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(brute_words(texts_of(df)), key=lambda t: tuple((x is not None, x) for x in t))
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def twisted(size):
    """Two words of as many bytes that no sum of powers of an odd base tells apart modulo 2**64: a Thue-Morse string and its complement."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [8, 64, 1024, 2048, 4096])
def test_hashes_do_not_fail_together(size):
    both = "".join(twisted(size)).encode()
    data = np.frombuffer(both, np.uint8)
    for lane in (0, 1):
        a, b = common.word_hashes(data, np.array([0, size]), np.array([size, 2 * size]), lane)
        again = common.word_hashes(np.frombuffer(b"x" + both, np.uint8), np.array([1, size + 1]), np.array([size + 1, 2 * size + 1]), lane)
        assert a != b and bin(int(a ^ b)).count("1") > 8 and again.tolist() == [a, b]
    assert (common.word_hashes(data, np.array([0, size]), np.array([size, 2 * size]), 0) != common.word_hashes(data, np.array([0, size]), np.array([size, 2 * size]), 1)).all()


def test_words_that_differ_in_a_twist_are_different_words(spark):
    """op7, op8 and op10 on texts that differ only in such a word."""
    rows = []
    for k, size in enumerate((1024, 2048, 4096)):
        for j, word in enumerate(twisted(size)):
            rows.append((10 * k + j, " ".join([f"w{k}x{i}" for i in range(30)] + [word] + [f"v{k}x{i}" for i in range(29)])))
            rows.append((10 * k + 5 + j, f"{word} s{k}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substring_dedup.remove_repeats(df).collect())
    got = {r.doc_id: r.component_id for r in ngram_join.join_groups(df, 4, 90).collect()}
    assert got == {i: i for i, _ in rows}
    found = decontaminate.find_leaks(df, decontaminate.indexes(df.where("doc_id % 10 >= 5").withColumnRenamed("doc_id", "item_id")))
    assert all(r.doc_id % 10 % 5 == r.item_id % 10 % 5 and r.doc_id // 10 == r.item_id // 10 for r in found.where("overlap >= 0.8").collect())


def brute_groups(pairs, size, percent):
    sets = []
    for _, t in pairs:
        w = t.encode().translate(LOW).split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(pairs)))  # every row is a document

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = {}
    for k, (i, _) in enumerate(pairs):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(none_id(i), len(s), none_id(least[find(k)])) for k, ((i, _), s) in enumerate(zip(pairs, sets, strict=True))]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(odd, docs, size, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)  # so that blocks are cut
    for df in (odd, docs):
        got = rows_of(ngram_join.join_groups(df, size, percent), "doc_id", "n_shingles", "component_id")
        assert got == sorted(brute_groups(texts_of(df), size, percent), key=lambda t: tuple((x is not None, x) for x in t))
    assert ngram_join.join_groups(odd.limit(0)).count() == 0


def test_links_of_a_block():
    """The product with early discards against counted overlaps, over several slabs."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 400, int(rng.integers(1, 300)))) for _ in range(40)]
    sets += [np.unique(np.append(s[rng.random(len(s)) > 0.05], rng.integers(400, 500, 3))) for s in sets]
    n = np.array([len(s) for s in sets])
    real, ngram_join.SLAB = ngram_join.SLAB, 37
    label = ngram_join.link_block(np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(len(sets)), n), n, 80)
    ngram_join.SLAB = real
    linked = [[a == b or 180 * len(np.intersect1d(x, y)) >= 80 * (len(x) + len(y)) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    want = list(range(len(sets)))
    for _ in sets:
        want = [min(want[b] for b in range(len(sets)) if linked[a][b]) for a in range(len(sets))]
    assert label.tolist() == want and len(set(want)) < len(sets) - 20


def test_ngram_join_of_large_groups(spark, monkeypatch):
    """Near copies that link in chains, over several tiles, with a passage that all have."""
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.integers(0, 60, i % 4):
            w[k] = f"v{i}{k}"
        rows.append((i, " ".join(w + [f"own{i % 3}"] * (i % 5))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(ngram_join.join_groups(df), "doc_id", "n_shingles", "component_id") == brute_groups(sorted(rows), 4, 85)


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(common, "HOT", 20)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(500, 600 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    """Of each row, in order: links, smallest id reachable. Every row is a vector of its own."""
    good = [(k, lab, np.array(v, np.float64)) for k, (_, lab, v) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = collections.defaultdict(set)
    for k, lab, v in good:
        links[k] = {j for j, other, w in good if j != k and lab == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen]
        least = None if None in ids else min(ids)
        out.append((i, len(links[k]), least, i == least))
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_embedding_dedup(spark, monkeypatch, depth):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)  # so that cells are cut
    if depth:
        monkeypatch.setattr(embedding_dedup, "PARTS", 1)
        monkeypatch.setattr(embedding_dedup, "DEPTH", depth)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 20))
    rows = [(k, int(k % 2), [float(x) for x in (centers[k % 12] + rng.normal(size=20) * (0.02 + 0.13 * (k % 3 == 0))).astype(np.float32)]) for k in range(240)]
    rows += [(300 + k, 0, rows[0][2]) for k in range(5)] + [(400, None, rows[0][2]), (401, 0, None), (402, 0, [0.0] * 20), (403, 0, [math.nan] * 20), (404, 0, [None] + [1.0] * 19), (405, 0, []), (406, 0, [1.0, 2.0]), (407, 0, [2.0, 4.0]), (0, 0, rows[0][2])]
    # ids that repeat, and none, with other vectors
    rows += [(7, 1, rows[13][2]), (7, 0, rows[2][2]), (7, 0, [3.0, -1.0]), (None, 0, rows[4][2]), (None, 0, rows[6][2]), (None, 1, [1.0, 2.0]), (None, 0, None)]
    rows += [(None, 7, [1.0, 0.0])] * 2 + [(5, 7, [2.0, 0.0])] + [(6, 8, [0.0, 1.0])] * 2
    want = sorted(brute_vectors(rows), key=str)
    for kind in ("float",) if depth else ("double",):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, label int, embedding array<{kind}>, key string, links int").repartition(3)
        assert sorted(map(tuple, embedding_dedup.near_groups(df).collect()), key=str) == want
    assert embedding_dedup.near_groups(df.limit(0)).count() == 0
    assert sum(r[1] for r in want) > 500


def test_embedding_candidates_are_few():
    """Of the pairs of unrelated vectors few have any distance computed, at every size."""
    shares = []
    for n in (500, 1000, 2000, 4000):
        x = embedding_dedup.rotate(np.random.default_rng(n).normal(size=(n, 64)))
        blocks = embedding_dedup.blocks_of(64)
        radii = [math.sqrt(embedding_dedup._budget(b, 64, 0.98)) for b in blocks]
        shares.append(sum((p < q).sum() for p, q in embedding_dedup.candidates(x, x, blocks, radii)) / (n * (n - 1) / 2))
    assert max(shares) < 0.002


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, sf, name):
    got, want = queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name])
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


def test_urls_at_the_edges(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/x", "http://example.org", "x://a.example.org/en/123?q#f", "http://notexample.org/es/", "http://com/de/", "http://a.com/fr/#x", "http:///p", "http://org?x", "a\nb://b.org/\nx"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls + urls[3:4])], "page_id long, url string, rule string, h string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == got[12] == ("example.org", "/es/x", "example.org/es/", "block") and got[4] == ("example.org", "", None, "allow")
    assert got[5][2] == "example.org/en/1" and got[6][2] == "org/" and got[7][3] == "block" and got[8][2:] == ("com/fr/", "allow")
    assert got[9][:2] == ("", "/p") and got[10][:2] == ("org", "") and got[11] == ("b.org", "/\nx", "org/", "allow")
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_token_counts(odd, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.TOKENIZER)
    library = Tokenizer.from_file(path)
    extra = odd.sparkSession.createDataFrame([(90, "a<|endoftext|>b  \n\n c"), (91, "don't I'LL 12345 日本語  x")], "doc_id long, text string")
    every = odd.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (odd.select("doc_id", "text").union(extra).withColumns({"n_bytes": F.lit("clash"), "n_tokens": F.lit(None)}), every, every.limit(0)):
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, path).collect())
        want = collections.Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in df.collect())
        assert got == want


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers

    with open(public_tokenizers.path(token_counts.TOKENIZER), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] |= {"vocab": {c: i for i, c in enumerate(token_counts.byte_symbols())}, "merges": []}
    for k, change in enumerate(({}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}})):
        (tmp_path / f"{k}.json").write_text(json.dumps(spec | change))
        if k:
            with pytest.raises(ValueError):
                token_counts.PairMerger(str(tmp_path / f"{k}.json"))
        else:
            token_counts.PairMerger(str(tmp_path / f"{k}.json"))


def naive_raw(text, weights, exceptions=()):
    """``Scorer.raw`` by trying every pattern and phrase at every place."""
    folded = toxicity.fold(text or "")
    covered = {k for e in exceptions for m in range(len(folded)) if folded.startswith(f := toxicity.fold(e), m) for k in range(m, m + len(f))}
    total = sum(max([w for p, w in weights.items() if w > 0 and folded.startswith(p, k)], default=0.0) for k in range(len(folded)) if k not in covered)
    return total / math.log2(2 + len(folded) / 600)


def naive_score(text, model):
    weights, rates, exceptions = model
    raw = naive_raw(text, weights, exceptions)
    at = min(math.ceil(raw / toxicity.BIN), toxicity.BINS - 1)
    top = max(rates[min(at + 1, toxicity.BINS - 1)], rates[at])
    return min(1.0, max(0.0, rates[at] + ((top - rates[at]) * 0.5 * min(1.0, max(0.0, raw / toxicity.BIN - at + 1)) if raw > 0 else 0.0)))


def test_toxicity(spark):
    assert toxicity.fold("1D10T, $tupid \u0456di\u043et\uff01") == " idiot stupid idiot "
    plain = ("trash can", "clown fish")
    scorer = toxicity.Scorer({" ciown ": 3.0, " trash ": 3.0}, plain)
    assert scorer.raw("clown") > 0 == scorer.raw("a trash can and clown fish") and scorer.raw("") == 0.0
    assert scorer.phrases("a trash bin") == {"a trash", "trash bin"} and scorer.phrases("clown") == set()
    sf = "/root/testdata/sf0.1"
    got = queries.queries()["op5_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.75 and hit / max(1, sum(r.predicted for r in rows)) > 0.9
    again = toxicity.Scorer({" trash ": 3.0, " idiot ": 3.0}, plain)
    assert again.raw("trash can " * 100_000) == 0.0 < again.raw("trash can " * 10 + "idiot")


def test_toxicity_scores_as_a_naive_scan_does(spark, docs, odd):
    sf = "/root/testdata/sf0.01"
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert 0 < len(model[0]) and model[1] == sorted(model[1])
    mixed = docs.select("doc_id", "text").limit(80).unionByName(odd.select("doc_id", "text").where("length(text) < 3000"))
    some = sorted(model[0])[:4]
    extra = [(900, " ".join(x.strip() for x in some)), (901, "".join(some).upper()), (902, some[0].strip() + " friend"), (None, some[0])]
    mixed = mixed.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("score", F.lit("clash"))
    for m in (model, (model[0], model[1], (some[0].strip() + " friend",))):
        for r in toxicity.score(mixed, m).collect():
            assert r.score == pytest.approx(naive_score(r.text, m)), r.text[:80] if r.text else r
    assert toxicity.score(mixed.limit(0), model).count() == 0


def test_toxicity_learns_words_and_exceptions(spark):
    """Words that toxic documents have, phrases with them that are harmless, ids and labels that repeat or miss."""
    noise = [" ".join(f"n{(k * 7 + j * 13) % 50:02d}x".replace("0", "a").replace("1", "b") for j in range(8)) for k in range(600)]
    texts = [(k, noise[k] + (" wuzzle" if k % 5 in (0, 2) else " wuzzle tree" if k % 10 == 1 else "")) for k in range(600)]
    labels = [(k, 0, int(k % 5 in (0, 2))) for k in range(600)] + [(0, 0, 0), (0, 0, None), (None, 0, 1), (5000, 0, 1)]
    docs = spark.createDataFrame([*texts, (3, "wuzzle tree again"), (None, "wuzzle"), (7, None)], "doc_id long, text string")
    weights, rates, exceptions = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    word = toxicity.fold("wuzzle")
    assert max(weights, key=weights.get) in {word, *(word[: k + 1] for k in toxicity.PREFIXES)} and toxicity.fold("wuzzle tree").strip() in exceptions
    held = {r.doc_id: r.score for r in toxicity.score(docs, (weights, rates, exceptions)).where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert all((held[k] >= toxicity.THRESHOLD) == (k % 5 in (0, 2)) for k, _ in texts if k in held and k > 7)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nothing = toxicity.learn(docs, empty)
    assert nothing == ({}, [0.0] * toxicity.BINS, ()) == toxicity.learn(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_mixing(spark, sf, odd):
    assert mixing.share_out(150, [3, 1, 2], [20, 200, 90]) == [20, pytest.approx(130 / 3), pytest.approx(260 / 3)]
    got = queries.queries()["op6_mixing"](spark, "/root/testdata/sf0.1")
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.queries()["op6_mixing"](spark, "/root/testdata/sf0.1").repartition(7).collect()))
    assert all(r.taken <= 2 * r["size"] for r in rows)
    by = collections.defaultdict(int)
    for r in rows:
        by[r.target, r.source_size] += r.taken
    assert all(abs(v / t - 1) < 0.01 for (t, _), v in by.items())
    few = mixing.mix(odd.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a")))
    assert few.count() == len(ODD) and few.where("size = 0 and taken > 0").isEmpty()
    assert mixing.mix(odd.limit(0).withColumn("source", F.lit("a"))).count() == 0


@pytest.mark.parametrize("equal", [3, 4096])
def test_mixing_against_a_plain_count(spark, equal, monkeypatch):
    """Sizes, sources and targets counted plainly; copies are the whole or one more; many equal rows without an id; reruns agree."""
    monkeypatch.setattr(mixing, "EQUAL", equal)
    rng = np.random.default_rng(12)
    rows = [(int(k) if k % 3 else None, "w " * int(rng.integers(0, 60)), [None, "b", "B", "\u00e9"][k % 4]) for k in range(400)] + [(None, "same text here", "b")] * 50 + [(9, "w " * 900, "b"), (9, None, None)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, source string, size int, target string")
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    whole = {n: sum(s for s, r in zip(size, rows, strict=True) if r[2] == n) for n in names}
    left, open_, goal = 1.5 * sum(size), dict(zip(names, (3, 1, 2, 3), strict=True)), {}
    while True:
        part = {n: left * w / sum(open_.values()) for n, w in open_.items()}
        over = [n for n in part if part[n] > 2 * whole[n]]
        if not over:
            goal |= part
            break
        for n in over:
            goal[n] = 2.0 * whole[n]
            left -= goal[n]
            del open_[n]
    got = mixing.mix(df).collect()
    assert collections.Counter((r.doc_id, r["size"], r.source) for r in got) == collections.Counter((r[0], s, r[2]) for r, s in zip(rows, size, strict=True))
    assert all(r.source_size == whole[r.source] and r.target == pytest.approx(goal[r.source]) for r in got)
    assert all(r.taken == r.copies * r["size"] and (not r["size"] or int(r.target / r.source_size) <= r.copies <= min(2, math.ceil(r.target / r.source_size - 1e-9))) for r in got)
    for n in names:
        assert abs(sum(r.taken for r in got if r.source == n) - goal[n]) <= max(60, 0.01 * goal[n])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))


def test_rounding_is_fair():
    sizes = np.sort(np.random.default_rng(0).lognormal(5, 1, 40).round())[::-1]
    out = np.array([mixing.settle(sizes, np.full(40, 0.3), np.random.default_rng(k), True) for k in range(2000)])
    assert set(np.unique(out)) == {0.0, 1.0} and np.abs(out.mean(0) - 0.3).max() < 0.05
    assert np.abs(out @ sizes / (0.3 * sizes.sum()) - 1).mean() < 0.02


def brute_leaks(docs, items, overlap=0.8):
    """Shares by sets of word tuples, of every document and item, without an index: (doc_id, item_id) that count as contaminated."""
    words_ = lambda t: re.findall(rb"[0-9a-z_\x80-\xff]+", (t or "").encode().translate(LOW))
    runs_ = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    held = [(i, w := words_(t), [set(), *(runs_(w, k) for k in range(1, 6))]) for i, t in docs]
    out = []
    for item, text in items:
        q, a = (words_(x) for x in decontaminate.split_item(text or ""))
        parts = [(min(5, len(w)), runs_(w, min(5, len(w)))) for w in (q + a, q, a)]
        if q + a:
            for i, _, have in held:
                both, question, answer = (len(g & have[k]) / len(g) if k else 0.0 for k, g in parts)
                if both >= overlap or min(question, answer) >= overlap:
                    out.append((i, item))
    return out


def test_decontamination(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    apart = "one sees that this question is long enough to tell it from all others here"
    items = [(1, item + ".\nThe answer is nu xi omicron."), (2, None), (3, ""), (4, "pi rho"), (5, apart + "\nforty two is it"), (5, apart + "\nforty two is it"), (None, "sigma tau upsilon phi chi psi omega")]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, score string")
    texts = [(1, "noise " * 300 + item.upper() + " the answer is nu, xi omicron " + "noise " * 300), (2, item), (3, "pi rho sigma"), (4, None), (None, "x pi, rho"), (5, "noise " * 900 + apart + " noise" * 900 + " Forty two is it"), (6, apart + " sixty three"), (6, "forty two is it"), (7, "sigma tau upsilon phi chi psi omega")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in texts], "doc_id long, text string, score double, item_id int").repartition(3)
    for size in (40, 1 << 20):
        shards = decontaminate.indexes(bench, shard_bytes=size)
        found = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, shards).collect())
        assert found == collections.Counter(brute_leaks(texts, items)) == collections.Counter([(1, 1), (3, 4), (None, 4), (5, 5), (5, 5), (7, None)])
        assert rows_of(decontaminate.drop_leaks(docs, shards), "doc_id") == [(2,), (4,), (6,), (6,)]
    assert decontaminate.find_leaks(odd, decontaminate.indexes(bench.limit(0))).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), shards).count() == 0 and decontaminate.drop_leaks(docs.limit(0), shards).count() == 0


def test_decontamination_finds_what_brute_force_finds(spark):
    """Recall of the index over every pair, on the middle tables."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = set(brute_leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()]))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, decontaminate.indexes(bench)).collect()}
    assert got <= want and len(want) > 10 and len(got) >= 0.98 * len(want), (len(got), len(want))


def test_index_scores_as_bm25_does():
    """Every item at or above the threshold, with the score that a plain sum gives; most blocks are never scored."""
    rng = np.random.default_rng(4)
    items = [(k, rng.zipf(1.3, 30).astype(np.uint64), rng.zipf(1.3, 5).astype(np.uint64)) for k in range(300)]
    terms, df = np.unique(np.concatenate([np.unique(np.concatenate(x[1:])) for x in items]), return_counts=True)
    every = decontaminate.Statistics(300, 35.0, 35, terms, df)
    index = decontaminate.Index(items, every)
    idf = {t: math.log(1 + (300 - n + 0.5) / (n + 0.5)) for t, n in zip(terms.tolist(), df.tolist(), strict=True)}
    gain = []
    for _, q, a in items:
        c = collections.Counter([*q.tolist(), *a.tolist()])
        w = {t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * 35 / 35.0)) for t, n in c.items()}
        gain.append({t: v / sum(w.values()) for t, v in w.items()})
    passages = [np.unique(np.concatenate((items[k][1], rng.zipf(1.3, 40).astype(np.uint64)))) for k in range(0, 300, 7)]
    for threshold in (0.3, 0.5, 0.9):
        want = {(p, k): v for p, t in enumerate(passages) for k, g in enumerate(gain) if (v := sum(g.get(x, 0.0) for x in t.tolist())) >= threshold}
        place = [np.searchsorted(index.terms, t[np.isin(t, index.terms)]) for t in passages]
        got = index.retrieve(np.repeat(np.arange(len(place)), [len(x) for x in place]), np.concatenate(place), len(place), threshold)
        assert {(p, index.ids[k]): pytest.approx(v) for p, k, v in zip(*got, strict=True)} == want


def test_decontamination_does_not_depend_on_shards(spark):
    """Items of a template of 50 words and 10 of their own: the template alone is no leak, wherever the shards are cut."""
    template = " ".join(f"t{k}" for k in range(50))
    items = [(i, template + " " + " ".join(f"own{i}x{k}" for k in range(10))) for i in range(40)] + [(40, "pi rho sigma tau " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(1, template), (2, "noise " * 90 + items[7][1]), (3, items[39][1] + " noise" * 90), (4, items[40][1])], "doc_id long, text string")
    found = [rows_of(decontaminate.find_leaks(docs, decontaminate.indexes(bench, shard_bytes=k)), "doc_id", "item_id", "score", "overlap") for k in (1000, 5000, 1 << 20)]
    assert all(len(f) == len(found[0]) and f == [pytest.approx(r) for r in found[0]] for f in found)
    assert {r[:2] for r in found[0]} >= {(2, 7), (3, 39), (4, 40)} and not any(r[0] == 1 and r[3] >= 0.9 for r in found[0])


def brute_lines(rows, min_docs):
    """(doc_id, lines, dropped, what is left) of each row; every row is a document."""
    keys = [[line.strip(" \t\n\x0b\x0c\r").encode().translate(LOW).decode() for line in (t or "").split("\n")] for _, t in rows]
    docs = collections.Counter(k for ks in keys for k in set(ks))
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        left = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if not (k and docs[k] >= min_docs)]
        out.append((i, len(ks), len(ks) - len(left), "\n".join(left)))
    return collections.Counter(out)


@pytest.mark.parametrize(("batches", "hot"), [(1, 1000), (5, 3)])
def test_line_dedup(spark, odd, docs, batches, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)
    rows = [(i, "Same \n" + f"own {i}\n\n" + ("rare" if i < 9 else "")) for i in range(12)] + [(3, "Same \nown 3\n\nrare"), (3, "\u00c4 same\nSAME\n same"), (20, None), (None, " same"), (None, "x\n same\nx"), (21, "sAmE\n" * 5000 + "end")]
    few = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, h1 string, n_lines int").repartition(3)
    for df, least in ((few, 10), (few, 9), (odd.unionByName(odd.select("doc_id", F.concat("text", F.lit("\nx")).alias("text"), "key", "h", "n_removed")), 2), (docs, 10)):
        got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_frequent(df, least, batches=batches, fanout=2).collect())
        assert got == brute_lines([(r.doc_id, r.text) for r in df.collect()], least)
    assert line_dedup.drop_frequent(few.limit(0)).count() == 0
    assert line_dedup.drop_frequent(odd).columns == [*[c for c in odd.columns], "n_lines", "n_dropped"]


def test_line_runs(spark):
    docs = spark.createDataFrame([(i, "same\n" + f"own {i}\n" + ("rare" if i < 9 else "")) for i in range(12)], "doc_id long, text string")
    lines = line_dedup.hashed(docs)
    parts = [lines.where(f"doc_id between {lo} and {lo + 3}").select("h1", "h2") for lo in (0, 4, 8)]
    runs = line_dedup.LineRuns(spark, fanout=2)
    assert [runs.ingest(p).count() for p in parts] == [6, 4, 4]  # lines that no earlier batch has
    assert [len(x) for x in runs.levels] == [1, 1]
    counted = line_dedup.LineRuns(spark, decided=3, fanout=2)
    assert [counted.ingest(p).count() for p in parts] == [6, 4, 4]  # of the second batch on, both common lines are decided
    assert counted.totals().where("docs >= 3").count() == 2
    plan = counted.totals()._jdf.queryExecution().toString()
    assert plan.count("Bucketed: true") >= 1


def test_pipeline(spark):
    """Every stage against brute force on what the stage before kept, with rows at the edges added to the documents."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    base = [r.text for r in docs.orderBy("doc_id").limit(3).collect()]
    odd = [(None, base[0], "en", "s", 1), (None, None, None, None, None), (1, "own words of a row that shares its id", "en", None, 3), (9001, "", "en", "s", 0), (9001, base[1] + " more", "de", "s", 1), (9002, "w " * 9000, "en", "s", 1), (9003, bench[0][1], "en", "t", 1)]
    docs = common.stage(docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("copy", F.lit("clash")), "docs")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    steps = dict(cp.STAGES)

    def run(name):
        out = common.stage(steps[name](spark, docs, sf), name)
        assert out.columns == cp.COLUMNS if name != "source_mixing" else out.columns == [*cp.COLUMNS, "copy"]
        return out, [tuple(r)[:5] for r in docs.select(*cp.COLUMNS).collect()], [tuple(r)[:5] for r in out.collect()]

    docs, before, after = run("toxicity")
    assert collections.Counter(after) == collections.Counter(r for r in before if naive_score(r[1], model) < toxicity.THRESHOLD)
    docs, before, after = run("line_dedup")
    assert collections.Counter((r[0], r[1]) for r in after) == collections.Counter({(i, t): n for (i, _, _, t), n in brute_lines([r[:2] for r in before], 10).items()}) and all(r[4] == len(r[1]) for r in after)
    docs, before, after = run("ngram_jaccard_join")
    before.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    groups, kept = collections.defaultdict(list), collections.Counter(after)
    keyed = [(k, r[1]) for k, r in enumerate(before)]
    for (k, n, g), r in zip(brute_groups(keyed, 5, 80), before, strict=True):
        groups[(g,) if n else (r[0], r[1] or "")].append(r)
    for members in groups.values():  # one of each group, with the smallest id, and nothing else
        stay = [r for r in members if r in kept]
        assert stay and stay[0][0] == members[0][0]
    assert sum(kept.values()) == len(groups)
    docs, before, after = run("benchmark_decontamination")
    leaks = {i for i, _ in brute_leaks([(k, r[1]) for k, r in enumerate(before)], bench)}
    assert leaks and collections.Counter(after) == collections.Counter(r for k, r in enumerate(before) if k not in leaks)
    docs, before, after = run("source_mixing")
    most = collections.Counter(before)
    assert all(n <= 2 * most[r] for r, n in collections.Counter(after).items())
    words_ = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert words_(after) == pytest.approx(1.5 * words_(before), rel=0.05)
    assert cp.ORACLE_SQL is None


def test_pipeline_of_no_documents(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, step in cp.STAGES:
        docs = common.stage(step(spark, docs, sf), name)
        assert docs.columns[:5] == cp.COLUMNS and docs.count() == 0


def test_near_copies_of_rows_that_share_an_id(spark, sf):
    import corpus_pipeline as cp

    a, b, c, d, e, f = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcdef")
    rows = [(1, a, "en"), (1, b, "en"), (2, b + " more", "en"), (None, c, "en"), (None, c, "en"), (None, d, "en"), (3, c, "en"), (4, e, "en"), (4, e, "de"), (9, f, "en"), (8, f + " more", "en")]
    rows += [(5, "", "en"), (5, "", "en"), (5, " ", "en"), (6, None, "en"), (None, "", "en"), (None, "", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.drop_near_copies(spark, docs, sf)
    assert rows_of(out, "doc_id", "text") == [(None, ""), (None, c), (None, d), (1, a), (1, b), (4, e), (5, ""), (5, " "), (6, None), (8, f + " more")]
    assert rows_of(out, *cp.COLUMNS) == rows_of(cp.drop_near_copies(spark, docs.orderBy(F.desc("lang")).repartition(3), sf), *cp.COLUMNS)


def test_mixing_of_rows_that_share_an_id(spark, sf):
    import corpus_pipeline as cp

    rows = [(None, "a b c", None, "s", 5)] * 3 + [(None, f"w{k} x", "en", "s", None) for k in range(20)] + [(7, "p q", "en", None, 3), (7, "r s", "en", None, 3), (8, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.mix_sources(spark, docs, sf).collect()
    words = collections.Counter()
    for r in out:
        words[r.source] += len((r.text or "").split())
    # 53 words; the shares of both sources are above what they may take, twice their size, or just their part
    assert abs(words["s"] - min(2 * 49, 79.5 - words[None])) <= 3 and words[None] <= 8
    most = collections.Counter(map(tuple, rows))
    assert all(n <= 2 * most[k] for k, n in collections.Counter(tuple(r)[:5] for r in out).items())
    assert sorted(map(str, out)) == sorted(map(str, cp.mix_sources(spark, docs.repartition(3), sf).collect()))


def test_every_number_is_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert json.dumps(queries.oracle_sql())


def test_every_pattern_that_passes_its_bound_is_used(spark):
    """5,200 toxic words, more than any cap of before."""
    letters = "abcdefghjkmnopqrstuvwxyz"
    words_ = [a + b + c for a in letters for b in letters for c in letters][:5200]
    rows = [(k, " ".join(words_), 1) for k in range(20)] + [(100 + k, "plain text of no interest", 0) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    weights, _, _ = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert len(weights) == 5200


def test_near_copies_leave_little_on_disk(spark, sf, tmp_path, monkeypatch):
    """Of a stage's disk: no shuffle outlives the table it was for, what groups were made of goes, and texts move once, to meet the rows that go."""
    import corpus_pipeline as cp

    blanks = [(-7, None), (-7, ""), (-7, " \t"), (-7, " \t"), (-8, ""), (None, "\x0b\x0c\r\n"), (None, "\x0b\x0c\r\n"), (-9, "\u00a0"), (-9, "\u00a0"), (-10, "\x00")]
    docs = spark.createDataFrame([(i, t, "en", "blank", 0) for i, t in blanks], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*docs.columns).unionByName(docs.repartition(3))
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = cp.drop_near_copies(spark, docs, sf)
    left = {x.rpartition("-")[0] for x in os.listdir(tmp_path)}
    assert {"rows", "gone"} <= left <= {"rows", "gone", "edges", "stars"}
    assert len(re.findall("Join", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert rows_of(out.where("source = 'blank'").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text") == [(None, "\x0b\x0c\r\n"), (-10, "\x00"), (-9, "\u00a0"), (-8, ""), (-7, ""), (-7, " \t")]
    where = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in where for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    had = files()
    common.stage(spark.range(1000).repartition(5, "id"), "dealt")
    assert not files() - had
