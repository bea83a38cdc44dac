import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
from weftline.llm.jaccard_join import N, ORACLE_SQL, QUERIES, components, jaccard_join, jaccard_pairs, near_dedup, trie_join


def grams(text, n):
    w = (text or "").lower().encode().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, t):
    sets = [(i, grams(x, n)) for i, x in rows if i is not None]
    return {(min(a, b), max(a, b)): round(len(x & y) / len(x | y), 6) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
            if x and y and a != b and len(x & y) / len(x | y) >= t}


def classes(rows, pairs):
    """(doc_id, class_id, n_copies, n_links) of every row; ids are distinct but for wholly repeated rows and null ones."""
    text, low = {i: x for i, x in rows if i is not None}, {i: i for i, _ in rows}
    for _ in text:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    links, copies = Counter(x for p in pairs for x in p), Counter(x for p, j in pairs.items() if grams(text[p[0]], N) == grams(text[p[1]], N) for x in p)
    return sorted(((i, low[i], copies[i], links[i]) for i, _ in rows), key=str)


def corpus(seed=1, docs=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    shared = [rnd.choice(words) for _ in range(25)]
    rows = []
    for i in range(docs):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
        else:
            w = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 30, 80]))]
            if rnd.random() < 0.3:
                w = w[:20] + shared + w[20:]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("n,t,cut", [(3, 0.5, 1024), (3, 0.8, 7), (1, 0.6, 16), (2, 1.0, 5)])
def test_equals_brute_force(spark, monkeypatch, n, t, cut):
    rows = corpus() + [(500, None), (501, ""), (502, " \n "), (503, "a"), (504, "A "), (None, "a"), (505, "x " * 3000), (506, "x " * 2990)]
    df = spark.createDataFrame([(i, x, "k", "s", 1) for i, x in rows], "doc_id long, text string, key string, set_id string, DOC_ID int")
    want = brute(rows, n, t)
    got = jaccard_join(df, n=n, threshold=t, block_bytes=2000, slice_sets=cut)
    monkeypatch.setattr(sys.modules[__name__], "N", n)
    assert sorted(map(tuple, got.collect()), key=str) == classes(rows, want)
    text, found = dict(rows), {}
    for r in jaccard_pairs(df, n=n, threshold=t, block_bytes=2000, slice_sets=cut).collect():
        assert (r.doc_a, r.doc_b) not in found
        found[r.doc_a, r.doc_b] = r.jaccard
    first = {}
    for i, x in sorted((r for r in rows if r[0] is not None)):
        first.setdefault(frozenset(grams(x, n)), i)
    assert found == {p: j for p, j in want.items() if all(first[frozenset(grams(text[i], n))] == i for i in p)}


def test_empty_repeated_and_dedup(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(empty).count() == 0 and jaccard_pairs(empty).count() == 0 and near_dedup(empty).count() == 0
    rows = [(7, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "a b c d e f"), (1, "other words in here now"), (None, "a b c d e"), (4, None), (5, ""), (6, None)]
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    kept = near_dedup(df)
    assert kept.columns == ["text", "doc_id"]
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 3), (True, 3), (True, 4), (True, 5), (True, 6)]


def test_copies_show_in_every_row(spark):
    rows = [(i, "six equal documents of some words") for i in range(6)] + [(5, "six equal documents of some words"), (8, "something else altogether here")]
    got = sorted(map(tuple, jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(i, 0, 5, 5) for i in range(6)] + [(5, 0, 5, 5), (8, 8, 0, 0)])


def test_one_id_on_two_texts(spark):
    x, y = "a b c d e f", "one two three four five"
    rows = [(3, x), (5, x), (5, y), (7, y), (9, y), (11, "alone with its words"), (7, "alone with other words now and then")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup(df).collect())) == sorted([(3, x), (5, y), rows[5], rows[6]])
    got = sorted(map(tuple, jaccard_join(df).collect()))
    assert got == sorted([(3, 3, 1, 1), (5, 3, 1, 1), (5, 5, 2, 2), (7, 5, 2, 2), (9, 5, 2, 2), (11, 11, 0, 0), (7, 7, 0, 0)])


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2 w3")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join(df).collect())) == [(1, 1, 0, 1), (2, 1, 0, 1), (3, 3, 0, 0)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 9)}, **{i: 20 for i in range(20, 25)}, **{i: 100 for i in range(100, 141)}}


@pytest.mark.parametrize("same", [True, False])
def test_trie_join(same):
    rnd = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = sets[rnd.integers(len(sets))] if sets and rnd.random() < 0.7 else rnd.integers(0, 80, rnd.integers(1, 30))
        sets.append(np.unique(np.concatenate([base[rnd.random(len(base)) > 0.15], rnd.integers(0, 80, 2)])).astype(np.int64))
    size = np.array([len(s) + i % 2 for i, s in enumerate(sets)])
    a, b = (sets, sets) if same else (sets[:30], sets[30:])
    sa, sb = (size, size) if same else (size[:30], size[30:])
    for t in (0.3, 0.7):
        want = {(i, j) for i in range(len(a)) for j in range(i + 1 if same else 0, len(b))
                if (o := len(np.intersect1d(a[i], b[j]))) and o / (sa[i] + sb[j] - o) >= t}
        got = [(i, j) for i, j, _ in trie_join([x.astype(">u4") for x in a], sa, b, sb, t, same)]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(c.sql(ORACLE_SQL["op7_ngram_jaccard_join"]).fetchall())
    got = QUERIES["op7_ngram_jaccard_join"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "class_id", "n_copies", "n_links"] and sorted(map(tuple, got.collect())) == want and any(r[3] for r in want)
