import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.llm.quality_kn import discounts, quality_bands, quality_filter

TEXTS = ["the cat sat on the mat and the dog sat on the log", "a cat and a dog sat on a mat", "the mat is on the log", "zzz qqq", "", None, "  \n ",
         "the cat sat on the mat", "the dog and the cat", "le chat est sur la table", "la table est grande", "the cat sat on the mat"]
LANGS = ["en"] * 9 + ["fr", "fr", None]


def brute(rows, order):
    """Bits of each text by recursion over dictionaries, with the other fold's counts of its language."""
    raw = defaultdict(Counter)
    for _, text, lang, fold in rows:
        t = b"\0" * order + (text or "").encode()
        for i in range(order, len(t)):
            raw[lang, fold][t[i - order:i + 1]] += 1
    levels = {}
    for key, grams in raw.items():
        lv = {order: dict(grams)}
        for k in range(order - 1, -1, -1):
            c = Counter(g[1:] for g in lv[k + 1])
            lv[k] = dict(c)
        levels[key] = lv
    out = []
    for i, text, lang, fold in rows:
        lv, bits = levels.get((lang, 1 - fold)), 0.0
        t = b"\0" * order + (text or "").encode()
        for j in range(order, len(t)):
            p = 1 / 256
            for k in range(order + 1 if lv else 0):
                cnt = lv[k]
                d = discounts(*[sum(1 for c in cnt.values() if c == r) for r in (1, 2, 3, 4)])
                g = t[j - k:j + 1]
                same = {s: c for s, c in cnt.items() if s[:-1] == g[:-1]}
                if same:
                    total = sum(same.values())
                    freed = sum(d[min(c, 3)] for c in same.values())
                    own = same[g] - d[min(same[g], 3)] if g in same else 0
                    p = (own + freed * p) / total
            bits -= math.log2(p)
        out.append((i, bits))
    return dict(out)


@pytest.mark.parametrize("order", [2, 4])
def test_matches_brute_force(spark, order):
    rows = [(i, t, lg) for i, (t, lg) in enumerate(zip(TEXTS, LANGS))]
    df = spark.createDataFrame([(i, t, lg, 1.5) for i, t, lg in rows], "doc_id long, text string, lang string, perplexity double")
    fold = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2))).collect()}
    want = brute([(i, t, lg or "", fold[i]) for i, t, lg in rows], order)
    got = {r.doc_id: r for r in quality_bands(df, order=order, block_bytes=60, least_bytes=10).collect()}
    assert len(got) == len(rows)
    for i, t, lg in rows:
        r = got[i]
        assert r.lang == lg
        if t:
            assert math.isclose(math.log2(r.perplexity) * r.n_bytes, want[i], rel_tol=1e-4), i
        else:
            assert r.perplexity is None and r.n_bytes == 0
        if not (t or "").strip():
            assert not r.keep
        elif r.lower is not None:
            assert r.keep == (r.lower <= r.perplexity <= r.upper)
        else:
            assert r.keep


def test_filter_keeps_columns_and_agrees(spark):
    df = spark.createDataFrame([(t, i, lg, "s", None) for i, (t, lg) in enumerate(zip(TEXTS, LANGS))], "text string, doc_id long, lang string, Text2 string, keep int")
    kept = quality_filter(df, least_bytes=10)
    assert kept.schema == df.schema
    want = {r.doc_id for r in quality_bands(df, least_bytes=10).collect() if r.keep}
    assert {r.doc_id for r in kept.collect()} == want


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality_bands(df).count() == 0 and quality_filter(df).count() == 0
    two = spark.createDataFrame([(1, "x" * 5000, "en")] * 2 + [(None, "y", None)], "doc_id long, text string, lang string")
    assert quality_bands(two).count() == 3


def test_merging_lists_changes_nothing(spark):
    docs = [(i, t, "en" if i % 3 else "fr") for i, t in enumerate(prose(1, 40))] + [(100 + i, prose(2, 1)[0], "en") for i in range(5)] + [(200, "odd", "xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    one, tree = (sorted(map(tuple, quality_bands(df, block_bytes=4000, **kw).collect())) for kw in ({}, {"fan": 3}))
    assert one == tree and len(one) == len(docs)


def test_discounts():
    assert np.allclose(discounts(0, 0, 0, 0), [0, 0.5, 1, 1.5])
    y = 100 / 160
    assert np.allclose(discounts(100, 30, 10, 5), [0, 1 - 2 * y * 0.3, 2 - 3 * y / 3, 3 - 4 * y * 0.5])


def prose(seed, n, words=400):
    import random

    rng = random.Random(seed)
    syl = ["ba", "rin", "to", "mel", "ku", "sa", "dor", "vi", "lan", "pe"]
    vocabulary = ["".join(random.Random(i).choice(syl) for _ in range(1 + i % 3)) for i in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(n)]


def test_thousands_of_copies_are_kept(spark):
    texts = prose(1, 200)
    good = prose(2, 2)
    docs = list(enumerate(texts)) + [(10_000 + i, good[0]) for i in range(2000)] + [(20_000 + i, f"{good[1]} v{i}") for i in range(300)]
    rows = quality_bands(spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")).collect()
    assert len(rows) == len(docs)
    kept = {r.doc_id for r in rows if r.keep}
    assert {i for i, _ in docs if i >= 10_000} <= kept and len(kept & set(range(200))) > 190
    assert len({r.perplexity for r in rows if 10_000 <= r.doc_id < 20_000}) == 1


def test_small_languages_are_judged(spark):
    import random

    rng = random.Random(3)
    junk = "".join(chr(33 + rng.randrange(90)) for _ in range(1200))
    docs = [(i, t, "en") for i, t in enumerate(prose(1, 100))] + [(500 + i, t, "rare") for i, t in enumerate(prose(4, 6))] + [(600, junk, "xx"), (601, junk[::-1], "rare")]
    r = {x.doc_id: x for x in quality_bands(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not r[600].keep and not r[601].keep and r[600].upper is not None
    assert all(r[500 + i].keep for i in range(6)) and sum(r[i].keep for i in range(100)) > 95
    table = [(i, t, "en") for i, t in enumerate(prose(1, 12))] + [(600, junk, "en")]
    r = {x.doc_id: x for x in quality_bands(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()}
    assert not r[600].keep and sum(r[i].keep for i in range(12)) >= 11


def test_near_groups(spark):
    from weftline.llm.near_copies import near_groups

    a, b = prose(5, 2)
    near = [a.rsplit(" ", 1 + i)[0] for i in range(8)]
    rows = [(i, 1, t) for i, t in enumerate([a, *near])] + [(100 + i, 1, b) for i in range(50)] + [(200, 2, a), (300, 1, "alone in here"), (301, 1, ""), (302, 1, None), (303, 1, "hm"), (304, 1, "hm")]
    df = spark.createDataFrame(rows + rows[:3], "_k long, _lk long, _text string").withColumn("_h", F.col("_k") * 7)
    got = near_groups(df).collect()
    assert {r._k: r._first for r in got} == {**{i: 0 for i in range(9)}, **{100 + i: 100 for i in range(50)}, 303: 303, 304: 303}
    assert len(got) == 61 and all(r._h == 7 * r._k for r in got)


def test_sketches_estimate_jaccard():
    from weftline.llm.near_copies import BINS, sketch

    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8):
        off = []
        for _ in range(200):
            x = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            m = int(600 * 2 * j / (1 + j))
            off.append((sketch(x) == sketch(np.concatenate([x[:m], rng.integers(0, 1 << 63, 600 - m, dtype=np.uint64)]))).mean())
        assert abs(np.mean(off) - j) < 0.04
    assert len(sketch(np.array([5], np.uint64))) == BINS
