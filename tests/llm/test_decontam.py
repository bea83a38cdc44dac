import random
from collections import Counter

import numpy as np
from weftline.llm.common import shingles, word_hashes
from weftline.llm.decontam import Index, contamination, decontaminate, simhash


def words(rnd, n):
    return " ".join(f"w{rnd.randrange(400)}" for _ in range(n))


def corpus(seed=5):
    rnd = random.Random(seed)
    items = [(100 + i, words(rnd, rnd.randrange(12, 40))) for i in range(25)] + [(200, "tiny"), (201, "two words"), (202, ""), (203, None)]
    docs = []
    for i in range(120):
        w = words(rnd, rnd.randrange(20, 200)).split()
        if i % 3 == 0:
            p = items[rnd.randrange(25)][1].split()
            for _ in range(i % 4):
                p[rnd.randrange(len(p))] = "EDITED"
            at = rnd.randrange(len(w))
            w = w[:at] + p + w[at:]
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "Tiny"), (503, items[0][1].upper()), (504, "x " * 20000 + items[1][1]), (505, " ".join(items[2][1].split()[:-2]))]
    return items, docs


def brute(items, docs, n, sim):
    """All windows of all pairs by dictionaries."""
    bags = {}
    for i, t in items:
        w = (t or "").lower().split()
        if w:
            k = min(n, len(w))
            bags[i] = (len(w), k, Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1)))
    df = Counter(g for _, _, b in bags.values() for g in b)
    wt = lambda g: np.log(1 + len(bags) / max(1, df[g]))
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, (size, k, bag) in bags.items():
            s = [tuple(w[j:j + k]) for j in range(len(w) - k + 1)]
            if not s or not bag.keys() & set(s):
                continue
            m = min(size - k + 1, len(s))
            best = 0
            for j in range(len(s) - m + 1):
                win = Counter(s[j:j + m])
                if not bag.keys() & win.keys():
                    continue
                g = bag.keys() | win.keys()
                best = max(best, sum(wt(x) * min(bag[x], win[x]) for x in g) / sum(wt(x) * max(bag[x], win[x]) for x in g))
            if best >= sim:
                out[d, i] = best
    return out


def test_recall_and_precision_against_brute_force(spark):
    items, docs = corpus()
    want = brute(items, docs, 3, 0.5)
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, item_id string, similarity int")
    got = {(r.doc_id, r.item_id): r.similarity for r in contamination(d, b).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(k in got for k, v in want.items() if v > 0.75)
    assert all(abs(v - want[k]) < 1e-5 for k, v in got.items() if want[k] > 0.75)
    kept = decontaminate(d, b)
    assert kept.schema == d.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {k[0] for k in got}
    more = {(r.doc_id, r.item_id): r.similarity for r in contamination(d, b, slice_bytes=400).collect()}
    assert more == got  # slices don't change the result
    assert {r.doc_id for r in decontaminate(d, b, slice_bytes=400).collect()} == {r.doc_id for r in kept.collect()}


def test_odd_ids_repeats_and_long_texts(spark):
    rnd = random.Random(8)
    item = words(rnd, 30)
    docs = [(1, item), (1, item), (None, "x " + item), (2, words(rnd, 200_000) + " " + item + " end"), (3, None)]
    d = spark.createDataFrame(docs, "doc_id smallint, text string")
    b = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id smallint, text string")
    got = [(r.doc_id, r.item_id, r.similarity) for r in contamination(d, b).collect()]
    assert sorted(got, key=str) == sorted([(i, k, 1.0) for i in (1, 1, None, 2) for k in (7, None)], key=str)
    assert [r.doc_id for r in decontaminate(d, b).collect()] == [3]
    assert [r.doc_id for r in decontaminate(d, b.filter("item_id is null")).collect()] == [3]
    dates = spark.createDataFrame([("2020-01-01", item)], "item_id string, text string").selectExpr("cast(item_id as date) item_id", "text")
    assert str(contamination(d.filter("doc_id = 2"), dates).first().item_id) == "2020-01-01"


def test_exact_passages_and_clean_texts(spark):
    rnd = random.Random(9)
    items = [(i, words(rnd, 20)) for i in range(10)]
    docs = [(i, words(rnd, 50) + " " + items[i][1] + " " + words(rnd, 50)) for i in range(10)] + [(100 + i, words(rnd, 120)) for i in range(30)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity, r.first_word, r.end_word) for r in got} == {(i, i, 1.0, 50, 70) for i in range(10)}


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, b).count() == 0 and decontaminate(d, b).count() == 1
    assert contamination(d.limit(0), d.toDF("item_id", "text")).count() == 0


def test_index_finds_all_within_radius():
    rnd = random.Random(2)
    texts = [words(rnd, 20) for _ in range(60)]
    ix = Index(list(range(60)), texts, 3, 23, 0.5)
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    prints[:60] = ix.print ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    for _ in range(11):
        prints[:60] ^= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
    want = {(w, i) for w in range(300) for i in range(60) if bin(int(prints[w]) ^ int(ix.print[i])).count("1") <= 23}
    assert set(ix.near(prints, 20)) == want and len(want) >= 60
    h = word_hashes([texts[0].encode()])[0]
    assert simhash(shingles(h, 3), ix.weights(shingles(h, 3)), 18)[0] == ix.print[0]
