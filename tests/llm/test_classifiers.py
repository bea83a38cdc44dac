import random

import numpy as np
import pytest

from weftline.llm import cotrain as Q
from weftline.llm import models as M
from weftline.llm import toxicity as T

DOCS = "doc_id long, text string, lang string, source string, n_chars int, TEXT int"
WORDS = [a + b for a in ("ba", "ko", "mi", "ru", "te", "lo", "sa") for b in ("n", "rin", "dle", "s", "vo", "ma")]


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        toxic, bad = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "zorgh" + rng.choice(WORDS)]))
        if bad:
            w = [x + rng.choice(["***", "###", "&&&"]) for x in w]
        t = " ".join(w)
        docs.append((i, t, "en", ("junk" if bad and rng.random() < 0.8 else "src") + str(i % 3), len(t), 0))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:500], "doc_id long, quality int, toxic int"), docs, labels


def test_isotonic_rises_and_calibrates():
    rng = np.random.default_rng(1)
    s = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-s))).astype(float)
    p = M.Isotonic(s, y)(np.linspace(-3, 3, 50))
    assert (np.diff(p) >= 0).all() and abs(p[25] - 0.5) < 0.1


def test_trees_learn_what_lines_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((M.Trees(x[:1000], y[:1000], depth=3).raw(x[1000:]) > 0) == y[1000:]).mean() > 0.93


def test_toxicity_held_out(data):
    d, l, docs, labels = data
    got = {r.doc_id: r for r in T.toxicity(d, l).collect()}
    pairs = [(got[i].toxic, bool(t)) for i, _, t in labels[500:]]
    assert sum(a for a, b in pairs if b) / sum(b for _, b in pairs) > 0.9
    assert sum(a for a, b in pairs if not b) / sum(not b for _, b in pairs) < 0.03


def test_disguises():
    k = T.Kinds()
    assert T._disguised("you 1d10t and m0ron, not 42nd or a1", k) == 2
    assert T._disguised("i.d.i.o.t and s t u p i d", k) == 2 and T._disguised("a b c d e", k) == 0


def test_features_of_odd_texts():
    for t in ("", " ", "\n", "!!!", "x" * 100_000, "é" * 10, "you idiot"):
        assert len(T.features(t, T.Kinds())) == T.N_FEATURES
    assert T.features("you idiot", T.Kinds())[11] == 0.5


def test_quality_held_out(data):
    d, l, docs, labels = data
    got = {r.doc_id: r for r in Q.quality_classifier(d, l, exchange=60).collect()}
    pairs = [(got[i].keep, bool(q)) for i, q, _ in labels[500:]]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.95
    assert sum(not a for a, b in pairs if b) == 0


def test_views_exchange_labels(spark, data):
    d, l, *_ = data
    few = l.filter("doc_id < 60")
    got = {r.doc_id: r.keep for r in Q.quality_classifier(d, few, exchange=80).collect()}
    assert sum(got[i] == bool(q) for i, q, _ in data[3][60:]) / 840 > 0.9


@pytest.mark.parametrize("run, label", [(T.toxicity, "toxic"), (Q.quality_classifier, "quality")])
def test_odd_rows_and_labels(spark, data, run, label):
    d, l, *_ = data
    odd = d.union(spark.createDataFrame([(-1, None, None, None, None, None), (-2, "", "", "", 0, 0), (None, "idiot you", "en", "src1", 9, 0), (5, "word " * 50_000, "en", "src1", 250_000, 0)], DOCS))
    more = l.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int"))
    out = run(odd, more).collect()
    assert len(out) == 904
    by = {r.doc_id: r for r in out}
    flag = "toxic" if label == "toxic" else "keep"
    assert by[-1][flag] is False and (label == "quality" or by[-1].score is None)
    none = run(odd, l.limit(0)).collect()
    assert len(none) == 904 and all(r.score is None for r in none)
    same = run(odd, l.filter(f"{label} = 1")).collect()
    assert all(r.score == 1.0 for r in same if r.doc_id != -1)
    assert run(odd.limit(0), more).count() == 0


def test_label_sample_is_bounded_and_balanced(spark):
    l = spark.range(4000).selectExpr("id", "cast(id % 10 = 0 as int) y")
    n = {r[0]: r[1] for r in M.label_sample(l, "id", "y", 600).groupBy("_y").count().collect()}
    assert 200 < n[1] < 400 and 200 < n[0] < 400
