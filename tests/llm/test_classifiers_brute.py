"""Operators 2 and 10 against plain re-implementations: features, trees, calibration, the exchange of labels and the combination."""

import math
import random
import re

import numpy as np
import pytest

from weftline.llm import cotrain as Q
from weftline.llm import models as M
from weftline.llm import toxicity as T

SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "*": ""}


def kind(w, marks):
    k = next((k for k, own in ((5, T._YOU), (3, T._PROFANE), (2, T._THREAT), (1, T._INSULT)) if w in own), 0)
    return 4 if k in (0, 5) and any(w.startswith(m) for m in marks) else k


def plain(s):
    return "".join(SIGNS.get(c, c) for c in s)


def disguised(low, marks):
    bad = lambda w: 0 < kind(w, marks) < 5
    runs, n = re.split(r"[^a-z0-9@$!|*]+", low), 0
    for r in runs:
        core = r.strip("!*|")
        if any(c in "0134578@$|*!" and d in "abcdefghijklmnopqrstuvwxyz0123456789@$*" for c, d in zip(r, r[1:])) and not core.isalpha() and bad(plain(core)):
            n += 1
    i = 0
    while i < len(low):  # single characters with single separators between them, four or more
        j, letters = i, []
        if i and (low[i - 1].isalnum()):
            i += 1
            continue
        while j + 1 < len(low) and low[j] in "abcdefghijklmnopqrstuvwxyz0123456789@$!" and low[j + 1] in " ._*-":
            letters.append(low[j])
            j += 2
        while len(letters) >= 3:
            if j < len(low) and low[j] in "abcdefghijklmnopqrstuvwxyz0123456789" and not (j + 1 < len(low) and low[j + 1].isalnum()):
                n += bad(plain("".join(letters) + low[j]))
                i = j
                break
            letters.pop()
            j -= 2
        i += 1
    return n


def features(text, marks):
    low = text.lower()
    words, w = [], ""
    for c in low + " ":
        if c.isalnum():
            w += c
        elif w:
            words.append(w)
            w = ""
    codes = [kind(x, marks) for x in words]
    n, size = max(len(words), 1), max(len(text.encode()), 1)
    bad, you = [i for i, k in enumerate(codes) if 0 < k < 5], [i for i, k in enumerate(codes) if k == 5]
    gaps = [min(abs(i - j) for j in you) for i in bad] if you else []
    up, letters = sum("A" <= c <= "Z" for c in text), max(sum("A" <= c <= "Z" or "a" <= c <= "z" for c in text), 1)
    caps = re.findall(r"(?<!\w)[A-ZÀ-ÖØ-Þ]{3,}(?!\w)", text)
    c = [codes.count(k) for k in range(6)]
    return [100 * c[1] / n, 100 * c[2] / n, 100 * c[3] / n, 100 * c[4] / n, 100 * len(bad) / n, math.log1p(len(bad)), math.log1p(c[1]), math.log1p(c[4]), len({words[i] for i in bad}), 100 * c[5] / n,
            100 * sum(g <= 6 for g in gaps) / n, 1 / (1 + min(gaps)) if gaps else 0.0, up / letters, 100 * len(caps) / n, text.count("!") / size, text.count("?") / size, (text.count("*") + text.count("#")) / size,
            sum(c in "0123456789" for c in text) / size, math.log1p(disguised(low, marks)), math.log1p(len(words))]


def odd_texts(n=300, seed=5):
    rng = random.Random(seed)
    bits = ["you", "YOU", "idiot", "1d10t", "m0ron!", "i.d.i.o.t", "s t u p i d", "kill", "shit", "wörter", "FOO", "BAR", "a1", "42nd", "zorgh", "zorghba", "***", "#", "?", "!!", "\n", "du", "@ss", "h3ll|", "w e l l", "x_y", "ÄÖÜ"]
    return ["", " ", "!!!", "a b c d e", *[rng.choice([" ", "  ", ", "]).join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(n)]]


def test_features_equal_plain_ones():
    marks = frozenset({"zorgh", "foo"})
    k = T.Kinds(marks)
    for t in odd_texts():
        assert np.allclose(T.features(t, k), features(t, marks), atol=1e-9), t


def walk(trees, x):
    """One row through all trees, node by node."""
    s = trees.base
    for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
        node = 0
        while node < len(feature):
            j = feature[node]
            b = sum(e < x[j] for e in trees.edges[j])
            node = 2 * node + 2 if b > cut[node] else 2 * node + 1
        s += value[node - len(feature)]
    return s


def test_trees_and_first_split_by_search():
    rng = np.random.default_rng(4)
    x = rng.random((150, 3)).round(1)
    y = (x[:, 1] > 0.55).astype(float)
    t = M.Trees(x, y, trees=6)
    assert np.allclose(t.raw(x), [walk(t, r) for r in x])
    p, best = y.mean(), (0, None)
    for j in range(3):
        for e, edge in enumerate(t.edges[j]):
            left = x[:, j] <= edge
            g, h = y - p, np.full(len(y), p * (1 - p))
            if min(h[left].sum(), h[~left].sum()) >= 2:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, (j, e)), key=lambda v: v[0])
    j, e = best[1]
    mine = x[:, t.feature[0][0]] <= t.edges[t.feature[0][0]][t.cut[0][0]]
    assert t.feature[0][0] == j and (mine == (x[:, j] <= t.edges[j][e])).all()


def isotonic(s, y, at):
    """Max-min formula, then the smoothing and interpolation between the means of equal stretches."""
    o = np.argsort(s, kind="stable")
    s, y = s[o], y[o]
    fit = [max(min(y[a:b + 1].mean() for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    blocks = []
    for v, a, b in zip(fit, s, y):
        if blocks and abs(blocks[-1][0] - v) < 1e-12:
            blocks[-1][1].append((a, b))
        else:
            blocks.append((v, [(a, b)]))
    xs, ys, top = [], [], 0.0
    for _, own in blocks:
        xs.append(sum(a for a, _ in own) / len(own))
        top = max(top, (sum(b for _, b in own) + y.mean()) / (len(own) + 1))
        ys.append(top)
    out = []
    for v in at:
        if v <= xs[0] or len(xs) == 1:
            out.append(ys[0])
        elif v >= xs[-1]:
            out.append(ys[-1])
        else:
            k = next(k for k in range(len(xs)) if xs[k] > v)
            out.append(ys[k - 1] + (ys[k] - ys[k - 1]) * (v - xs[k - 1]) / (xs[k] - xs[k - 1]))
    return out


def test_isotonic_equals_max_min():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 60):
        s = rng.normal(size=n)
        y = (rng.random(n) < 1 / (1 + np.exp(-2 * s))).astype(float)
        at = np.linspace(-3, 3, 40)
        assert np.allclose(M.Isotonic(s, y)(at), isotonic(s, y, at))


DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(260):
        w = [rng.choice(["ba", "korin", "mi", "rudle", "te", "lovo", "sa", "you"]) for _ in range(rng.randrange(5, 60))]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.35
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "1d10t", "zorghba"]))
        if bad:
            w = [x + rng.choice(["***", "###", "&"]) for x in w]
        t = " ".join(w)
        docs.append((i, t, "en", ("junk" if bad and rng.random() < 0.7 else "src") + str(i % 3), len(t)))
        if i < 150:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(900, "", "en", "src1", 0), (901, docs[3][1], None, None, None), (3, *docs[3][1:])]
    return docs, labels


def test_toxicity_query_by_hand(spark, corpus):
    docs, labels = corpus
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.fit(d, l)
    marks = model.kinds.marks
    got = T.toxicity(d, l).collect()
    assert len(got) == len(docs)
    want = {}
    for i, t, *_ in docs:
        raw = walk(model.trees, features(t, marks))
        want[i] = float(np.interp(raw, model.scale.x, model.scale.y))
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], abs_tol=2e-6) and r.toxic == (want[r.doc_id] >= T.THRESHOLD)


def test_co_training_by_hand(spark, corpus):
    """The rounds over plain lists: scores row by row, confident rows by sorting into bins, the rest of the choice by the hash of the text."""
    import xxhash

    docs, labels = corpus
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rounds, size, sure = 2, 15, 0.9
    got = Q.quality_classifier(d, l, rounds=rounds, exchange=size, confident=sure).collect()
    y = {i: q for i, q, _ in labels}
    rows = []
    for i, t, lang, source, chars in docs:
        view = lambda v: np.array(v, np.float32)
        rows.append((i, y.get(i), view(Q.text_view(t)), view(Q.meta_view(lang, source, chars)), xxhash.xxh64_intdigest(t.encode(), seed=11) & 0x7FFFFFFF))
    known = sorted({(str(r[0]), r[1], r[2].tobytes(), r[3].tobytes(), r[4]) for r in rows if r[1] is not None})
    model = Q.CoTrained(known)
    free = [r for r in rows if r[1] is None]

    def score(view, x):
        z = [max(-8.0, min(8.0, (a - m) / s)) for a, m, s in zip(x.astype(float), view.model.mean, view.model.scale)]
        return sum(a * b for a, b in zip(z, view.model.beta)) + view.model.beta[-1]

    bins = lambda p: min(int(p * Q.BINS), Q.BINS - 1)
    squash = lambda s: 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
    for k in range(rounds):
        give = {0: [], 1: []}
        for v, view in ((0, model.text), (1, model.meta)):
            own = [(bins(squash(score(view, r[2 + v]))), r) for r in free]
            for label in (0, 1):
                far = [(Q.BINS - 1 - b if label else b, r) for b, r in own]
                upto, total = 0, 0
                while upto < max(1, round((1 - sure) * Q.BINS)):
                    upto += 1
                    total = sum(b < upto for b, _ in far)
                    if total >= size:
                        break
                share = min(1.0, size / total) if total else 0.0
                give[v] += [(label, r[3 if v == 0 else 2].tobytes()) for b, r in far if b < upto and (r[4] * 2654435761 + k * 97) % 65521 / 65521 < share]
        for v, to in ((0, model.meta), (1, model.text)):
            own = sorted(give[v])
            to.add(Q._matrix([x for _, x in own]), np.array([a for a, _ in own], float))
        model.text.fit()
        model.meta.fit()
    model.combine()
    assert sum(len(v.y) for v in (model.text, model.meta)) > 2 * 60
    odds = lambda p: math.log(p / (1 - p))
    want = {}
    for i, _, t, m, _ in rows:
        a, b = (min(max(float(np.interp(score(v, x), v.scale.x, v.scale.y)), 1e-4), 1 - 1e-4) for v, x in ((model.text, t), (model.meta, m)))
        z = [max(-8.0, min(8.0, (q - mean) / scale)) for q, mean, scale in zip((odds(a), odds(b)), model.both.mean, model.both.scale)]
        want.setdefault(i, []).append((a, b, squash(z[0] * model.both.beta[0] + z[1] * model.both.beta[1] + model.both.beta[2])))
    assert len(got) == len(rows)
    for r in got:
        assert any(np.allclose((r.p_text, r.p_meta, r.score), w, atol=1e-4) for w in want[r.doc_id]), (r, want[r.doc_id])
        assert r.keep == (r.score >= Q.THRESHOLD and r.doc_id != 900)
