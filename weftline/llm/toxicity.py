"""Operator 2, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicons (insults, threats, profanity in four languages, and words and stems that the labelled sample shows
to mark toxic texts), how near their words stand to the second person, capitals, punctuation, and words that are lexicon words only after
their disguise (1d10t, i.d.i.o.t) is undone. Trees are fitted on three quarters of a labelled sample of at most SAMPLE rows (split by
text, so that copies stay on one side), the calibration on the rest. All documents are scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import pick, table
from weftline.llm.models import Isotonic, Trees, label_sample

SAMPLE, THRESHOLD = 8_000, 0.5
#: A learned word, or beginning of words, occurs in this share of the sample's toxic texts, and that many times more often there than in others.
MARKS_SHARE, MARKS_RATIO, MARKS_LEAST = 0.015, 12.0, 4

_INSULT = """idiot idiots moron morons loser losers scum trash garbage clown clowns pathetic worthless disgusting stupid dumb dumbass imbecile jerk creep freak pig pigs
 coward liar filth vermin parasite parasites subhuman retard brainless useless ugly fool fools scumbag lowlife degenerate
 idioten trottel dummkopf abschaum versager widerlich erbärmlich wertlos dumm schwachkopf arschloch ekelhaft
 imbécile crétin abruti ordure raclure minable débile connard idiote dégoûtant pathétique
 imbécil estúpido estúpida escoria basura patético inútil asqueroso tonto payaso miserable""".split()
_THREAT = """kill hurt destroy punch stab shoot murder bash strangle töten sterben umbringen verrecke tuer crever mourir frapper matar morir muérete""".split()
_PROFANE = """fuck fucking fucked fucker shit shitty bullshit bitch bastard asshole ass crap damn hell piss scheiße verdammt merde putain foutre mierda joder puta cabrón""".split()
_YOU = """you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros""".split()
_KIND = {w: k for k, words in ((1, _INSULT), (2, _THREAT), (3, _PROFANE), (5, _YOU)) for w in words}
_WORD = re.compile(r"[^\W_]+")
_CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_SPOT = re.compile(r"[0134578@$|*!](?=[a-z0-9@$*])")
_SPACED = re.compile(r"(?<![^\W_])(?:[a-z0-9@$!][ ._*-]){3,}[a-z0-9](?![^\W_])")
_PLAIN = str.maketrans("0134578@$!|", "oieastbasil")
_GAP = re.compile(r"[ ._*-]")
_TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789@$!|*")
N_FEATURES = 20


class Kinds(dict):
    """Word -> 1 insult, 2 threat, 3 profanity, 4 learned, 5 second person, or 0; remembers what it has looked up, in bounded space."""

    def __init__(self, marks: frozenset[str] = frozenset()):
        self.marks = marks
        self.lengths = sorted({len(m) for m in marks})

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        k = _KIND.get(w, 0)
        if k in (0, 5) and any(w[:n] in self.marks for n in self.lengths):
            k = 4
        if len(w) <= 64:  # longer ones are looked up each time
            self[w] = k
        return k

    def __reduce__(self):
        return Kinds, (self.marks,)


def _disguised(low: str, kinds: Kinds) -> int:
    n, end = 0, 0
    for m in _SPOT.finditer(low):
        a = m.start()
        if a < end:
            continue
        while a > end and low[a - 1] in _TOKEN:
            a -= 1
        end = m.end()
        while end < len(low) and low[end] in _TOKEN:
            end += 1
        core = low[a:end].strip("!*|")
        if not core.isalpha() and 0 < kinds[core.translate(_PLAIN).replace("*", "")] < 5:
            n += 1
    for x in _SPACED.findall(low):
        if 0 < kinds[_GAP.sub("", x).translate(_PLAIN)] < 5:
            n += 1
    return n


def features(text: str, kinds: Kinds) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    codes = np.frombuffer(bytes(map(kinds.__getitem__, words)), np.uint8)
    by = np.bincount(codes, minlength=6).tolist()
    at = np.flatnonzero((codes > 0) & (codes < 5))
    you = np.flatnonzero(codes == 5)
    near = close = 0.0
    if len(at) and len(you):
        to = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(to, len(you) - 1)]), np.abs(at - you[np.maximum(to - 1, 0)]))
        near, close = float((gap <= 6).sum()), 1 / (1 + float(gap.min()))
    c = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size, per = max(int(c.sum()), 1), 100 / max(n, 1)
    letters = int(c[65:91].sum() + c[97:123].sum())
    hidden = _disguised(low, kinds)
    bad = len(at)
    return [by[1] * per, by[2] * per, by[3] * per, by[4] * per, bad * per, math.log1p(bad), math.log1p(by[1]), math.log1p(by[4]), len({words[i] for i in at}), by[5] * per, near * per, close,
            c[65:91].sum() / max(letters, 1), len(_CAPS.findall(text)) * per, c[33] / size, c[63] / size, (c[42] + c[35]) / size, c[48:58].sum() / size, math.log1p(hidden), math.log1p(n)]


def _matrix(texts: list[str], kinds: Kinds) -> np.ndarray:
    return np.array([features(t, kinds) for t in texts], np.float64).reshape(len(texts), N_FEATURES)


def _stems(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] for w in words for n in range(3, 11) if len(w) > n}


def _marks(texts: list[str], y: np.ndarray) -> frozenset[str]:
    """Words and beginnings of words that toxic texts have and others haven't. Near copies of a text count once."""
    one, zero, seen = Counter(), Counter(), set()
    n = [0, 0]
    for t, k in zip(texts, y.tolist()):
        w = t.split()
        grams = [" ".join(w[i:i + 5]).encode("utf-8", "replace") for i in range(max(1, len(w) - 4))]
        own = {(s, min(xxhash.xxh64_intdigest(g, seed=s) for g in grams)) for s in (1, 2)}
        if own & seen:
            continue
        seen |= own
        n[k] += 1
        (one if k else zero).update(_stems(t))
    least = max(MARKS_LEAST, MARKS_SHARE * n[1])
    return frozenset(w for w, c in one.items() if c >= least and c / max(n[1], 1) >= MARKS_RATIO * (zero[w] + 0.5) / max(n[0], 1))


class Model:
    """prior alone where the sample has only one class."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else None
        self.trees = None
        h = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), seed=7) % 4 for t in texts]
        fit = np.array([v != 0 for v in h], bool)
        if not len(y) or min(y.sum(), len(y) - y.sum()) < 1 or len(set(y[fit].tolist())) < 2:
            return
        own = np.flatnonzero(fit)
        self.kinds = Kinds(_marks([texts[i] for i in own], y[own]))
        x = _matrix(texts, self.kinds)
        self.trees = Trees(x[fit], y[fit])
        rest = ~fit if len(set(y[~fit].tolist())) == 2 else fit
        self.scale = Isotonic(self.trees.raw(x[rest]), y[rest])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), np.nan if self.prior is None else self.prior)
        if not texts:
            return np.zeros(0)
        return self.scale(self.trees.raw(_matrix(texts, self.kinds)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of at most about `sample` labelled documents."""
    chosen = label_sample(pick(labels, _id=id_col, _y=label_col), "_id", "_y", sample)
    d = pick(docs, _id=id_col, _text=text_col).filter("_text is not null")
    # a row for each labelled id; texts that differ under one id: the least by hash
    rows = d.join(F.broadcast(chosen), "_id").select("_id", "_y", "_text", F.xxhash64("_text").alias("_h"))
    t = rows.groupBy("_id").agg(F.min_by(F.struct("_y", "_text"), F.struct("_h", "_text")).alias("_r")).select("_id", "_r._y", "_r._text").toArrow()
    got = sorted(zip(map(str, t.column("_id").to_pylist()), t.column("_y").to_pylist(), t.column("_text").to_pylist()))
    return Model([r[2] for r in got], np.array([r[1] for r in got], np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (calibrated probability) and toxic (score of threshold or more) for every row.

    A null text has a null score and isn't toxic; an empty one is scored as a text without words. Repeated rows are scored each, texts of
    any length whole; a score equal to the threshold is toxic. A null id is scored like others. An id with both labels counts as toxic;
    of texts that differ under a labelled id the one of the least hash is learned from. Labels of one class only give every text that
    class's share; without labels all scores are null.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, sample))

    def f(batches):
        for r in batches:
            texts = r.column("_text").to_pylist()
            own = [i for i, t in enumerate(texts) if t is not None]
            s = np.full(len(texts), np.nan)
            s[own] = model.value.score([texts[i] for i in own])
            yield pa.RecordBatch.from_arrays([r.column("_id"), pa.array(np.round(s, 6), mask=np.isnan(s)), pa.array(np.nan_to_num(s) >= threshold)], names=["doc_id", "score", "toxic"])

    d = pick(docs, _id=id_col, _text=text_col)
    return d.mapInArrow(f, f"doc_id {d.schema['_id'].dataType.simpleString()}, score double, toxic boolean")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
