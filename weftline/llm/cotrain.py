"""Operator 10, quality classifier: co-training of a text-content view and a page-metadata view.

Each document gets two short feature vectors in one pass: the text view (shape and repetition of its words, lines and characters) and
the metadata view (language, source, declared length). Each view has a logistic classifier. In each of ROUNDS rounds both score all
documents; of those without a label, each view's most confident of either class (a cut found from a histogram over all documents, then
a choice by hash down to about EXCHANGE) become labelled rows for the other view. At the end both views are calibrated on held-out
labels, a logistic combination of the calibrated views is fitted there, and all documents are scored.

Fitted on at most SAMPLE labelled rows and 4 * ROUNDS * EXCHANGE exchanged ones. Features are written once to the shared folder (about
250 bytes a document); every later pass reads only them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import pick, table, written
from weftline.llm.models import Isotonic, Logit, label_sample

SAMPLE, ROUNDS, EXCHANGE, CONFIDENT, THRESHOLD = 20_000, 3, 1_000, 0.95, 0.5
BINS = 400
_STOP = frozenset("the of and to in is for that on with as by it this from be are was or at an not have le la les de des et en un une du est que pour dans qui sur au pas avec der die das und ist zu den mit nicht von ein eine auf für im dem el los las y que en un una por con para se del al es no".split())
_SOURCES, _LANGS = 24, 8
N_TEXT, N_META = 22, _SOURCES + _LANGS + 4


def text_view(text: str | None) -> list[float]:
    """22 numbers: sizes, rates of kinds of bytes, words' lengths and variety, repeated words, lines and 3-grams, stop words, ends of lines."""
    t = text or ""
    raw = t.encode("utf-8", "replace")
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    words = t.lower().split()
    n = max(len(words), 1)
    p = c[c > 0] / size
    lines = [x for x in t.split("\n") if x.strip()]
    k = max(len(lines), 1)
    distinct = set(words)
    tri = set(zip(words, words[1:], words[2:]))
    letters = int(c[65:91].sum() + c[97:123].sum() + c[128:].sum())
    ends = sum(x.rstrip()[-1:] in ".!?:;\"'" for x in lines)
    marked = c[33] + c[35:39].sum() + c[42:44].sum() + c[60:63].sum() + c[64] + c[91:97].sum() + c[123:127].sum()
    return [math.log1p(len(t)), math.log1p(len(words)), c[65:91].sum() / max(letters, 1), letters / size, c[48:58].sum() / size, marked / size, c[33] / size, (c[32] + c[10] + c[9]) / size,
            float(-(p * np.log2(p)).sum()), sum(map(len, words)) / n, len(distinct) / n, len(distinct) / math.sqrt(n), len(tri) / max(len(words) - 2, 1), len(set(lines)) / k, math.log1p(k), len(t) / k,
            ends / k, sum(map(_STOP.__contains__, words)) / n, max(map(len, words), default=0) / 100, float(len(t) == 0), c[:32].sum() / size, c[46] * 100 / max(n, 1) / 100]


def meta_view(lang: str | None, source: str | None, chars: int | None) -> list[float]:
    """Language and source by hash, the declared length and its square, and whether source or length are missing."""
    out = [0.0] * N_META
    out[xxhash.xxh32_intdigest((source or "").encode("utf-8", "replace")) % _SOURCES] = 1.0
    out[_SOURCES + xxhash.xxh32_intdigest((lang or "").encode("utf-8", "replace"), seed=1) % _LANGS] = 1.0
    size = math.log1p(max(chars or 0, 0))
    out[-4:] = [size, size * size / 10, float(chars is None), float(source is None)]
    return out


def _views(d: DataFrame) -> DataFrame:
    def f(batches):
        for r in batches:
            cols = [r.column(c).to_pylist() for c in ("_text", "_lang", "_source", "_chars")]
            t = [np.array(text_view(x), np.float32).tobytes() for x in cols[0]]
            m = [np.array(meta_view(*x), np.float32).tobytes() for x in zip(*cols[1:])]
            side = [xxhash.xxh64_intdigest((x or "").encode("utf-8", "replace"), seed=11) & 0x7FFFFFFF for x in cols[0]]
            yield pa.RecordBatch.from_arrays([r.column("_id"), pa.array(t, pa.binary()), pa.array(m, pa.binary()), pa.array(side, pa.int32())], names=["_id", "_t", "_m", "_h"])

    return d.mapInArrow(f, f"_id {d.schema['_id'].dataType.simpleString()}, _t binary, _m binary, _h int")


def _matrix(col) -> np.ndarray:
    rows = col.to_pylist() if hasattr(col, "to_pylist") else col
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64) if rows else np.zeros((0, 1))


class _View:
    """A view's training rows and its classifier; probabilities are calibrated on held-out labelled rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray):
        self.x, self.y, self.w, self.hx, self.hy = x, y, np.ones(len(y)), hx, hy
        self.fit()

    def add(self, x: np.ndarray, y: np.ndarray):
        if len(y):  # pseudo-labels weigh half of a label
            self.x, self.y, self.w = np.concatenate([self.x, x]), np.concatenate([self.y, y]), np.concatenate([self.w, np.full(len(y), 0.5)])

    def fit(self):
        self.model = Logit(self.x, self.y, self.w)
        self.scale = Isotonic(self.model.raw(self.hx), self.hy)

    def p(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale(self.model.raw(x)), 1e-4, 1 - 1e-4)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


class CoTrained:
    """prior alone where the labels have only one class."""

    def __init__(self, rows: list[tuple]):
        y = np.array([r[1] for r in rows], np.float64)
        self.prior = float(y.mean()) if len(y) else None
        self.text = self.meta = None
        self.exchanged: list[tuple[int, int]] = []
        hold = np.array([r[4] % 4 == 0 for r in rows], bool)
        if len(set(y.tolist())) < 2:
            return
        if min(len(set(y[hold].tolist())), len(set(y[~hold].tolist()))) < 2:
            hold = None
        t, m = _matrix([r[2] for r in rows]), _matrix([r[3] for r in rows])
        a, b = (slice(None), slice(None)) if hold is None else (~hold, hold)
        self.text, self.meta = _View(t[a], y[a], t[b], y[b]), _View(m[a], y[a], m[b], y[b])

    def scores(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Rows of the raw scores of both views, squashed."""
        return np.stack([1 / (1 + np.exp(-np.clip(v.model.raw(x), -30, 30))) for v, x in ((self.text, t), (self.meta, m))])

    def combine(self):
        z = np.column_stack([_logit(v.p(v.hx)) for v in (self.text, self.meta)])
        self.both = Logit(z, self.text.hy, ridge=0.1)

    def final(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.p(t), self.meta.p(m)
        return a, b, 1 / (1 + np.exp(-np.clip(self.both.raw(np.column_stack([_logit(a), _logit(b)])), -30, 30)))


def _exchange(feats: DataFrame, model: CoTrained, size: int, confident: float) -> None:
    """One round: each view's confident unlabelled rows go to the other."""
    sc = feats.sparkSession.sparkContext
    shared = sc.broadcast(model)
    free = feats.filter("_y is null")

    def count(batches):
        n = np.zeros((2, BINS), np.int64)
        for r in batches:
            if r.num_rows:
                for v, p in enumerate(shared.value.scores(_matrix(r.column("_t")), _matrix(r.column("_m")))):
                    n[v] += np.bincount(np.minimum((p * BINS).astype(np.int64), BINS - 1), minlength=BINS)
        v, b = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n[v, b])], names=["v", "b", "n"])

    hist = np.zeros((2, BINS), np.int64)
    for r in free.select("_t", "_m").mapInArrow(count, "v int, b int, n long").groupBy("v", "b").agg(F.sum("n").alias("n")).collect():
        hist[r.v, r.b] = r.n
    cut = {}
    for v in (0, 1):
        for y in (0, 1):
            h = hist[v][::-1] if y else hist[v]
            sure = max(1, round((1 - confident) * BINS))  # bins on this side that count as confident
            upto = min(int(np.searchsorted(np.cumsum(h), size)) + 1, sure)
            got = int(h[:upto].sum())
            cut[v, y] = (upto, min(1.0, size / got) if got else 0.0)
    seed = len(model.exchanged)

    def choose(batches):
        for r in batches:
            if not r.num_rows:
                continue
            h = (r.column("_h").to_numpy().astype(np.int64) * 2654435761 + seed * 97) % 65521 / 65521
            for v, p in enumerate(shared.value.scores(_matrix(r.column("_t")), _matrix(r.column("_m")))):
                b = np.minimum((p * BINS).astype(np.int64), BINS - 1)
                for y in (0, 1):
                    upto, share = cut[v, y]
                    at = pa.array(np.flatnonzero(((BINS - 1 - b if y else b) < upto) & (h < share)))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.int32()), pa.array([y] * len(at), pa.int32()), r.column("_t" if v else "_m").take(at)], names=["v", "y", "x"])

    got = sorted((r.v, r.y, bytes(r.x)) for r in free.select("_t", "_m", "_h").mapInArrow(choose, "v int, y int, x binary").collect())
    for v, to in ((0, model.meta), (1, model.text)):
        own = [r for r in got if r[0] == v]
        to.add(_matrix([r[2] for r in own]), np.array([r[1] for r in own], np.float64))
    model.exchanged.append((sum(r[0] == 0 for r in got), sum(r[0] == 1 for r in got)))
    model.text.fit()
    model.meta.fit()
    shared.unpersist()


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars",
                       label_col: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS, exchange: int = EXCHANGE, confident: float = CONFIDENT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_text, p_meta (calibrated views), score (combined) and keep (score of threshold or more) for every row.

    Null texts and metadata are values like others; a null or blank text is never kept. Repeated rows are scored each, texts of any length
    whole; a score equal to the threshold is kept. A null id is scored and never learned from. An id with both labels counts as good. Rows
    of equal confidence are exchanged by the hash of their text. With labels of one class all three are that class's share; without labels
    they are null and keep is null but for blank texts.
    """
    d = pick(docs, _id=id_col, _text=text_col, _lang=lang_col, _source=source_col, _chars=chars_col)
    d = d.select("_id", "_text", F.col("_lang").cast("string").alias("_lang"), F.col("_source").cast("string").alias("_source"), F.col("_chars").cast("long").alias("_chars"))
    chosen = label_sample(pick(labels, _id=id_col, _y=label_col), "_id", "_y", sample)
    feats = written(_views(d).join(F.broadcast(chosen), "_id", "left"), "views")
    rows = feats.filter("_y is not null").dropDuplicates(["_id", "_t", "_m"]).collect()
    model = CoTrained(sorted((str(r._id), r._y, bytes(r._t), bytes(r._m), r._h) for r in rows))
    if model.text is not None:
        for _ in range(rounds):
            _exchange(feats, model, exchange, confident)
        model.combine()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches):
        m = shared.value
        for r in batches:
            n = r.num_rows
            t = _matrix(r.column("_t"))
            if m.text is None or not n:
                a = b = s = np.full(n, np.nan if m.prior is None else m.prior)
            else:
                a, b, s = m.final(t, _matrix(r.column("_m")))
            blank = t[:, 1] == 0 if n else np.zeros(0, bool)
            none = np.isnan(s)
            yield pa.RecordBatch.from_arrays([r.column("_id"), *[pa.array(np.round(x, 6), mask=none) for x in (a, b, s)], pa.array((np.nan_to_num(s) >= threshold) & ~blank, mask=none & ~blank)],
                                             names=["doc_id", "p_text", "p_meta", "score", "keep"])

    return feats.select("_id", "_t", "_m").mapInArrow(f, f"doc_id {d.schema['_id'].dataType.simpleString()}, p_text double, p_meta double, score double, keep boolean")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
