"""Small learners that are fitted on a bounded labelled sample: boosted trees, logistic regression, isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_sample(labels: DataFrame, id_col: str, label_col: str, limit: int, strata: bool = True) -> DataFrame:
    """(_id, _y): at most about limit labelled ids, half of them of either class where there are so many, chosen by hash of the id.

    Null ids and labels are left out; an id with different labels counts by the greater one.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    n = {r[0]: r[1] for r in own.groupBy("_y").count().collect()}
    total = sum(n.values())
    if total <= limit:
        return own
    few = min(n, key=n.get) if len(n) == 2 else None
    quota = {few: min(n[few], limit // 2)} if few is not None and strata else {}
    quota = {y: quota.get(y, limit - sum(quota.values())) for y in n}
    share = F.lit(0.0)
    for y, q in quota.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, q / n[y]))).otherwise(share)
    return own.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30))


class Trees:
    """Gradient-boosted trees for the logistic loss over binned features; trees are complete and of fixed depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, leaf: float = 2.0):
        self.depth = depth
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.rate = float(np.log(base / (1 - base))), rate
        self.feature, self.cut, self.value = [], [], []
        s = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-s))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, bins, np.int64)
            node = np.zeros(len(y), np.int64)
            for d in range(depth):
                first, n = (1 << d) - 1, 1 << d
                best = np.full(n, 1e-6)
                for j in range(x.shape[1]):
                    k = (node - first) * (bins + 1) + b[:, j]
                    G = np.bincount(k, g, n * (bins + 1)).reshape(n, -1).cumsum(1)
                    H = np.bincount(k, h, n * (bins + 1)).reshape(n, -1).cumsum(1)
                    gt, ht = G[:, -1:], H[:, -1:]
                    gain = G ** 2 / (H + ridge) + (gt - G) ** 2 / (ht - H + ridge) - gt ** 2 / (ht + ridge)
                    gain[(H < leaf) | (ht - H < leaf)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(n), at]
                    w = top > best
                    best[w] = top[w]
                    feature[first:first + n][w], cut[first:first + n][w] = j, at[w]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leafs = node - ((1 << depth) - 1)
            v = np.bincount(leafs, g, 1 << depth) / (np.bincount(leafs, h, 1 << depth) + ridge) * rate
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(v)
            s += v[leafs]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, s, r = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[r, feature[node]] > cut[node])
            s += value[node - ((1 << self.depth) - 1)]
        return s


class Isotonic:
    """Pool-adjacent-violators fit of y on s, smoothed towards the mean by a row of each end; linear between block centres."""

    def __init__(self, s: np.ndarray, y: np.ndarray):
        o = np.argsort(s, kind="stable")
        s, y = s[o], y[o].astype(float)
        blocks: list[list[float]] = []  # sum of y, weight, sum of s
        for a, b in zip(s.tolist(), y.tolist()):
            blocks.append([b, 1.0, a])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
        mean = y.mean() if len(y) else 0.5
        self.x = np.array([c / n for _, n, c in blocks] or [0.0])
        self.y = np.maximum.accumulate(np.array([(t + mean) / (n + 1) for t, n, _ in blocks] or [0.5]))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.y)


class Logit:
    """Ridge logistic regression over standardised features by Newton's method; rows may be weighted."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1.0):
        w = np.ones(len(y)) if w is None else w
        self.mean = np.average(x, axis=0, weights=w)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=w))
        self.scale[self.scale < 1e-9] = 1.0
        z = np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])
        self.beta = np.zeros(z.shape[1])
        pen = np.full(z.shape[1], ridge)
        pen[-1] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            grad = z.T @ (w * (y - p)) - pen * self.beta
            step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(pen), grad)
            self.beta += step
            if np.abs(step).max() < 1e-6:
                break

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.beta[:-1] + self.beta[-1]
