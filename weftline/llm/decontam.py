"""Operator 9, benchmark decontamination: SimHash over item-sized windows, a multi-index for the Hamming radius, exact verification.

Every benchmark item has the 64-bit SimHash of its word shingles, weighted by rarity among all items: how many of them have a shingle of
the same 1 of 2^BUCKET_BITS hash values (exactly the shingle's own number while the benchmark has far fewer shingles than that), counted
in Spark over the whole benchmark into a table of bounded size. In each document, windows as long
as an item (the whole document where it is shorter) get theirs by running sums, wherever shingles of an item lie dense enough that
verification could succeed at all. The fingerprint is cut into 8 bytes; two fingerprints within RADIUS < 8 * 3 differ by at most 2
bits in some byte, so that looking up each byte's neighbours of up to 2 bits misses none. What is found is verified exactly: weighted
Jaccard similarity of the shingle multisets of window and item.

The documents are scanned once, without a shuffle. The benchmark goes to every task in slices of about SLICE_BYTES of text, one slice
at a time; a benchmark beyond one slice means more scans, with the same result, since rarity doesn't depend on the slices.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.common import count_sorted, find, flat, mix, n_blocks, pick, shingles, table, text_bytes, word_groups, word_hashes, written

N, RADIUS, SIMILARITY = 3, 23, 0.5
SLICE_BYTES = 16 << 20
BUCKET_BITS = 22


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Rarity:
    """Weight of a shingle: log(1 + items / items with its bucket), at least one of them."""

    def __init__(self, items: int, buckets: np.ndarray, counts: np.ndarray):
        self.items = items
        self.count = np.zeros(1 << BUCKET_BITS, np.int32)
        self.count[buckets] = counts

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.log(1 + self.items / np.maximum(self.count[_bucket(s)], 1))


def _item_shingles(text: bytes, n: int) -> np.ndarray:
    h = word_hashes([text])[0]
    return shingles(h, min(n, len(h))) if len(h) else h


def rarity_of(texts: list, n: int) -> Rarity:
    """Of a benchmark at hand."""
    per = [np.unique(_bucket(s)) for s in (_item_shingles(b, n) for b in _bytes(texts)) if len(s)]
    return Rarity(len(per), *count_sorted(np.concatenate(per) if per else np.zeros(0, np.int64)))


def _rarity(items: DataFrame, n: int) -> Rarity:
    """Of a whole benchmark: at most 2^BUCKET_BITS pairs come to the driver."""
    def f(batches):
        for r in batches:
            for i in range(0, r.num_rows, 4096):
                per = [np.unique(_bucket(s)) for s in (_item_shingles(b, n) for b in _bytes(r.column("_text").slice(i, 4096).to_pylist())) if len(s)]
                b, c = count_sorted(np.concatenate([*per, np.full(len(per), -1)]) if per else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["b", "c"])

    t = items.select("_text").mapInArrow(f, "b long, c long").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    b, c = t.column("b").to_numpy(), t.column("c").to_numpy()
    return Rarity(int(c[b == -1].sum()), b[b >= 0], c[b >= 0])


def _bytes(texts) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


def _planes(s: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle's hash."""
    bits = np.unpackbits(mix(s ^ np.uint64(0x5BD1E995)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def simhash(s: np.ndarray, w: np.ndarray, m: int) -> np.ndarray:
    """Fingerprints of all windows of m shingles."""
    c = np.zeros((len(s) + 1, 64))
    np.cumsum(_planes(s) * w[:, None], axis=0, out=c[1:])
    return np.packbits(c[m:] - c[:-m] > 1e-9, axis=1).view(np.uint64).ravel()


_NEAR = [np.array([v for v in range(256) if bin(v).count("1") <= r], np.uint8) for r in range(9)]


class Index:
    """One slice of the benchmark."""

    def __init__(self, ids: list, texts: list, n: int, radius: int, similarity: float, rarity: Rarity | None = None):
        self.n, self.radius, self.similarity = n, radius, similarity
        self.weights = rarity if rarity is not None else rarity_of(texts, n)
        self.items, per = [], []
        for i, b in zip(ids, _bytes(texts)):
            h = word_hashes([b])[0]
            if len(h):
                s = shingles(h, min(n, len(h)))
                self.items.append((i, len(h)))
                per.append(s)
        self.keys = np.unique(np.concatenate(per)) if per else np.zeros(0, np.uint64)
        weight = dict(zip(self.keys.tolist(), self.weights(self.keys).tolist()))
        self.bags = [dict(zip(*(a.tolist() for a in np.unique(s, return_counts=True)))) for s in per]
        self.total = np.array([sum(weight[x] * c for x, c in b.items()) for b in self.bags])
        at = np.concatenate([np.full(len(b), i) for i, b in enumerate(self.bags)]) if per else np.zeros(0, np.int64)
        key = np.searchsorted(self.keys, np.array([x for b in self.bags for x in b], np.uint64))
        gain = np.array([weight[x] * c for b in self.bags for x, c in b.items()])
        o = np.argsort(key, kind="stable")
        self.post_item, self.post_gain = at[o].astype(np.int64), gain[o]
        self.post_at = np.searchsorted(key[o], np.arange(len(self.keys) + 1))
        self.print = np.array([simhash(s, self.weights(s), len(s))[0] for s in per], np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        reach = min(8, radius // 8)
        self.blocks: dict[tuple, np.ndarray] = {}
        groups: dict[int, list[int]] = {}
        for i, (_, size) in enumerate(self.items):
            groups.setdefault(size, []).append(i)
        self.by_size: dict[int, tuple] = {}
        for size, own in groups.items():
            own = np.array(own)
            parts = self.print[own].view(np.uint8).reshape(-1, 8)
            table_ = [[np.zeros(0, np.int64)] * 256 for _ in range(8)]
            for b in range(8):
                to = (parts[:, b][:, None] ^ _NEAR[reach][None, :]).ravel().astype(np.int64)
                who = np.repeat(own, len(_NEAR[reach]))
                o = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[o], np.arange(257))
                for v in range(256):
                    if cut[v + 1] > cut[v]:
                        table_[b][v] = who[o[cut[v]:cut[v + 1]]]
            self.by_size[size] = table_

    def near(self, prints: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(window, item) within the radius, for items of a size."""
        table_, out = self.by_size[size], set()
        parts = prints.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            for v in np.unique(parts[:, b]):
                items = table_[b][v]
                if len(items):
                    w = np.flatnonzero(parts[:, b] == v)
                    far = np.bitwise_count(prints[w][:, None] ^ self.print[items][None, :])
                    x, y = np.nonzero(far <= self.radius)
                    out.update(zip(w[x].tolist(), items[y].tolist()))
        return sorted(out)

    def similar(self, s: np.ndarray, item: int) -> float:
        bag, own = self.bags[item], Counter(s.tolist())
        w = dict(zip(own, self.weights(np.array(list(own), np.uint64)).tolist()))
        both = sum(w[x] * min(c, bag[x]) for x, c in own.items() if x in bag)
        return both / (sum(w[x] * c for x, c in own.items()) + self.total[item] - both)

    def matches(self, texts: list[bytes]):
        """(document, item, similarity, first word, word after the last): the best window, the first among equals, of each pair."""
        if not self.items:
            return
        sizes = sorted({min(self.n, size) for _, size in self.items})
        item_n = np.array([min(self.n, size) for _, size in self.items])
        for a, b in word_groups(texts):
            h, cnt, _, _ = word_hashes(texts[a:b])
            start = np.cumsum(cnt) - cnt
            for n in sizes:
                s = shingles(h, n)
                if not len(s):
                    continue
                p = np.flatnonzero(self.seen[(s >> np.uint64(44)).astype(np.int64)])
                at, hit = find(self.keys, s[p])
                p, at = p[hit], at[hit]
                doc = np.searchsorted(start + cnt, p, side="right")
                inside = p + n <= (start + cnt)[doc] if len(p) else np.zeros(0, bool)
                pair = np.unique(doc[inside] * (len(self.keys) + 1) + at[inside])
                doc, key = pair // (len(self.keys) + 1), pair % (len(self.keys) + 1)
                many = self.post_at[key + 1] - self.post_at[key]
                flat_at = np.repeat(self.post_at[key] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                pairs, gain = count_sorted(np.repeat(doc, many) * len(self.items) + self.post_item[flat_at], self.post_gain[flat_at])
                i = pairs % len(self.items)
                for x in pairs[(gain >= self.similarity * self.total[i] - 1e-9) & (item_n[i] == n)]:
                    d, item = divmod(int(x), len(self.items))
                    own = s[start[d]:start[d] + cnt[d] - n + 1]
                    best = self._best(own, item, n)
                    if best:
                        yield a + d, item, best[0], best[1], best[2]

    def _best(self, s: np.ndarray, item: int, n: int):
        size = self.items[item][1]
        m = min(size - n + 1, len(s))
        bag = np.array(sorted(self.bags[item]), np.uint64)
        gain = np.where(find(bag, s)[1], self.weights(s), 0.0)
        g = np.concatenate(([0.0], np.cumsum(gain)))
        ok = np.flatnonzero(g[m:] - g[:-m] >= self.similarity * self.total[item] - 1e-6)  # other windows can't be similar enough
        best = None
        for at in np.split(ok, np.flatnonzero(np.diff(ok) > m) + 1) if len(ok) else ():
            lo, hi = int(at[0]), int(at[-1]) + m
            prints = simhash(s[lo:hi], self.weights(s[lo:hi]), m)
            for w, i in self.near(prints, size):
                if i == item:
                    v = self.similar(s[lo + w:lo + w + m], item)
                    if v >= self.similarity - 1e-9 and (best is None or v > best[0] + 1e-12):
                        best = (v, lo + w, lo + w + m + n - 1)
        return best


def _slices(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, n: int, radius: int, similarity: float, slice_bytes: int):
    if not 0 <= radius < 64 or not 0 < similarity <= 1:
        raise ValueError("radius must be 0 to 63, similarity over 0 to 1")
    b = pick(benchmark, _id=item_col, _text=text_col).filter("_text is not null").distinct()
    k = n_blocks(text_bytes(b, "_text"), slice_bytes)
    rarity = _rarity(b, n)
    for i in range(k):
        rows = sorted(b.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(k)) == i).collect(), key=lambda r: (str(r[0]), r[1]))
        yield spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], n, radius, similarity, rarity)), k


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  n: int = N, radius: int = RADIUS, similarity: float = SIMILARITY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word: each document's best window for each item that it holds.

    Null and wordless texts, on either side, match nothing. Items of fewer than n words are one shingle. Repeated benchmark rows count
    once; repeated documents are each reported. Null ids, of documents or items, are reported as null. Documents of any length are
    searched whole; of equally similar windows the first is reported. Ids may be of any type, other columns don't matter.
    """
    d = pick(docs, _id=id_col, _text=text_col)
    kinds = [d.schema["_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for shared, k in _slices(docs.sparkSession, benchmark, item_col, item_text, n, radius, similarity, slice_bytes):
        def f(batches, shared=shared):
            index = shared.value
            for r in batches:
                m = list(index.matches(_bytes(r.column("_text").to_pylist())))
                yield pa.RecordBatch.from_arrays([
                    r.column("_id").take(pa.array([x[0] for x in m], pa.int64())), pa.array([index.items[x[1]][0] for x in m], item_kind),
                    pa.array([round(x[2], 6) for x in m], pa.float64()), pa.array([x[3] for x in m], pa.int32()), pa.array([x[4] for x in m], pa.int32())],
                    names=["doc_id", "item_id", "similarity", "first_word", "end_word"])

        one = d.mapInArrow(f, f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word int, end_word int")
        one = written(one, "found") if k > 1 else one  # one slice's index at a time
        out = one if out is None else out.union(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N,
                  radius: int = RADIUS, similarity: float = SIMILARITY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark by contamination(), items of a null id included. Rows of null text stay, repeated rows all stay or all go."""
    out, at = flat(docs)
    for shared, k in _slices(docs.sparkSession, benchmark, item_col, item_text, n, radius, similarity, slice_bytes):
        def f(batches, shared=shared):
            index = shared.value
            for r in batches:
                keep = np.ones(r.num_rows, bool)
                keep[[x[0] for x in index.matches(_bytes(r.column(at[text_col]).to_pylist()))]] = False
                yield r.filter(pa.array(keep))

        out = out.mapInArrow(f, out.schema)
        out = written(out, "kept") if k > 1 else out
    return out.toDF(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
