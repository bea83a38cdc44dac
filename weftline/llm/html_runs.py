"""Operator 3, HTML extraction: a suffix array of each host finds what its pages repeat; what is unique to a page stays.

1. Pages become streams of tokens (words of their text; scripts, styles, comments and tags go).
2. A host's pages, one copy of each stream, are concatenated and their suffixes sorted by prefix doubling to a depth of MIN_TOKENS: deeper
   order can't change which places lie in a repeat of that length. Neighbours in the array that agree to the full depth and come from
   distinct pages mark their tokens as boilerplate, so that every maximal repeat of MIN_TOKENS or more is covered whole.
3. A host of more than BLOCK_BYTES is sorted in slices (by the stream's hash, equal streams together). The slices of a host exchange what
   tells their full-depth prefixes apart, in two steps: first 32 bits of each distinct minimizer (one for some four tokens), which leaves
   the prefixes whose minimizer another slice has too; then the hashes of those alone. Owners of hashes return those of several slices.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import mix, n_blocks, packed, pick, shingles, table, unpack, word_hashes, written

MIN_TOKENS = 10
BLOCK_BYTES = 8 << 20

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)\b.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S | re.I)
_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|small|big|sub|sup|font|mark|abbr|cite|code|q|wbr|tt|kbd|var|ins|del|label)\b", re.I)
_CONTROL = re.compile(r"[\x00-\x20\x7f-\xa0]+")


def page_text(page: str | None) -> str:
    """A page's words, one blank between any two. Inline tags don't part words; other tags do. What isn't closed runs to the end."""
    if not page:
        return ""
    text = html.unescape(_DROP.sub(lambda m: "" if _INLINE.match(m[0]) else " ", page))
    return " ".join(_CONTROL.sub(" ", text).split())


def ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """Order of each suffix by its first `depth` tokens (equal where those are equal), by prefix doubling; the last depth - 1 are left out."""
    r, p = ids.astype(np.int64), 1
    n = len(ids)
    while p < depth:
        step = min(p, depth - p)
        m = n - p - step + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        key = r[:m] * (int(r.max()) + 1) + r[step:step + m]
        r = np.unique(key, return_inverse=True)[1]
        p += step
    return r


class Host:
    """The distinct streams of one host, or of a slice of it, as one suffix array."""

    def __init__(self, streams: list[bytes], depth: int, seed: int):
        self.depth = depth
        self.h, self.n, _, _ = word_hashes(streams)
        self.start = np.cumsum(self.n) - self.n
        page = np.repeat(np.arange(len(streams)), self.n)
        total = len(self.h)
        own = np.arange(total) <= np.repeat(self.start + self.n, self.n) - depth if total else np.zeros(0, bool)  # suffixes with depth tokens in their page
        self.at = np.flatnonzero(own)
        r = ranks(np.unique(self.h, return_inverse=True)[1], depth)[self.at] if len(self.at) else np.zeros(0, np.int64)
        o = np.argsort(r, kind="stable")
        self.suffixes = self.at[o]
        self.first = np.flatnonzero(np.diff(r[o], prepend=-1))
        self.many = np.diff(np.append(self.first, len(o)))
        p = page[self.suffixes]
        self.repeated = np.minimum.reduceat(p, self.first) != np.maximum.reduceat(p, self.first) if len(o) else np.zeros(0, bool)
        self.seed = np.uint64(seed & ((1 << 64) - 1))

    def keys(self) -> np.ndarray:
        """Hashes of the distinct prefixes of full depth."""
        return mix(shingles(self.h, self.depth)[self.suffixes[self.first]] ^ self.seed) if len(self.first) else np.zeros(0, np.uint64)

    def minimizers(self) -> np.ndarray:
        """Of each distinct prefix of full depth the least hash of its runs of half that length: equal prefixes have equal ones."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        half = (self.depth + 1) // 2
        g = mix(shingles(self.h, half) ^ self.seed)
        m = g[:len(self.h) - self.depth + 1].copy()
        for j in range(1, self.depth - half + 1):
            np.minimum(m, g[j:j + len(m)], out=m)
        return m[self.suffixes[self.first]]

    def covered(self, elsewhere: np.ndarray | None = None) -> list[np.ndarray]:
        """For each stream, which tokens lie in a repeat. elsewhere: sorted keys that other slices have too."""
        hit = self.repeated
        if elsewhere is not None and len(elsewhere) and len(hit):
            hit = hit | np.isin(self.keys(), elsewhere)
        at = self.suffixes[np.repeat(hit, self.many)]
        mark = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + self.depth, -1)
        c = np.cumsum(mark[:-1]) > 0
        return [c[a:a + k] for a, k in zip(self.start.tolist(), self.n.tolist())]


def unique_runs(text: str, covered: np.ndarray) -> tuple[str, int]:
    """The runs of tokens that aren't covered, one a line, and how many tokens they have."""
    words = text.split(" ") if text else []
    edge = np.flatnonzero(np.diff(np.concatenate(([1], covered.astype(np.int8), [1]))))
    return "\n".join(" ".join(words[a:b]) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())), len(words) - int(covered.sum())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = MIN_TOKENS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """page_id, host, text (the page's unique runs, one a line), n_tokens, n_kept for every row.

    A null page has null text and 0 tokens; an empty one an empty text. Pages of equal streams, repeated rows among them, count as one page
    and keep the same runs; each row is returned. Pages of any length are taken whole. A null id is given back as null. Pages with null urls, or urls without a host, form one group, with a null host. A host with one distinct page keeps everything.
    """
    if min_tokens < 1:
        raise ValueError("min_tokens must be at least 1")
    spark = pages.sparkSession
    d = pick(pages, _id=id_col, _url=url_col, _html=html_col)
    host = F.lower(F.regexp_extract(F.coalesce("_url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    d = d.select("_id", host.alias("_host"), "_html")
    size = d.groupBy("_host").agg(F.sum(F.octet_length("_html")).alias("_size"))
    total = size.agg(F.sum("_size")).first()[0] or 0
    n = n_blocks(total, block_bytes)
    # hosts of several slices, as a written table, whose size lets Spark choose between broadcast and join
    hot = written(size.filter(F.col("_size") > block_bytes).select("_host", F.ceil(F.col("_size") / F.lit(block_bytes)).cast("int").alias("_k")), "hosts")

    def parse(batches):
        for r in batches:
            texts = [None if p is None else page_text(p) for p in r.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([r.column("_id"), r.column("_host"), pa.array(texts, pa.string())], names=["_id", "_host", "_text"])

    id_type = d.schema["_id"].dataType.simpleString()
    t = d.mapInArrow(parse, f"_id {id_type}, _host string, _text string").join(hot, "_host", "left")
    t = t.select("_id", "_host", "_text", F.coalesce("_k", F.lit(1)).alias("_k"), F.pmod(F.xxhash64("_text"), F.coalesce("_k", F.lit(1))).cast("int").alias("_slice"))
    x = packed(t, F.pmod(F.xxhash64("_host", "_slice"), F.lit(n)), max(n, 2))
    buckets = max(8, n // 4)

    def groups(z: pa.Table, only_hot: bool):
        """Of each host and slice: rows' numbers, the distinct streams' numbers for them, and the suffix array."""
        u = unpack(z)
        cols = {c: u.column(c).to_pylist() for c in ("_host", "_slice", "_k", "_text")}
        by: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(cols["_host"], cols["_slice"], cols["_k"])):
            if key[2] > 1 or not only_hot:
                by.setdefault(key, []).append(i)
        for key in sorted(by):
            rows, of = by[key], {}
            which = [of.setdefault(cols["_text"][i] or "", len(of)) for i in rows]
            seed = int(word_hashes([key[0].encode("utf-8", "replace") or b"-"])[0].sum())
            yield u, key, rows, which, Host([s.encode("utf-8", "replace") for s in of], min_tokens, seed)

    def owner(keys: np.ndarray) -> np.ndarray:
        return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)

    def addressed(block: int, slices: list[tuple[int, np.ndarray]], low: bool) -> pa.Table:
        out: dict[str, list] = {"_b": [], "_s": [], "_h": []}
        for s, keys in slices:
            keys = np.unique(keys)
            b = owner(keys)
            at = np.flatnonzero(np.diff(b, prepend=-1))
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(b)]):
                out["_b"].append(int(b[i]))
                out["_s"].append(s)
                out["_h"].append((keys[i:j].astype(np.uint32) if low else keys[i:j]).tobytes())
        return pa.table({"_b": pa.array(out["_b"], pa.int32()), "_block": pa.array([block] * len(out["_b"]), pa.int32()), "_s": pa.array(out["_s"], pa.int32()), "_h": pa.array(out["_h"], pa.binary())})

    def send(z: pa.Table) -> pa.Table:
        return addressed(z.column("_block")[0].as_py(), [(key[1], h.minimizers()) for _, key, _, _, h in groups(z, True)], True)

    def shared(kind):
        def f(t: pa.Table) -> pa.Table:
            parts = [np.frombuffer(v, kind) for v in t.column("_h").to_pylist()]
            s = np.sort(np.concatenate(parts))
            twice = np.unique(s[1:][s[1:] == s[:-1]])  # each slice sends a key once
            return pa.table({"_block": t.column("_block"), "_b": t.column("_b"), "_h": pa.array([p[np.isin(p, twice)].tobytes() for p in parts], pa.binary())})

        return f

    def send_full(z: pa.Table, near: pa.Table) -> pa.Table:
        rows = list(zip(near.column("_b").to_pylist(), near.column("_h").to_pylist()))
        known = np.unique(np.concatenate([np.frombuffer(v, np.uint32).astype(np.int64) | (b << 32) for b, v in rows])) if rows else np.zeros(0, np.int64)
        found = []
        for _, key, _, _, h in groups(z, True) if z.num_rows and len(known) else ():
            m = h.minimizers()
            found.append((key[1], h.keys()[np.isin(m.astype(np.uint32).astype(np.int64) | (owner(m).astype(np.int64) << 32), known)]))
        return addressed(z.column("_block")[0].as_py() if z.num_rows else 0, found, False)

    def finish(z: pa.Table, more: pa.Table) -> pa.Table:
        elsewhere = np.unique(np.frombuffer(b"".join(more.column("_h").to_pylist()), np.uint64))
        order, hosts, texts, sizes, kept = [], [], [], [], []
        u = None
        for u, key, rows, which, h in groups(z, False):
            cover = h.covered(elsewhere if key[2] > 1 else None)
            col = u.column("_text")
            done: dict[int, tuple] = {}
            for i, w in zip(rows, which):
                t = col[i].as_py()
                if w not in done:
                    done[w] = unique_runs(t or "", cover[w])
                order.append(i)
                hosts.append(key[0] or None)
                texts.append(None if t is None else done[w][0])
                sizes.append(int(len(cover[w])))
                kept.append(done[w][1])
        return pa.table({"page_id": u.column("_id").take(pa.array(order, pa.int64())), "host": pa.array(hosts, pa.string()), "text": pa.array(texts, pa.string()), "n_tokens": pa.array(sizes, pa.int32()), "n_kept": pa.array(kept, pa.int32())})

    to, back = "_b int, _block int, _s int, _h binary", "_block int, _b int, _h binary"
    near = x.groupBy("_block").applyInArrow(send, to).groupBy("_b").applyInArrow(shared(np.uint32), back)
    keys = x.groupBy("_block").cogroup(near.groupBy("_block")).applyInArrow(send_full, to).groupBy("_b").applyInArrow(shared(np.uint64), back)
    return x.groupBy("_block").cogroup(keys.groupBy("_block")).applyInArrow(finish, f"page_id {id_type}, host string, text string, n_tokens int, n_kept int")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
