"""Operator 7, n-gram Jaccard join: a prefix-tree join of word n-gram sets, exact at any size.

1. How many documents have each n-gram (df) is counted over all documents: blocks send their sorted gram hashes to the hash's owner,
   packed, and get df back in the same order. A document with fewer than t*|A| grams that others have too can't have a partner.
2. The rest keep their shared grams in the global order (df, hash), rarest first, and equal sets become one
   (members keep the rows of each set).
3. Sets whose prefixes (the first |A| - ceil(t*|A|) + 1 grams) share a gram, and whose sizes and remaining shared grams leave a pair
   possible, are linked, and links become components: any pair with Jaccard of t or more lies within one. Large components are cut into slices, and each pair of slices is one task.
4. A task puts one slice's sets into a trie and walks it depth first with the overlap of every set of the other slice, shared by all
   that lies below a node; a subtree is left when no overlap can reach the bound with the grams that remain.
5. The result is one row a document with its class (what pairs connect) and its number of links. Tasks sum their pairs before anything is
   shuffled, so that what is moved and returned is linear in the documents, however large a group of copies or near copies is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.llm.common import dropped, find, flat, mix, n_blocks, packed, pick, shingles, table, text_bytes, unpack, word_groups, word_hashes, written

N, THRESHOLD = 3, 0.5
BLOCK_BYTES = 16 << 20
#: Sets in a slice of a component; larger components become more pairs of slices.
SLICE = 1024


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each (lower-case) text; of all its words where they are fewer than n; none without words."""
    out = []
    for a, b in word_groups(texts):
        h, cnt, _, _ = word_hashes(texts[a:b])
        s = shingles(h, n)
        at = np.cumsum(cnt) - cnt
        for i, m in zip(at.tolist(), cnt.tolist()):
            if m >= n:
                g = np.sort(s[i:i + m - n + 1])
                g = g[np.concatenate(([True], g[1:] != g[:-1]))]
            elif m:
                g = shingles(h[i:i + m], m)
            else:
                g = np.zeros(0, np.uint64)
            out.append(g)
    return out


def _lower(col) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in col.to_pylist()]


def _owner(g: np.ndarray, n: int) -> np.ndarray:
    return (((g >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _sorted_block(texts: list[bytes], n: int, buckets: int):
    """All grams of a block sorted, with the number of the document of each, and the borders of the owners' ranges."""
    sets = gram_sets(texts, n)
    sizes = np.array([len(g) for g in sets], np.int64)
    g = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    o = np.argsort(g)
    g, doc = g[o], doc[o]
    return g, doc, sizes, np.searchsorted(_owner(g, buckets), np.arange(buckets + 1))


def jaccard_sets(docs: DataFrame, n: int, t: float, block_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """docs: _id, _text. Returns members, sets and a number of buckets that follows the bytes.

    members: key (of a gram set), _id, _th (hash of the text) of the rows that may have a partner or share their set, each once.
    sets: key, first (the least (_id, _th) of its members), copies (how many they are), size, grams (packed, in global order).
    """
    blocks = n_blocks(text_bytes(docs, "_text"), block_bytes)
    buckets = max(8, 2 * blocks)
    x = packed(docs.withColumn("_th", F.xxhash64("_text")), F.pmod(F.xxhash64("_id", "_text"), F.lit(2 * blocks)), max(2, blocks), once=("_id", "_th"))

    def send(z: pa.Table) -> pa.Table:
        d = unpack(z)
        g, _, _, at = _sorted_block(_lower(d.column("_text")), n, buckets)
        low = g.astype(np.uint32)  # the owner's range tells the high bits closely enough: a false equal only adds a candidate
        rows = [i for i in range(buckets) if at[i + 1] > at[i]]
        return pa.table({"_b": pa.array(rows, pa.int32()), "_block": pa.array([z.column("_block")[0].as_py()] * len(rows), pa.int32()),
                         "_g": pa.array([low[at[i]:at[i + 1]].tobytes() for i in rows], pa.binary())})

    sent = x.groupBy("_block").applyInArrow(send, "_b int, _block int, _g binary").repartition(buckets, "_b")

    def count(d: pa.Table) -> pa.Table:
        parts = [np.frombuffer(a, np.uint32) for a in d.column("_g").to_pylist()]
        g = np.concatenate(parts)
        s = np.sort(g)
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        u, c = s[at], np.minimum(np.diff(np.append(at, len(s))), 255).astype(np.uint8)
        return pa.table({"_block": d.column("_block"), "_b": d.column("_b"), "_df": pa.array([c[np.searchsorted(u, p)].tobytes() for p in parts], pa.binary())})

    df = sent.groupBy("_b").applyInArrow(count, "_block int, _b int, _df binary")

    def order(z: pa.Table, f: pa.Table) -> pa.Table:
        d = unpack(z)
        g, doc, sizes, _ = _sorted_block(_lower(d.column("_text")), n, buckets)
        f = f.sort_by("_b")
        c = np.frombuffer(b"".join(f.column("_df").to_pylist()), np.uint8)
        shared = np.bincount(doc[c > 1], minlength=len(sizes))
        need = np.array([math.ceil(t * s - 1e-9) for s in sizes])
        ok = (sizes > 0) & (shared >= need) & ~d.column("_id").is_null().to_numpy()
        sig = np.zeros(len(sizes), np.uint64)
        np.add.at(sig, doc, mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))  # tells whole sets apart, grams that nobody shares included
        key = mix(sig ^ (sizes.astype(np.uint64) << np.uint64(40))).view(np.int64)
        ids = np.flatnonzero(ok)
        once = np.zeros(len(sizes), bool)
        once[ids[np.unique(key[ids], return_index=True)[1]]] = True  # one row of a block carries the grams of its set
        keep = once[doc] & (c > 1)
        g, doc, c = g[keep], doc[keep], c[keep]
        o = np.lexsort((g, c, doc))
        g = g[o]
        ends = np.cumsum(np.bincount(doc, minlength=len(sizes)))
        return pa.table({"_id": d.column("_id").take(pa.array(ids)), "_th": d.column("_th").take(pa.array(ids)), "key": pa.array(key[ids]), "size": pa.array(sizes[ids], pa.int32()),
                         "grams": pa.array([g[ends[i] - shared[i]:ends[i]].tobytes() if once[i] else None for i in ids], pa.binary())})

    kind = docs.schema["_id"].dataType.simpleString()
    cand = written(x.groupBy("_block").cogroup(df.groupBy("_block")).applyInArrow(order, f"_id {kind}, _th long, key long, size int, grams binary"), "candidates")
    members = cand.select("key", "_id", "_th").distinct()
    count_of = members.groupBy("key").agg(F.min(F.struct("_id", "_th")).alias("first"), F.count("*").alias("copies"))
    grams = cand.filter("grams is not null").groupBy("key").agg(F.first("size").alias("size"), F.first("grams").alias("grams"))
    return members, count_of.join(grams, "key"), buckets


_FAR = 1 << 32


def _links(sets: DataFrame, t: float, buckets: int) -> DataFrame:
    """Distinct (a, b) keys of sets that connect any two sets with Jaccard t or more, by the first gram that they have in common.

    At that gram a set A can still overlap in its `rest` shared grams only, so a partner's size is at most rest * (1 + t) / t - |A|, its
    reach. Of a pair, at least one reaches its own size. Of one gram's sets, those that do are chained while reaches cover the next size,
    and each other set joins the chains with sizes that it reaches; documents that share a passage but little else stay apart.
    """

    def tokens(batches):
        for r in batches:
            size, key = r.column("size").to_numpy().astype(np.int64), r.column("key").to_numpy()
            gs = [np.frombuffer(b, np.uint64) for b in r.column("grams").to_pylist()]
            # grams that no other document has come first in the global order, and take their places in the prefix
            pre = [max(0, s - math.ceil(t * s - 1e-9) + 1 - (s - len(g))) for s, g in zip(size.tolist(), gs)]
            if not sum(pre):
                continue
            g = np.concatenate([a[:p] for a, p in zip(gs, pre)])
            k, n = np.repeat(key, pre), np.repeat(size, pre)
            rest = np.concatenate([len(a) - np.arange(p) for a, p in zip(gs, pre)])
            reach = np.minimum(np.floor(rest * ((1 + t) / t) + 1e-6).astype(np.int64) - n, np.floor(n / t + 1e-6).astype(np.int64))
            ok = reach >= np.ceil(t * n - 1e-6)
            g, k, n, reach = g[ok], k[ok], n[ok], reach[ok]
            b = _owner(g, buckets).astype(np.int32)
            o = np.argsort(b)
            g, k, n, reach, b = g[o].astype(np.uint32), k[o], n[o].astype(np.int32), reach[o].astype(np.int32), b[o]
            at = np.flatnonzero(np.diff(b, prepend=-1))
            cut = list(zip(at.tolist(), [*at[1:].tolist(), len(b)]))
            yield pa.RecordBatch.from_arrays([pa.array(b[at]), *[pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (g, k, n, reach)]],
                                             names=["_b", "_g", "_k", "_n", "_r"])

    def link(d: pa.Table) -> pa.Table:
        g, k, n, reach = (np.frombuffer(b"".join(d.column(c).to_pylist()), kind) for c, kind in (("_g", np.uint32), ("_k", np.int64), ("_n", np.int32), ("_r", np.int32)))
        o = np.lexsort((k, n, g))
        g, k, n, reach = g[o], k[o], n[o].astype(np.int64), reach[o].astype(np.int64)
        g = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])), dtype=np.int64)  # small numbers in the grams' order, so that places fit
        full = reach >= n
        fg, fk, fn = g[full], k[full], n[full]
        far = np.maximum.accumulate(fg * _FAR + reach[full])
        place = fg * _FAR + fn
        new = np.ones(len(fg), bool)
        new[1:] = place[1:] > far[:-1]
        chain = np.cumsum(new) - 1
        head = np.minimum.reduceat(fk, np.flatnonzero(new)) if len(fk) else fk
        pg, pk = g[~full], k[~full]
        lo = np.searchsorted(place, pg * _FAR + np.ceil(t * n[~full] - 1e-6).astype(np.int64))
        hi = np.searchsorted(place, pg * _FAR + reach[~full], side="right")
        pk, lo, hi = pk[hi > lo], lo[hi > lo], hi[hi > lo]
        first, many = chain[lo], chain[hi - 1] - chain[lo] + 1 if len(lo) else lo
        to = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum()) if len(lo) else lo
        a, b = np.concatenate([head[chain], head[to]]), np.concatenate([fk, np.repeat(pk, many)])
        e = np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0)
        return pa.table({"a": e[:, 0].copy(), "b": e[:, 1].copy()})

    return sets.mapInArrow(tokens, "_b int, _g binary, _k binary, _n binary, _r binary").groupBy("_b").applyInArrow(link, "a long, b long").distinct()


def _least(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least node that the edges (x, y) connect each of n nodes with."""
    low = np.arange(n)
    while len(x):
        old = low.copy()
        m = np.minimum(low[x], low[y])
        for z in (x, y):
            np.minimum.at(low, low[z], m)
            np.minimum.at(low, z, m)
        low = low[low]
        if (old == low).all():
            break
    return low


def _stars(batches):
    """The edges (a, b) of each batch as edges from the least node of what they connect."""
    for r in batches:
        a, b = r.column("a").to_numpy(), r.column("b").to_numpy()
        u, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = _least(at[:len(a)], at[len(a):], len(u))
        leaf = np.flatnonzero(low != np.arange(len(u)))
        yield pa.RecordBatch.from_arrays([pa.array(u[low[leaf]]), pa.array(u[leaf])], names=["a", "b"])


def components(edges: DataFrame, name: str = "cc", of: Callable | None = None) -> DataFrame:
    """(node, comp): the least node of each connected component of edges (a, b).

    of: makes batches of edges (a, b) from those of other rows. It runs in the worker that makes stars: two Python steps in one stage take
    two workers a core, which Spark then keeps and uses in turn.

    Edges that a task has at hand become stars before anything is shuffled; then large-star and small-star steps alternate. Each step is
    written to the shared folder, and the table before it goes.
    """
    if of is None:
        local = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").mapInArrow(_stars, "a long, b long")
    else:
        local = edges.mapInArrow(lambda batches: _stars(of(batches)), "a long, b long")
    e = written(local.distinct(), name)
    sums = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
    p = sums(e)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        large = written(large, name)
        # small star: every node's neighbours that are not greater, and itself, to the least of them
        m = large.groupBy("b").agg(F.min("a").alias("m"))
        small = written(large.join(m, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct(), name)
        dropped(large)
        dropped(e)
        e, before, p = small, p, sums(small)
        if p == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def trie_join(tree: list[np.ndarray], sizes_t: np.ndarray, query: list[np.ndarray], sizes_q: np.ndarray, t: float, same: bool):
    """(i, j, Jaccard) of the pairs of trie_rows."""
    for i, js, jac in trie_rows(tree, sizes_t, query, sizes_q, t, same):
        yield from ((i, int(j), float(v)) for j, v in zip(js, jac))


def trie_rows(tree: list[np.ndarray], sizes_t: np.ndarray, query: list[np.ndarray], sizes_q: np.ndarray, t: float, same: bool):
    """(i, all j, their Jaccard) of all pairs of a set of the tree and a query with Jaccard t or more; j > i if both are the same slice.

    Sets are ascending ranks of the global order without the grams that nobody shares; sizes count those too.
    """
    if not tree or not query:
        return
    post = np.concatenate(query)
    who = np.repeat(np.arange(len(query)), [len(q) for q in query])
    o = np.argsort(post, kind="stable")
    post, who = post[o], who[o]
    o = sorted(range(len(tree)), key=lambda i: tree[i].tobytes())  # big-endian: ranks in order
    seq = [np.frombuffer(tree[i].tobytes(), ">u4").astype(np.int64) for i in o]
    lcp = [0] * (len(o) + 1)
    for i in range(1, len(o)):
        a, b = seq[i - 1], seq[i]
        m = min(len(a), len(b))
        d = np.flatnonzero(a[:m] != b[:m])
        lcp[i] = int(d[0]) if len(d) else m
    part = t / (1 + t)
    stack = [(0, np.zeros(len(query), np.int64))]
    i = 0
    while i < len(o):
        while stack[-1][0] > lcp[i]:
            stack.pop()
        # nodes on the way of this set where later sets part from it
        depths, least = [], len(seq[i])
        for j in range(i + 1, len(o)):
            if lcp[j] < least:
                least = lcp[j]
                depths.append(least)
            if least <= stack[-1][0]:
                break
        skip = i + 1
        for d in [*sorted(x for x in depths if x > stack[-1][0]), len(seq[i])]:
            at, have = stack[-1]
            now = have
            if d > at:
                lo, hi = np.searchsorted(post, seq[i][at:d]), np.searchsorted(post, seq[i][at:d], side="right")
                hits = [who[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if b > a]
                now = have + np.bincount(np.concatenate(hits), minlength=len(query)) if hits else have
            below = i + 1
            while below < len(o) and lcp[below] >= d:
                below += 1
            rest = max(len(seq[x]) for x in range(i, below)) - d
            smallest = min(int(sizes_t[o[x]]) for x in range(i, below))
            may = now + rest >= np.ceil(part * (sizes_q + smallest) - 1e-9)
            if same:  # only later sets still have to meet those below
                may &= np.arange(len(query)) > min(o[i:below])
            if not may.any():
                skip = below  # remaining lengths can't lift any overlap to the bound: the subtree goes
                break
            if d == len(seq[i]):
                both = sizes_q + int(sizes_t[o[i]]) - now
                with np.errstate(divide="ignore", invalid="ignore"):
                    jac = now / both
                good = np.flatnonzero((jac >= t - 1e-12) & (now > 0))
                if same:
                    good = good[good > o[i]]
                if len(good):
                    yield o[i], good, jac[good]
            stack.append((d, now))
        i = skip


def _cells(sets: DataFrame, t: float, buckets: int, slice_sets: int) -> DataFrame:
    """Sets by pairs of slices of their components: key, comp, i, j, s (its own slice: i or j), copies, size, grams."""
    comp = components(_links(sets, t, buckets), "links")
    size = comp.groupBy("comp").agg(F.count("*").alias("members"))
    own = comp.join(size, "comp").withColumn("k", F.ceil(F.col("members") / F.lit(slice_sets)).cast("int")).withColumn(
        "s", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    cells = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        F.col("node").alias("key"), "comp", "s", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"))
    return cells.join(sets.select("key", "copies", "size", "grams"), "key")


def _cell_pairs(d: pa.Table, t: float):
    """(row, rows, Jaccards) of the pairs that a cell has to find."""
    i, j, s = (d.column(c).to_numpy() for c in ("i", "j", "s"))
    gs = [np.frombuffer(b, np.uint64) for b in d.column("grams").to_pylist()]
    size = d.column("size").to_numpy().astype(np.int64)
    # the trie's global order: rarest first among the sets of this task, which makes for early leaving
    flat_g = np.concatenate(gs)
    u = np.unique(flat_g)
    freq = np.bincount(np.searchsorted(u, flat_g), minlength=len(u))
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((u, freq))] = np.arange(len(u))
    ranked = [np.sort(rank[np.searchsorted(u, g)]) for g in gs]
    a, b = int(i[0]), int(j[0])
    left = np.flatnonzero(s == a)
    right = left if a == b else np.flatnonzero(s == b)
    for x, y, v in trie_rows([ranked[x].astype(">u4") for x in left], size[left], [ranked[x] for x in right], size[right], t, a == b):
        yield left[x], right[y], v


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD,
                  block_bytes: int = BLOCK_BYTES, slice_sets: int = SLICE) -> DataFrame:
    """doc_a, doc_b, jaccard of all pairs of different gram sets with Jaccard of threshold or more, each set by the least id that has it."""
    _, sets, buckets = jaccard_sets(pick(docs, _id=id_col, _text=text_col), n, threshold, block_bytes)
    sets = written(sets, "sets")

    def run(d: pa.Table) -> pa.Table:
        key, out = d.column("key").to_numpy(), list(_cell_pairs(d, threshold))
        many = [len(y) for _, y, _ in out]
        put = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        return pa.table({"a": key[np.repeat([int(x) for x, _, _ in out], many).astype(np.int64)], "b": key[put([y for _, y, _ in out], np.int64)], "jaccard": put([v for _, _, v in out], np.float64)})

    pairs = _cells(sets, threshold, buckets, slice_sets).groupBy("comp", "i", "j").applyInArrow(run, "a long, b long, jaccard double")
    name = sets.select("key", F.col("first._id").alias("id"))
    far = pairs.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b")
    return far.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))


def _classes(docs: DataFrame, n: int, t: float, block_bytes: int, slice_sets: int) -> tuple[DataFrame, int]:
    """A number of buckets that follows the bytes, and _id, _th, first (least (_id, _th) of its class), copies (rows of the same set, itself included), links (rows of other sets) of the members."""
    members, sets, buckets = jaccard_sets(docs, n, t, block_bytes)
    sets = written(sets, "sets")

    def run(d: pa.Table) -> pa.Table:
        """A cell's pairs, summed: how many partners each set has in it, and the least row that they connect it with."""
        key, copies = d.column("key").to_numpy(), d.column("copies").to_numpy()
        links, ends = np.zeros(len(key), np.int64), [(np.zeros(0, np.int64),) * 2]
        for x, y, _ in _cell_pairs(d, t):
            links[x] += copies[y].sum()
            links[y] += copies[x]
            ends.append((np.full(len(y), x), y))
        low = _least(*(np.concatenate(e) for e in zip(*ends)), len(key))
        own = np.flatnonzero(links)
        return pa.table({"key": key[own], "to": key[low[own]], "links": links[own]})

    found = written(_cells(sets, t, buckets, slice_sets).groupBy("comp", "i", "j").applyInArrow(run, "key long, to long, links long"), "found")
    comp = components(found.select(F.col("key").alias("a"), F.col("to").alias("b")), "groups")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    s = sets.select("key", "first", "copies").join(links, "key", "left").join(comp.toDF("key", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = s.groupBy("comp").agg(F.min("first").alias("least"))
    info = s.join(least, "comp").select("key", F.col("least").alias("first"), "copies", F.coalesce("links", F.lit(0)).alias("links")).filter("copies > 1 or links > 0")
    return members.join(info, "key").drop("key"), buckets


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD,
                 block_bytes: int = BLOCK_BYTES, slice_sets: int = SLICE) -> DataFrame:
    """doc_id, class_id, n_copies, n_links for every row of docs, from all pairs of documents whose word n-gram sets have Jaccard of threshold or more.

    class_id is the least id of those that pairs connect with the document; n_copies how many other documents have its very set, n_links how
    many other documents pair with it, copies included. (jaccard_pairs gives the pairs of different sets themselves.) Null texts and texts
    without words have no pairs: their class is their own id. Null ids have no pairs and a null class. A text of fewer than n words is one
    gram. Rows that repeat an id and its text count once and are returned each. Texts of any length are taken whole.
    """
    d = pick(docs, _id=id_col, _text=text_col)
    c, _ = _classes(d, n, threshold, block_bytes, slice_sets)
    rows = d.select("_id", F.xxhash64("_text").alias("_th"))
    return rows.join(c, ["_id", "_th"], "left").select(F.col("_id").alias("doc_id"), F.coalesce(F.col("first._id"), F.col("_id")).alias("class_id"),
                                                       F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_copies"), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs without all but one of each class of jaccard_join: that of the least id, and of its texts the one of the least hash.

    Documents without words, and rows with a null id, stay. Rows that repeat the id and text that stay do stay.
    """
    p = {"n": N, "threshold": THRESHOLD, "block_bytes": BLOCK_BYTES, "slice_sets": SLICE} | kw
    found, buckets = _classes(pick(docs, _id=id_col, _text=text_col), p["n"], p["threshold"], p["block_bytes"], p["slice_sets"])
    f, at = flat(docs)
    names, parts = f.columns, max(2, buckets // 2)
    block = F.pmod("_k", F.lit(buckets)).cast("int")
    gone = found.filter("struct(_id, _th) <> first").select(F.xxhash64("_id", "_th").alias("_k"), "_th").withColumn("_block", block).repartition(parts, "_block")
    # documents travel to the keys of those that go in packed blocks: the same at any size
    rows = f.withColumn("_th", F.xxhash64(f[at[text_col]])).withColumn("_k", F.xxhash64(f[at[id_col]], "_th"))
    x = packed(rows, block, parts)

    def keep(z: pa.Table, g: pa.Table) -> pa.Table:
        d = unpack(z) if z.num_rows else None
        if d is None:
            return schema.empty_table()
        k, th = g.column("_k").to_numpy(), g.column("_th").to_numpy()
        o = np.argsort(k)
        place, hit = find(k[o], d.column("_k").to_numpy())
        if len(k):
            hit &= th[o][place] == d.column("_th").to_numpy()
        return d.select(names).filter(pa.array(~hit))

    schema = to_arrow_schema(f.schema)
    return x.groupBy("_block").cogroup(gone.groupBy("_block")).applyInArrow(keep, f.schema).toDF(*docs.columns)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
ORACLE_SQL = {"op7_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[\x00-\x20]+', ' ', 'g')), ' ') AS w FROM documents),
 g AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) WHEN w = [''] OR w IS NULL THEN []::VARCHAR[] ELSE [array_to_string(w, ' ')] END) AS g FROM w),
 k AS (SELECT doc_id, g, CASE WHEN len(g) > 0 THEN min(doc_id) OVER (PARTITION BY g) ELSE doc_id END AS s FROM g), n AS (SELECT s, count(*) AS copies, any_value(len(g)) AS size, any_value(g) AS g FROM k GROUP BY s),
 p AS MATERIALIZED (SELECT s, size, unnest(g) AS gram FROM n), x AS MATERIALIZED (SELECT a.s AS a, b.s AS b FROM p a JOIN p b ON a.gram = b.gram AND a.s < b.s AND 2 * least(a.size, b.size) >= greatest(a.size, b.size) GROUP BY a.s, b.s, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.5),
 e AS MATERIALIZED (SELECT a, b FROM x UNION ALL SELECT b, a FROM x), r(s, t) AS (SELECT s, s FROM n UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a), c AS (SELECT s, min(t) AS class_id FROM r GROUP BY s), l AS (SELECT a AS s, sum(copies) AS links FROM e JOIN n ON e.b = n.s GROUP BY a)
 SELECT doc_id, class_id, copies - 1 AS n_copies, (copies - 1 + coalesce(links, 0))::BIGINT AS n_links FROM k JOIN n USING (s) JOIN c USING (s) LEFT JOIN l USING (s)"""}
