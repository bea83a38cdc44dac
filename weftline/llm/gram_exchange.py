"""A byte n-gram model of the whole corpus without a broadcast: costs travel only to the blocks of documents that need them.

Documents are hashed into blocks of bounded size, each block into one of two folds. Every block sends each of its distinct
(k+1)-byte grams once, with its count, to the partition that owns the gram's last two context bytes; there all grams of orders
2 to k that share this suffix meet, so that a gram's cost under the other fold's model can be worked out exactly. Orders 1 and 0
(at most 65,536 keys a group and fold) and a model's global numbers are summed once and copied to each of these partitions.
The costs then go back to the blocks that asked. One text shuffle (reused), two shuffles of distinct grams, nothing on the driver.

Lists of distinct grams grow far slower than text. With more than FAN blocks they are therefore merged FAN by FAN on their way to the
partitions of suffixes, and the costs come back along the same tree, so that no task reads more than FAN lists, however hot its suffix.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import (byte_grams, count_sorted, encode, expanded, expanded_sorted, find, n_blocks, packed, pieces, squeezed,
                                 squeezed_sorted, text_bytes, unpack)

BLOCK_BYTES = 32 << 20
#: Blocks whose grams are merged at once, and the most partitions of suffixes; what one task reads is so bounded at any number of blocks.
FAN, MOST_PIDS = 256, 4096
#: Stands for all groups together.
POOL = "\0"


class _Grams:
    """Distinct grams of each (block, fold, group), with counts and the partition that owns them."""

    def __init__(self, order: int, n_pid: int):
        self.order, self.n_pid = order, n_pid
        self.held: dict[tuple, list] = {}

    def _squeeze(self, key):
        parts = self.held[key]
        self.held[key] = [count_sorted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]

    def add(self, block: int, grp: list, fold: list, texts: list, counts: list | None = None) -> None:
        rows: dict[tuple, list] = {}
        for i, t in enumerate(texts):
            if t:
                rows.setdefault((block, fold[i], grp[i], counts is None or bool(counts[i])), []).append(t)
        for (*key, counted), ts in rows.items():
            key = tuple(key)
            parts = self.held.setdefault(key, [])
            for group in pieces(ts, self.order):
                g, n = count_sorted(byte_grams(group, self.order)[0])
                parts.append((g, n if counted else np.zeros_like(n)))
                if len(parts) >= 16:
                    self._squeeze(key)
                    parts = self.held[key]

    def rows(self):
        for key in list(self.held):
            self._squeeze(key)
            g, n = self.held.pop(key)[0]
            pair = ((g >> 8) & 0xFFFF).astype(np.uint64)
            pid = (((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(self.n_pid)).astype(np.int32)
            o = np.argsort(pid, kind="stable")
            g, n, pid = g[o], n[o], pid[o]
            at = np.flatnonzero(np.diff(pid, prepend=-1))
            cut = list(zip(at.tolist(), [*at[1:].tolist(), len(g)]))
            yield pa.RecordBatch.from_arrays([
                pa.array(pid[at]), pa.array([key[0]] * len(at), pa.int32()), pa.array([key[1]] * len(at), pa.int32()), pa.array([key[2]] * len(at), pa.string()),
                pa.array([squeezed_sorted(g[i:j]) for i, j in cut], pa.binary()), pa.array([squeezed(n[i:j].astype(np.uint32)) for i, j in cut], pa.binary())],
                names=["_pid", "_block", "_fold", "_grp", "_grams", "_ns"])


_GRAMS = "_pid int, _block int, _fold int, _grp string, _grams binary, _ns binary"


def _groups_of(b: pa.Table) -> list:
    return ["" if g is None else g for g in b.column("_grp").to_pylist()]


def _grams_by(order: int, n_pid: int):
    """mapInArrow over packed blocks, whose last bit is their documents' fold."""

    def f(batches):
        g = _Grams(order, n_pid)
        for block, b in ((k.as_py(), unpack(pa.table({"_z": pa.array([z])}))) for r in batches for k, z in zip(r.column("_block"), r.column("_z"))):
            g.add(block, _groups_of(b), [block & 1] * b.num_rows, encode(b.column("_text").to_pylist()))
        yield from g.rows()

    return f


def _lists(t: pa.Table, kind) -> dict[tuple, list]:
    """Each group and fold with its rows' numbers, grams and counts."""
    rows: dict[tuple, list] = {}
    for i, (name, fold, g, c) in enumerate(zip(*(t.column(k).to_pylist() for k in ("_grp", "_fold", "_grams", "_ns")))):
        rows.setdefault((name, fold), []).append((i, expanded_sorted(g, np.int64), expanded(c, kind).astype(np.int64)))
    return rows


def _merge(kind):
    """One list of grams for each group and fold of the blocks of an _up, which takes the place of their number."""

    def f(t: pa.Table) -> pa.Table:
        pid, up = t.column("_pid")[0].as_py(), t.column("_up")[0].as_py()
        rows = []
        for (name, fold), own in sorted(_lists(t, kind).items()):
            g, c = count_sorted(np.concatenate([r[1] for r in own]), np.concatenate([r[2] for r in own]))
            rows.append((name, fold, squeezed_sorted(g), squeezed(c.astype(np.uint64))))
        n = len(rows)
        cols = list(zip(*rows))
        return pa.table({"_pid": pa.array([pid] * n, pa.int32()), "_block": pa.array([up] * n, pa.int32()), "_fold": pa.array(cols[1], pa.int32()), "_grp": pa.array(cols[0], pa.string()), "_grams": pa.array(cols[2], pa.binary()), "_ns": pa.array(cols[3], pa.binary())})

    return f


def _split(t: pa.Table, up: pa.Table) -> pa.Table:
    """The costs of blocks' lists from those of the list that they were merged to."""
    known = {(n, f): (expanded_sorted(g, np.int64), expanded(b, np.float32)) for n, f, g, b in zip(*(up.column(k).to_pylist() for k in ("_grp", "_fold", "_grams", "_bits")))}
    bits = []
    for n, f, g in zip(*(t.column(k).to_pylist() for k in ("_grp", "_fold", "_grams"))):
        keys, vals = known[n, f]
        bits.append(squeezed(vals[np.searchsorted(keys, expanded_sorted(g, np.int64))]))
    return t.select(["_pid", "_block", "_fold", "_grp", "_grams"]).append_column("_bits", pa.array(bits, pa.binary()))


_COSTS = "_pid int, _block int, _fold int, _grp string, _grams binary, _bits binary"


def _packed_sums(t: pa.Table) -> pa.Table:
    o = np.argsort(t.column("_key").to_numpy())
    return pa.table({"_grp": t.column("_grp")[:1], "_fold": t.column("_fold")[:1], "_tag": t.column("_tag")[:1], "_keys": pa.array([squeezed_sorted(t.column("_key").to_numpy()[o])], pa.binary()), "_vals": pa.array([squeezed(t.column("_val").to_numpy()[o])], pa.binary())})


def _of_groups(d: pa.Table, block: int, near: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The fold of each document of a block, which its group of copies decides, and whether it is the group's first."""
    k, first = near.column("_k").to_numpy(), near.column("_first").to_numpy()
    o = np.argsort(k)
    own = d.column("_k").to_numpy()
    at, hit = find(k[o], own)
    to = first[o][at] if len(k) else own
    return np.where(hit, to & 1, block & 1), ~hit | (to == own)


def _grams_near(order: int, n_pid: int):
    """The same with the blocks' groups of copies: of each group the first counts, and of rows with the same key one."""

    def f(z: pa.Table, near: pa.Table) -> pa.Table:
        g = _Grams(order, n_pid)
        if z.num_rows:
            block, d = z.column("_block")[0].as_py(), unpack(z)
            fold, first = _of_groups(d, block, near)
            once = np.zeros(len(first), bool)
            once[np.unique(d.column("_k").to_numpy(), return_index=True)[1]] = True
            g.add(block, _groups_of(d), fold.tolist(), encode(d.column("_text").to_pylist()), (first & once).tolist())
        rows = list(g.rows())
        return pa.Table.from_batches(rows) if rows else pa.table({"_pid": pa.array([], pa.int32()), "_block": pa.array([], pa.int32()), "_fold": pa.array([], pa.int32()), "_grp": pa.array([], pa.string()),
                                                                  "_grams": pa.array([], pa.binary()), "_ns": pa.array([], pa.binary())})

    return f


class Low:
    """Global sums of one group and fold: order-1 table by (context byte, symbol), and numbers by tag."""

    def __init__(self):
        self.pair = np.zeros(65536, np.int64)
        self.tags: dict[int, dict[int, int]] = {}


def exchange(docs: DataFrame, grp: str | None, order: int, summarize: Callable, costs: Callable, block_bytes: int = BLOCK_BYTES, least: int = 0,
             near: DataFrame | None = None, fan: int = FAN):
    """docs: _id, _text, and the group's column grp if any. Returns (packed documents by _block, costs by _block, _fold and _grp: _grams, _bits,
    both squeezed; number of blocks; what each _grp spends: _spent and _pooled bits for _train bytes).

    summarize(grams, counts) -> [(tag, key, value)]: what is to be summed over the corpus for a group and fold; tag 0 fills Low.pair.
    costs(query grams, model grams, model counts, Low) -> bits of each query gram under the model.
    Groups of fewer than least bytes that count are scored with the model of all groups. With least, _pooled is what every
    group would spend under that model.
    near: _k, _h and _first of documents with copies, docs having _k and _h = xxhash64(_id, _text); documents of a _first lie in one
    fold, and only the one whose _k it is counts in the model and in what is spent. Of rows with one _k one counts.
    """
    n = n_blocks(text_bytes(docs, "_text"), block_bytes)
    n_pid = min(max(8, n), MOST_PIDS)
    at = lambda h: F.pmod(F.shiftright(h, 8), F.lit(n)) * 2 + F.pmod(h, F.lit(2))
    h = F.xxhash64("_id", "_text")
    # rows that are repeated very often don't meet in one block; a task that is run again has the same number
    block = at(h) if near is not None else F.pmod(F.xxhash64("_id", "_text", F.spark_partition_id()), F.lit(n)) * 2 + F.pmod(h, F.lit(2))
    x = packed(docs.withColumn("_grp", F.col(grp) if grp else F.lit("")), block, max(n, 2))
    if near is None:
        e = x.mapInArrow(_grams_by(order, n_pid), _GRAMS)
    else:
        near = near.withColumn("_block", at(F.col("_h")).cast("int")).select("_block", "_k", "_first").repartition(max(n, 2), "_block")
        e = x.groupBy("_block").cogroup(near.groupBy("_block")).applyInArrow(_grams_near(order, n_pid), _GRAMS)

    # Blocks' grams are merged FAN by FAN, until FAN or fewer lists of them are left for each partition of suffixes
    levels, parents = [], 2 * n
    while parents > fan:
        parents = math.ceil(parents / fan)
        e = e.withColumn("_up", (F.col("_block") / fan).cast("int")).repartition(min(n_pid * parents, 4 * n), "_pid", "_up")
        levels.append(e)
        e = e.groupBy("_pid", "_up").applyInArrow(_merge(np.uint64 if len(levels) > 1 else np.uint32), _GRAMS)
    e = e.repartition(n_pid, "_pid")
    wide = np.uint64 if levels else np.uint32

    def folds(t: pa.Table):
        return _lists(t, wide)

    def merged(rows):
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return count_sorted(np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]))

    def model(rows):
        g, c = merged(rows)
        return (g, c) if (c > 0).all() else (g[c > 0], c[c > 0])

    def pooled(rows):
        if least:
            for f in (0, 1):
                both = [r for (_, fold), own in rows.items() if fold == f for r in own]
                if both:
                    rows[POOL, f] = both
        return rows

    def sums(t: pa.Table) -> pa.Table:
        out = []
        for (name, f), rows in pooled(folds(t)).items():
            g, c = model(rows)
            for tag, key, val in summarize(g, c):
                out.append(pa.table({"_grp": pa.array([name] * len(key), pa.string()), "_fold": np.full(len(key), f, np.int32), "_tag": np.full(len(key), tag, np.int32), "_key": key.astype(np.int64), "_val": val.astype(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({"_grp": pa.array([], pa.string()), "_fold": pa.array([], pa.int32()), "_tag": pa.array([], pa.int32()), "_key": pa.array([], pa.int64()), "_val": pa.array([], pa.int64())})

    low = e.groupBy("_pid").applyInArrow(sums, "_grp string, _fold int, _tag int, _key long, _val long").groupBy(
        "_grp", "_fold", "_tag", "_key").agg(F.sum("_val").alias("_val"))
    # a packed row for each group, fold and kind of sum, copied to every partition of suffixes
    low = low.groupBy("_grp", "_fold", "_tag").applyInArrow(_packed_sums, "_grp string, _fold int, _tag int, _keys binary, _vals binary").withColumn("_pid", F.explode(F.sequence(F.lit(0), F.lit(n_pid - 1))))

    def price(t: pa.Table, lt: pa.Table) -> pa.Table:
        lows: dict[tuple, Low] = {}
        for name, f, tag, ks, vs in zip(*(lt.column(c).to_pylist() for c in ("_grp", "_fold", "_tag", "_keys", "_vals"))):
            lo = lows.setdefault((name, f), Low())
            keys, vals = expanded_sorted(ks, np.int64), expanded(vs, np.int64)
            if tag == 0:
                lo.pair[keys] = vals
            else:
                lo.tags[tag] = dict(zip(keys.tolist(), vals.tolist()))
        rows = pooled(folds(t))
        out: list = [None] * t.num_rows
        spent, pool, count = np.zeros(t.num_rows), np.zeros(t.num_rows), np.zeros(t.num_rows, np.int64)
        for (name, f), own in rows.items():
            small = name != POOL and sum(lows[name, x].pair.sum() for x in (0, 1) if (name, x) in lows) < least
            if small:
                continue
            g, _ = merged(own)
            b = costs(g, *model(rows.get((name, 1 - f))), lows.get((name, 1 - f)) or Low())
            for i, gram, n in own:
                at = np.searchsorted(g, gram)
                if name == POOL:
                    pool[i] = (b[at] * n).sum()
                    if out[i] is not None:
                        continue
                out[i] = squeezed(b[at].astype(np.float32))
                spent[i], count[i] = (b[at] * n).sum(), n.sum()
        return pa.table({"_pid": t.column("_pid"), "_block": t.column("_block"), "_fold": t.column("_fold"), "_grp": t.column("_grp"), "_grams": t.column("_grams"), "_bits": pa.array(out, pa.binary()),
                         "_spent": spent, "_pooled": pool, "_count": count})

    c = e.groupBy("_pid").cogroup(low.groupBy("_pid")).applyInArrow(price, _COSTS + ", _spent double, _pooled double, _count long")
    spent = c.groupBy("_grp").agg(F.sum("_spent").alias("_spent"), F.sum("_pooled").alias("_pooled"), F.sum("_count").alias("_train"))
    if not levels:
        c = c.repartition(max(n, 2), "_block")
        spent = c.groupBy("_grp").agg(F.sum("_spent").alias("_spent"), F.sum("_pooled").alias("_pooled"), F.sum("_count").alias("_train"))
    for e in reversed(levels):
        c = e.groupBy("_pid", "_up").cogroup(c.select(*[F.col(k.split()[0]) for k in _COSTS.split(", ")]).withColumnRenamed("_block", "_up").groupBy("_pid", "_up")).applyInArrow(_split, _COSTS)
    if levels:
        c = c.repartition(max(n, 2), "_block")
    c = c.select("_block", "_fold", "_grp", "_grams", "_bits")
    if near is not None:
        c = c.withColumn("_k", F.lit(None).cast("long")).withColumn("_first", F.lit(None).cast("long")).unionByName(near, allowMissingColumns=True)
    return x, c, n, spent


def score(order: int):
    """Function of (a block's number and documents, its costs) -> (bytes, bits) of each document; no bytes where the text is null or empty."""

    def f(block: int, docs: pa.Table, costs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        texts = encode(docs.column("_text").to_pylist())
        grp = np.array(_groups_of(docs), object)
        size = np.array([len(t or b"") for t in texts], np.int64)
        bits = np.zeros(len(texts))
        fold = np.full(len(texts), block & 1)
        if "_k" in costs.column_names:
            fold, _ = _of_groups(docs, block, costs.filter(pc.is_valid(costs.column("_k"))))
        by: dict[tuple, list] = {}
        for name, own, g, b in zip(*(costs.column(k).to_pylist() for k in ("_grp", "_fold", "_grams", "_bits"))):
            if g is not None:
                by.setdefault((name, own), []).append((expanded_sorted(g, np.int64), expanded(b, np.float32)))
        for (name, f), parts in by.items():
            keys, vals = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.float64)
            o = np.argsort(keys)
            keys, vals = keys[o], vals[o]
            own = np.flatnonzero((grp == name) & (fold == f) & (size > 0))
            for group in pieces([texts[i] for i in own], order):
                g, idx, lens = byte_grams(group, order)
                s = np.add.reduceat(vals[np.searchsorted(keys, g)], np.cumsum(lens) - lens)
                np.add.at(bits, own[idx], s)
        return size, bits

    return f
