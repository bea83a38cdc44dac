"""What the operators share: column picking, the shared folder, blocks of documents, and byte and word arrays."""

from __future__ import annotations

import atexit
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import shared_dir, ship

#: Bytes of text that numpy works on at once; bounds a Python worker's memory, not what is processed.
PIECE = 512 << 10
#: Bytes of rows that a task packs at once.
PACK = 32 << 20
#: Packed bytes that a worker returns at once.
SEND = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Selects columns by exact name under new names; other columns, and names that differ only in case, can't clash."""
    ship(df.sparkSession)
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [c for c in names.values() if c not in at]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{at[c]}").alias(new) for new, c in names.items()])


def flat(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All columns as _c0, _c1, ...; and where each name (its first column) went."""
    ship(df.sparkSession)
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {c: n for c, n in reversed(list(zip(df.columns, names)))}


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors. Gone when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes what written() wrote for df; nothing may read it any more."""
    _drop(df.sparkSession, df.written_at)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM has gone; the cluster's own clean-up of the folder remains
        pass


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0


def n_blocks(total: int, block_bytes: int) -> int:
    return max(1, math.ceil(total / block_bytes))


def packed(df: DataFrame, block: Column, parts: int, once: tuple[str, ...] = ()) -> DataFrame:
    """Rows as (_block int, _z binary): all rows of a task and block in one compressed Arrow stream, shuffled by _block.

    once: columns; of the rows of a task that are equal in them, at least those that are packed together become one.
    Batches are ordered by block as they come and rows leave block by block, so that a worker holds little more than what it packs.
    """
    names = df.columns

    def f(batches):
        held, size = [], 0

        def flush():
            if once:
                t = pa.Table.from_batches([r.select(list(once)) for r, _ in held])
                first = t.append_column("_n", pa.array(np.arange(t.num_rows))).group_by(list(once)).aggregate([("_n", "min")]).column("_n_min")
                if len(first) < t.num_rows:
                    keep, at = np.zeros(t.num_rows, bool), 0
                    keep[first.to_numpy()] = True
                    for i, (r, b) in enumerate(held):
                        own = keep[at:at + len(b)]
                        held[i], at = (r.filter(pa.array(own)), b[own]), at + len(b)
            blocks = np.unique(np.concatenate([b for _, b in held]))
            ranges = [(r.select(names), np.searchsorted(b, blocks).tolist(), np.searchsorted(b, blocks, side="right").tolist()) for r, b in held]
            done, z, full = [], [], 0
            for k, block in enumerate(blocks.tolist()):
                t = pa.Table.from_batches([r.slice(lo[k], hi[k] - lo[k]) for r, lo, hi in ranges if hi[k] > lo[k]]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t)
                done.append(block)
                z.append(sink.getvalue().to_pybytes())
                full += len(z[-1])
                if full > SEND or k == len(blocks) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32()), pa.array(z, pa.binary())], names=["_block", "_z"])
                    done, z, full = [], [], 0

        for r in batches:
            if r.num_rows:
                b = r.column("_block").to_numpy()
                o = np.argsort(b, kind="stable")
                held.append((r.take(pa.array(o)), b[o]))
                size += r.nbytes
                if size > PACK:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return df.withColumn("_block", block.cast("int")).mapInArrow(f, "_block int, _z binary").repartition(parts, "_block")


def unpack(t: pa.Table) -> pa.Table:
    """The rows that packed() put into a table's streams."""
    z = sorted(t.column("_z").to_pylist())  # the order in which a shuffle brings them may differ between two reads
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in z])


def squeezed(a: np.ndarray) -> bytes:
    """An array of numbers, compressed by byte planes; ascending integers are best given as differences."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 3)


def expanded(z: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(z), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def squeezed_sorted(a: np.ndarray) -> bytes:
    return squeezed(np.diff(a, prepend=a.dtype.type(0)))


def expanded_sorted(z: bytes, kind) -> np.ndarray:
    return np.cumsum(expanded(z, kind), dtype=kind)


# ------------------------------------------------------------------ bytes


def encode(values) -> list[bytes | None]:
    """Python strings as UTF-8; unpaired surrogates, which Spark can't hold anyway, become '?'."""
    return [None if v is None else v.encode("utf-8", "replace") for v in values]


def pieces(texts: list[bytes], k: int, limit: int = PIECE):
    """Groups of (index, k bytes of context, bytes) of at most about limit bytes; long texts are cut, the context carries over."""
    group, size = [], 0
    pad = b"\0" * k
    for i, t in enumerate(texts):
        for at in range(0, len(t), limit):
            part = t[at:at + limit]
            ctx = (pad + t[max(0, at - k):at])[-k:] if k else b""
            if group and size + len(part) > limit:
                yield group
                group, size = [], 0
            group.append((i, ctx, part))
            size += len(part)
    if group:
        yield group


def byte_grams(group, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k+1)-byte keys at each byte of a group of pieces, the first byte highest; with the index and key count of each piece."""
    buf = np.frombuffer(b"".join(c + p for _, c, p in group), np.uint8)
    lens = np.array([len(p) for _, _, p in group], np.int64)
    mark = np.zeros(len(buf) + 1, np.int8)
    starts = np.cumsum(lens + k) - lens
    mark[starts] += 1
    mark[starts + lens] -= 1
    keep = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
    x = buf.astype(np.int64)
    g = x[k:].copy()
    for j in range(1, k + 1):
        g |= x[k - j:len(x) - j] << (8 * j)
    return g[keep[k:]], np.array([i for i, _, _ in group], np.int64), lens


def count_sorted(a: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with counts, or sums of w."""
    if w is None:
        a = np.sort(a)
        if not len(a):
            return a, np.zeros(0, np.int64)
        at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        return a[at], np.diff(np.append(at, len(a)))
    o = np.argsort(a, kind="stable")
    a, w = a[o], w[o]
    if not len(a):
        return a, w
    at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    return a[at], np.add.reduceat(w, at)


def find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of q in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    at = np.searchsorted(keys, q)
    at[at == len(keys)] = 0
    return at, keys[at] == q


# ------------------------------------------------------------------ words

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for i, p in enumerate((_P, _PINV)):
            a = np.full(n, p, np.uint64)
            a[0] = 1
            _POW[i] = np.cumprod(a, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes over 0x20) of all texts; each text's word count; words' starts and ends in it."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = buf > 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    s, e = edge[0::2], edge[1::2]
    pw, inv = _powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[:len(buf)], out=c[1:])
    h = mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(s, ends), prepend=0)
    base = np.repeat(ends - [len(t) + 1 for t in texts], n)
    return h, n.astype(np.int64), s - base, e - base


def word_groups(texts: list[bytes], limit: int = PIECE):
    """Ranges (a, b) of texts of together about limit bytes; a longer text stands alone."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (len(h) - n + 1 of them), over texts' borders too."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + m]
    return mix(out)
