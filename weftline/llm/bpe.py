"""Operator 6, BPE encoding and decoding, with chunks of text that documents share encoded once.

1. Documents are packed into blocks. Each text is cut where a rolling hash over its bytes has a pattern (content-defined chunks, so that
   copies are cut alike wherever they stand). Only chunks' hashes travel to their owners, which find those that occur more than once
   and name one block to encode each.
2. The named blocks encode their shared chunks, once each in the whole corpus, and send the tokens to the blocks that need them;
   what arrives is compared with the chunk's bytes. All other chunks occur once and are encoded where they are.
3. A document is the concatenation of its chunks' tokens, repaired at each join: from the last safe boundary before the join to the
   first one after it the text is encoded again. A safe boundary lies between a character that isn't white space and white space:
   no rule of the vocabulary's pattern looks across it, so both sides' tokens agree there exactly with those of the whole text.
   Within a run of characters of scripts without blanks the join lies inside one piece of the pattern. There tokens on both sides are
   encoded anew, one more each time, until the new ones agree with their neighbours: a sequence of tokens is the encoding of its piece
   exactly if the encoder leaves each pair of neighbours as it is.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.llm.common import flat, n_blocks, packed, pick, table, text_bytes, unpack

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 8 << 20
#: A boundary follows a byte whose window of WINDOW bytes hashes to a value with MASK_BITS zero bits; chunks of up to LONGEST bytes.
WINDOW, MASK_BITS, LONGEST = 32, 9, 1 << 14


class Codec:
    """Byte-level BPE from a file of ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        top = max(self.ranks.values()) + 1
        self.sizes = np.zeros(top, np.int64)
        for b, r in self.ranks.items():
            self.sizes[r] = len(b)
        self.pairs: dict[int, bool] = {}
        self.kind = np.uint16 if top <= 1 << 16 else np.int32

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.enc.encode_ordinary(text), self.kind)

    def decode(self, tokens) -> bytes:
        return self.enc.decode_bytes(tokens)

    def apart(self, a: int, b: int) -> bool:
        """Whether the encoder leaves token b after token a, within a piece, as it is."""
        k = a << 32 | b
        v = self.pairs.get(k)
        if v is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            both = self.enc.decode_single_token_bytes(a) + self.enc.decode_single_token_bytes(b)
            v = self.pairs[k] = both not in self.ranks and self.piece(both) == [a, b]
        return v

    def piece(self, b: bytes) -> list[int]:
        return self.enc._core_bpe.encode_single_piece(b)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)


def cuts(b: bytes, window: int = WINDOW, bits: int = MASK_BITS, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of a text's bytes, at borders of characters."""
    n = len(b)
    if n <= window:
        return [n] if n else []
    a = np.frombuffer(b, np.uint8)
    h = _GEAR[a]
    step = 1
    while step < window:  # the sum over a window, each byte shifted by its age, by doubling
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    at = np.flatnonzero((h[window - 1:-1] >> np.uint64(64 - bits)) == 0) + window
    at = at[(a[at] & 0xC0) != 0x80]
    out, last = [], 0
    for x in [*at.tolist(), n]:
        while x - last > longest:
            last += longest
            while (a[last] & 0xC0) == 0x80:
                last -= 1
            out.append(last)
        if x - last >= window or x == n:
            out.append(x)
            last = x
    return out


_BLANK = frozenset(b"\t\n\x0b\x0c\r ")


def _safe(raw: bytes, i: int) -> bool:
    """Whether ASCII white space stands at byte i, after a character that surely isn't white space."""
    if raw[i] not in _BLANK:
        return False
    p = raw[i - 1]
    if p < 0x80:
        return p > 32
    j = i - 1
    while (raw[j] & 0xC0) == 0x80:
        j -= 1
    return not raw[j:i].decode("utf-8").isspace()


#: Characters that are letters in every version of Unicode and of scripts that set no blanks: kana, the first ideographs, Hangul.
_SOLID = ((0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def solid_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of such characters."""
    b = np.frombuffer(raw + b"\0\0", np.uint8)
    at = np.flatnonzero((b[:-2] >= 0xE3) & (b[:-2] <= 0xED))
    code = ((b[at].astype(np.int64) & 15) << 12) | ((b[at + 1].astype(np.int64) & 63) << 6) | (b[at + 2] & 63)
    ok = np.zeros(len(at), bool)
    for lo, hi in _SOLID:
        ok |= (code >= lo) & (code <= hi)
    at = at[ok]
    new = np.flatnonzero(np.diff(at, prepend=-9) != 3)
    return at[new], (at[np.append(new[1:], len(at)) - 1] + 3) if len(at) else at


#: Tokens on either side of a join that are encoded anew before the join is given to the safe boundaries.
REACH = 16


def _local(c: Codec, raw: bytes, ends: list[int], tokens: list[np.ndarray]):
    """Function of (number of the join, first byte that may change) -> (a, b, tokens of the bytes from a to b) that make the join exact; None where it can't."""
    runs: list = []
    places: dict[int, np.ndarray] = {}

    def place(i: int) -> np.ndarray:
        if i not in places:
            places.clear()
            places[i] = np.concatenate(([0], np.cumsum(c.sizes[tokens[i]]))) + (ends[i - 1] if i else 0)
        return places[i]

    def run(i: int, least: int):
        if not runs:
            runs.extend(solid_runs(raw))
        p = ends[i]
        k = int(np.searchsorted(runs[0], p, side="right")) - 1
        if k < 0 or not runs[0][k] < p < runs[1][k]:
            return None
        lo, hi = max(int(runs[0][k]), least), int(runs[1][k])
        left, right = tokens[i], tokens[i + 1]
        x, y = place(i).copy(), place(i + 1)
        for n in range(REACH + 1):
            u, v = len(left) - 1 - n, n  # the neighbours that stay
            if u < 0 or v >= len(right) or x[u] < lo or y[v + 1] > hi:
                return None
            a, b = int(x[u + 1]), int(y[v])
            mid = c.piece(raw[a:b]) if n else []
            seq = [int(left[u]), *mid, int(right[v])]
            if c.apart(seq[0], seq[1]) and (len(seq) == 2 or c.apart(seq[-2], seq[-1])):
                return a, b, np.array(mid, c.kind)
        return None

    return run


def joins(raw: bytes, ends: list[int], local=None) -> list[tuple]:
    """(a, b, tokens): ranges of bytes whose tokens are others than those of the chunks. Without tokens (None) they are to be encoded again: around a
    join, from the last safe boundary (or the start) to the next (or the end)."""
    out: list[tuple] = []
    n, done = len(raw), 0
    for i, p in enumerate(ends[:-1]):
        if p < done or _safe(raw, p):
            continue
        found = local(i, done) if local is not None else None
        if found is not None:
            if found[1] > found[0]:
                out.append(found)
                done = found[1]
            continue
        while out and out[-1][2] is not None:  # those may lie in the same piece
            out.pop()
        done = out[-1][1] if out else 0
        a = p - 1
        while a > done and not _safe(raw, a):
            a -= 1
        b = p + 1
        while b < n and not _safe(raw, b):
            b += 1
        if out and a <= done:
            out[-1] = (out[-1][0], b, None)
        else:
            out.append((max(a, 0), b, None))
        done = b
    return out


def join_tokens(c: Codec, raw: bytes, ends: list[int], tokens: list[np.ndarray]) -> np.ndarray:
    """The text's tokens from those of its chunks."""
    if not tokens:
        return np.zeros(0, c.kind)
    out, i, pos, start = [], 0, 0, 0
    at = None  # places of the tokens of chunk i
    for a, b, new in [*joins(raw, ends, _local(c, raw, ends, tokens)), (len(raw), len(raw), None)]:
        while pos < a:
            if at is None:
                at = np.concatenate(([0], np.cumsum(c.sizes[tokens[i]])))
            x, y = pos - start, min(a, ends[i]) - start
            out.append(tokens[i][np.searchsorted(at, x):np.searchsorted(at, y)])
            pos = start + y
            if pos == ends[i]:
                start, i, at = ends[i], i + 1, None
        if b > a:
            out.append(c.encode(raw[a:b].decode("utf-8")) if new is None else new)
            pos = b
            while i < len(ends) and ends[i] <= pos:
                start, i, at = ends[i], i + 1, None
    return np.concatenate(out) if out else np.zeros(0, c.kind)


def _chunks(texts: list) -> tuple[list[bytes | None], list[list[int]], list[list[int]]]:
    """Each text's bytes, the ends of its chunks and their hashes."""
    raws = [None if t is None else t.encode("utf-8", "replace") for t in texts]
    ends = [cuts(r) if r else [] for r in raws]
    hashes = [[xxhash.xxh3_64_intdigest(r[a:b]) for a, b in zip([0, *e[:-1]], e)] if r else [] for r, e in zip(raws, ends)]
    return raws, ends, hashes


def _lists(arrays: list[np.ndarray]) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 3)


def encode_documents(docs: DataFrame, text: str, vocabulary: str, block_bytes: int) -> DataFrame:
    """docs (flat columns) with _tokens array<int>."""
    names = docs.columns
    n = n_blocks(text_bytes(docs, text), block_bytes)
    buckets = max(8, n // 4)
    # with the task's number, so that rows that are repeated very often don't meet in one block; a task that is run again has the same
    x = packed(docs, F.pmod(F.xxhash64(*[c for c, k in docs.dtypes if not k.startswith("map")], F.spark_partition_id()), F.lit(n)), max(n // 4, 2))
    kind = codec(vocabulary).kind

    def send(z: pa.Table) -> pa.Table:
        _, _, hashes = _chunks(unpack(z).column(text).to_pylist())
        h = np.unique(np.array([v for own in hashes for v in own], np.uint64))
        b = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
        at = np.flatnonzero(np.diff(b, prepend=-1))
        cut = list(zip(at.tolist(), [*at[1:].tolist(), len(b)]))
        return pa.table({"_b": pa.array(b[at]), "_from": pa.array([z.column("_block")[0].as_py()] * len(at), pa.int32()), "_h": pa.array([h[i:j].tobytes() for i, j in cut], pa.binary())})

    def assign(t: pa.Table) -> pa.Table:
        """For each block: the hashes that it encodes for others, and for each of them how many others and which."""
        parts = [np.frombuffer(v, np.uint64) for v in t.column("_h").to_pylist()]
        h, who = np.concatenate(parts), np.repeat(t.column("_from").to_numpy(), [len(p) for p in parts])
        o = np.lexsort((who, h))
        h, who = h[o], who[o]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        many = np.diff(np.append(first, len(h)))
        first, many = first[many > 1], many[many > 1]
        does = who[first + (h[first] % many.astype(np.uint64)).astype(np.int64)]
        o = np.argsort(does, kind="stable")
        at = np.flatnonzero(np.diff(does[o], prepend=-1))
        rows = []
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(o)]):
            own = o[i:j]
            rows.append((int(does[own[0]]), h[first[own]].tobytes(), (many[own] - 1).astype(np.int32).tobytes(),
                         np.concatenate([np.delete(w, np.flatnonzero(w == does[k])) for k, w in ((k, who[first[k]:first[k] + many[k]]) for k in own)]).astype(np.int32).tobytes()))
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pa.table({"_block": pa.array(cols[0], pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in zip(("_h", "_n", "_to"), cols[1:])}})

    def share(z: pa.Table, jobs: pa.Table) -> pa.Table:
        """Encodes a block's named chunks and addresses them."""
        none = pa.table({"_block": pa.array([], pa.int32()), "_h": pa.array([], pa.binary()), "_n": pa.array([], pa.binary()), "_z": pa.array([], pa.binary())})
        if not z.num_rows or not jobs.num_rows:
            return none
        raws, ends, hashes = _chunks(unpack(z).column(text).to_pylist())
        place = {v: (i, a, b) for i, own in enumerate(hashes) for v, a, b in zip(own, [0, *ends[i][:-1]], ends[i])}
        c = codec(vocabulary)
        h, m, to = (np.frombuffer(b"".join(jobs.column(k).to_pylist()), t) for k, t in (("_h", np.uint64), ("_n", np.int32), ("_to", np.int32)))
        tokens = [c.encode(raws[i][a:b].decode("utf-8")) for i, a, b in map(place.__getitem__, h.tolist())]
        k = np.repeat(np.arange(len(h)), m)
        o = np.argsort(to, kind="stable")
        k, to = k[o], to[o]
        at = np.flatnonzero(np.diff(to, prepend=-1))
        cut = [k[i:j] for i, j in zip(at.tolist(), [*at[1:].tolist(), len(k)])]
        return pa.table({"_block": pa.array(to[at]), "_h": pa.array([h[w].tobytes() for w in cut], pa.binary()), "_n": pa.array([np.array([len(tokens[i]) for i in w], np.int32).tobytes() for w in cut], pa.binary()),
                         "_z": pa.array([_lists([tokens[i] for i in w]) for w in cut], pa.binary())})

    def finish(z: pa.Table, got: pa.Table) -> pa.Table:
        d = unpack(z) if z.num_rows else None
        if d is None:
            return out_schema.empty_table()
        c = codec(vocabulary)
        known: dict[int, np.ndarray] = {}
        for h, m, v in zip(*(got.column(k).to_pylist() for k in ("_h", "_n", "_z"))):
            sizes = np.frombuffer(m, np.int32)
            known.update(zip(np.frombuffer(h, np.uint64).tolist(), np.split(np.frombuffer(zstandard.decompress(v), kind), np.cumsum(sizes)[:-1])))
        fresh = set(known)  # not compared yet
        raws, ends, hashes = _chunks(d.column(text).to_pylist())
        sizes, flat_tokens, null = [], [], []
        for raw, e, own in zip(raws, ends, hashes):
            null.append(raw is None)
            parts = []
            for v, a, b in zip(own, [0, *e[:-1]], e):
                t = known.get(v)
                if t is None or (v in fresh and c.decode(t.tolist()) != raw[a:b]) or c.sizes[t].sum() != b - a:
                    t = c.encode(raw[a:b].decode("utf-8"))
                    if v not in known:
                        known[v] = t
                fresh.discard(v)
                parts.append(t)
            t = join_tokens(c, raw, e, parts) if raw else np.zeros(0, kind)
            if raw and c.decode(t.tolist()) != raw:  # two chunks with one hash
                t = c.encode(raw.decode("utf-8"))
            sizes.append(len(t))
            flat_tokens.append(t)
        values = np.concatenate(flat_tokens).astype(np.int32) if flat_tokens else np.zeros(0, np.int32)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(null))
        return d.select(names).append_column("_tokens", col)

    plan = x.groupBy("_block").applyInArrow(send, "_b int, _from int, _h binary").groupBy("_b").applyInArrow(assign, "_block int, _h binary, _n binary, _to binary")
    tokens = x.groupBy("_block").cogroup(plan.groupBy("_block")).applyInArrow(share, "_block int, _h binary, _n binary, _z binary")
    to = T.StructType([*docs.schema.fields, T.StructField("_tokens", T.ArrayType(T.IntegerType()))])
    out_schema = to_arrow_schema(to)
    return x.groupBy("_block").cogroup(tokens.groupBy("_block")).applyInArrow(finish, to)


def bpe_encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of docs with tokens (array of ids) and n_tokens; a column of docs with such a name is replaced.

    A null text has null tokens and count, an empty one none and 0. Repeated rows are encoded each, texts of any length whole. Strings of
    special tokens are text. Chunks of equal hash and other bytes, and texts whose tokens don't give them back, are encoded where they are.
    """
    d, at = flat(docs)
    out = encode_documents(d, at[text_col], vocabulary, block_bytes)
    keep = [(c, n) for c, n in zip(docs.columns, d.columns) if c.lower() not in ("tokens", "n_tokens")]
    f = out.select(*[F.col(n) for _, n in keep], "_tokens", F.when(F.col("_tokens").isNotNull(), F.size("_tokens")).alias("_n"))
    return f.toDF(*[c for c, _ in keep], "tokens", "n_tokens")


def bpe_decode(df: DataFrame, tokens_col: str = "tokens", to: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of df and the text of its tokens; null for null. Bytes that aren't UTF-8, in cut sequences, become U+FFFD."""
    d, at = flat(df)
    src = at[tokens_col]

    def f(batches):
        c = codec(vocabulary)
        for r in batches:
            col = r.column(src)
            values, at, there = col.values.to_numpy(), col.offsets.to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)
            yield r.append_column("_text", pa.array([c.decode(values[a:b].tolist()).decode("utf-8", "replace") if ok else None for a, b, ok in zip(at[:-1], at[1:], there)], pa.string()))

    return d.mapInArrow(f, T.StructType([*d.schema.fields, T.StructField("_text", T.StringType())])).toDF(*df.columns, to)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, and whether decoding them gives its text back."""
    d = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    e = bpe_decode(bpe_encode(d))
    return e.select("doc_id", "n_tokens", "tokens", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


QUERIES = {"op6_bpe": op6_bpe}
