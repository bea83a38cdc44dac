"""Operator 5, token counts: prefix dynamic programming gives the exact token count of every prefix of a text.

A text falls into units, each white space and what follows it up to the next white space; a prefix's tokens are those of its whole
units and those of the beginning of the unit that it cuts. Within a unit, the last token of each prefix's encoding is found from
shorter prefixes' last tokens: it is the one token that ends there and that the encoder leaves apart from the last token before it.
Units' counts are remembered, so that a text costs little more than looking its units up. The counts are kept as differences from
character to character, compressed; truncation and budget questions read them and encode nothing.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import PATTERN, VOCABULARY, codec
from weftline.llm.common import flat, pick, table

#: Token budgets and numbers of characters that the query answers for.
BUDGETS, CUTS = (128, 512, 2048), (1000, 4000)
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_SPLIT = regex.compile(PATTERN)
#: The usual unit: letters, perhaps with one blank or line end before and marks behind.
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\Z").match
#: Units and beginnings of pieces remembered by a worker, and the most bytes of a piece whose beginnings are remembered.
REMEMBERED, BEGINNINGS, LONG = 1_000_000, 2_000_000, 64
#: Units of a text that are counted at once; between two such groups what is remembered may be dropped, however long a text is.
AT_ONCE = 100_000


class Prefixes(dict):
    """Unit -> number in the flat arrays of what each of its characters adds to the count."""

    def __init__(self, path: str):
        self.c = codec(path)
        self.longest = int(self.c.sizes.max())
        self.bytes = {t: b for b, t in self.c.ranks.items()}
        self.lengths = self.c.sizes.tolist()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}  # counts of short pieces by characters
        self.state: dict[bytes, int] = {b"": 0}  # beginning of a piece -> last token * 256 + number of tokens
        self.clear()

    def clear(self):
        super().clear()
        self.flat, self.starts, self.sizes = array("h"), array("q"), array("q")

    def apart(self, a: int, b: int) -> bool:
        """Whether the encoder leaves token b after token a as it is."""
        k = a << 20 | b
        v = self.pairs.get(k)
        if v is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            both = self.bytes[a] + self.bytes[b]
            v = self.pairs[k] = both not in self.c.ranks and self.c.enc._core_bpe.encode_single_piece(both) == [a, b]
        return v

    def piece(self, b: bytes):
        """Token counts of the prefixes of 1, 2, ... bytes of one piece that merges don't leave. Short pieces share what their beginnings have in common."""
        n = len(b)
        if n > LONG:
            return self._long(b)
        state, ranks, sizes, pairs = self.state, self.c.ranks, self.lengths, self.pairs
        i = n
        while b[:i] not in state:
            i -= 1
        for i in range(i + 1, n + 1):
            p = b[:i]
            t = ranks.get(p)
            if t is not None:
                state[p] = t << 8 | 1
                continue
            # one token can be the last; mostly it is the prefix's last one with the new byte, or that byte alone
            j = i - 1 - sizes[state[b[:i - 1]] >> 8]
            for j in (j, i - 1, *range(1, i - 1)) if j else (i - 1, *range(1, i - 1)):
                t = ranks.get(b[j:i])
                if t is not None:
                    s = state[b[:j]]
                    k = s >> 8 << 20 | t
                    if pairs[k] if k in pairs else self.apart(s >> 8, t):
                        state[p] = t << 8 | (s & 255) + 1
                        break
        return [state[b[:i]] & 255 for i in range(1, n + 1)]

    def _long(self, b: bytes) -> list[int]:
        ranks, last, count = self.c.ranks, [-1], [0]
        for i in range(1, len(b) + 1):
            for j in range(max(0, i - self.longest), i):
                t = ranks.get(b[j:i])
                if t is not None and (j == 0 or self.apart(last[j], t)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
        return count[1:]

    def counts(self, unit: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters of a unit."""
        m = _PLAIN(unit)
        if m:
            space, word, ends = m.groups()
            out = [1] if space == "\n" else []
            out += [len(out) + v for v in self._chars(" " + word if space == " " else word)]
            if ends:
                out += [out[-1] + v for v in self.piece(ends.encode())]
            return out
        out: list[int] = []
        body = len(unit) - len(unit.lstrip(_STRIP))
        space, rest = unit[:body], unit[body:]
        if space:  # a prefix that ends in white space has it as one piece
            out += self._chars(space)
        if not rest:
            return out
        base, start = 0, body
        if body and space[-1] == " ":
            start = body - 1  # the last blank goes with what follows
            base = self._chars(space[:-1])[-1] if body > 1 else 0
        elif body:
            base = (self._chars(space[:-1])[-1] if body > 1 else 0) + self._chars(space[-1])[-1]
        for m in _SPLIT.finditer(unit, start):
            p = m[0]
            own = self._chars(p)
            if m.start() < body:
                skip = body - m.start()
            else:
                skip = 0
            if p in ("'ll", "'ve", "'re"):  # a cut contraction isn't one
                out += [base + own[0], base + self._chars("'")[-1] + self._chars(p[1])[-1], base + own[2]]
            else:
                out += [base + v for v in own[skip:]]
            base += own[-1]
        return out

    def _chars(self, s: str):
        found = self.words.get(s)
        if found is not None:
            return found
        b = s.encode("utf-8", "replace")
        n = self.piece(b)
        if len(b) > LONG:
            return n if len(b) == len(s) else [n[i - 1] for i in np.flatnonzero((np.frombuffer(b + b"a", np.uint8) & 0xC0) != 0x80)[1:].tolist()]
        if len(b) != len(s):
            n = [v for v, c in zip(n, b[1:] + b"a") if c & 0xC0 != 0x80]
        self.words[s] = n
        return n

    def __missing__(self, unit: str) -> int:
        n = self.counts(unit)
        if not unit.isascii() and max(unit) > "\u02ff" and n[-1] != len(self.c.enc.encode_ordinary(unit)):  # the two pattern engines know different characters
            n = [len(self.c.enc.encode_ordinary(unit[:i])) for i in range(1, len(unit) + 1)]
        self.starts.append(len(self.flat))
        self.sizes.append(len(n))
        self.flat.extend([a - b for a, b in zip(n, (0, *n))])
        k = self[unit] = len(self.starts) - 1
        return k

    def steps(self, text: str) -> np.ndarray:
        """What each character adds to the token count of the prefix that ends with it."""
        found, out = _UNIT.finditer(text), []
        while units := [m[0] for m in itertools.islice(found, AT_ONCE)]:
            if len(self.starts) > REMEMBERED:
                self.clear()
            if len(self.state) > BEGINNINGS:
                self.state = {b"": 0}
                self.words.clear()
            k = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
            size = np.frombuffer(self.sizes, np.int64)[k]
            ends = np.cumsum(size)
            out.append(np.frombuffer(self.flat, np.int16)[np.repeat(np.frombuffer(self.starts, np.int64)[k] - (ends - size), size) + np.arange(ends[-1])])
        return np.concatenate(out) if out else np.zeros(0, np.int16)


_STRIP = "".join(chr(i) for i in range(0x3001) if re.match(f"[{SPACE}]", chr(i)))


@functools.cache
def prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def pack_steps(steps: np.ndarray) -> bytes:
    return zstandard.compress(steps.astype(np.int16).view(np.uint8).reshape(-1, 2).T.tobytes(), 3)


def unpack_counts(z: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters."""
    b = np.frombuffer(zstandard.decompress(z), np.uint8)
    return np.concatenate(([0], np.cumsum(np.ascontiguousarray(b.reshape(2, -1).T).view(np.int16).ravel(), dtype=np.int64)))


def fits(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens; counts can fall from one prefix to the next."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, budgets=BUDGETS, cuts=CUTS) -> DataFrame:
    """doc_id, n_chars, n_tokens, chars_in_<b> (longest prefix of at most b tokens), tokens_at_<c> (tokens of the first c characters, or
    of all) and prefix_counts (packed counts of every prefix, for unpack_counts, chars_in and tokens_at) for every row.

    A null text has nulls, an empty one zeros. Repeated rows are counted each. Very long texts are counted whole, group by group of
    AT_ONCE units. Of prefixes with equally many tokens the longest answers for a budget. Other columns of docs don't matter.
    """
    def f(batches):
        p = prefixes(vocabulary)
        for r in batches:
            rows = []
            for t in r.column("_text").to_pylist():
                if t is None:
                    rows.append((None,) * (3 + len(budgets) + len(cuts)))
                    continue
                s = p.steps(t)
                n = np.concatenate(([0], np.cumsum(s, dtype=np.int64)))
                rows.append((len(t), int(n[-1]), *[fits(n, b) for b in budgets], *[int(n[min(c, len(t))]) for c in cuts], pack_steps(s)))
            cols = list(zip(*rows)) or [()] * (3 + len(budgets) + len(cuts))
            yield pa.RecordBatch.from_arrays([r.column("_id"), *[pa.array(c, pa.int32()) for c in cols[:-1]], pa.array(cols[-1], pa.binary())], names=names)

    names = ["doc_id", "n_chars", "n_tokens", *[f"chars_in_{b}" for b in budgets], *[f"tokens_at_{c}" for c in cuts], "prefix_counts"]
    d = pick(docs, _id=id_col, _text=text_col)
    return d.mapInArrow(f, f"doc_id {d.schema['_id'].dataType.simpleString()}, " + ", ".join(f"{c} int" for c in names[1:-1]) + ", prefix_counts binary")


def answers(df: DataFrame, counts_col: str, number: str | int, kind: str, to: str) -> DataFrame:
    """df with a column of answers from packed counts: kind chars_in (number: a token budget) or tokens_at (number: characters).

    number is a column's name or an integer. Null counts or numbers give null; numbers under 0 count as 0. A column of the very name `to`
    is replaced; one that differs only in case stays.
    """
    if kind not in ("chars_in", "tokens_at"):
        raise ValueError(kind)

    @F.pandas_udf("int")
    def ask(z, n):
        import pandas as pd

        out = []
        for v, k in zip(z, n):
            if v is None or pd.isna(k):
                out.append(None)
                continue
            c, k = unpack_counts(v), max(int(k), 0)
            out.append(fits(c, k) if kind == "chars_in" else int(c[min(k, len(c) - 1)]))
        return pd.Series(out, dtype="Int32")

    d, at = flat(df)
    keep = [(c, n) for c, n in zip(df.columns, d.columns) if c != to]
    return d.select(*[F.col(n) for _, n in keep], ask(F.col(at[counts_col]), F.col(at[number]) if isinstance(number, str) else F.lit(number)).alias("_to")).toDF(*[c for c, _ in keep], to)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op5_token_counts": op5_token_counts}
