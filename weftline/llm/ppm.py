"""Operator 1, language-model scoring: prediction by partial matching over a byte-context trie.

The trie of byte contexts up to ORDER bytes is counted over all documents. Each document is scored with the trie of the other
half of the corpus (two folds by hash of id and text), so that a row never predicts itself; copies under other ids may. Escape estimation is method C: a context seen T
times with q distinct next bytes gives c/(T+q) to a byte seen c times and q/(T+q) to the escape. On escape, bytes that the longer
context offered are excluded from T and q of the shorter one; below order 0 the bytes not yet excluded are equally likely.
Since a byte's code length depends on its last ORDER bytes alone, it is worked out once for each distinct gram (gram_exchange).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import count_sorted, find, pick, table, unpack
from weftline.llm.gram_exchange import BLOCK_BYTES, FAN, Low, exchange, score

ORDER = 4


def _summarize(g: np.ndarray, c: np.ndarray):
    yield 0, *count_sorted(g & 0xFFFF, c)


def ppm_bits(order: int):
    """Cost function for gram_exchange: code length in bits of each query gram's last byte."""

    def f(q: np.ndarray, mg: np.ndarray, mc: np.ndarray, low: Low) -> np.ndarray:
        keys, cnts = {}, {}
        for k in range(order, 1, -1):
            keys[k], cnts[k] = count_sorted(mg & ((1 << 8 * (k + 1)) - 1), mc)
        keys[1] = np.flatnonzero(low.pair)
        cnts[1] = low.pair[keys[1]]
        keys[0], cnts[0] = count_sorted(keys[1] & 0xFF, cnts[1])
        node, total, kinds, shut = {}, {}, {}, {}
        for k in range(order, -1, -1):
            node[k], total[k] = count_sorted(keys[k] >> 8, cnts[k])
            kinds[k] = count_sorted(keys[k] >> 8)[1]
            if k:  # mass that this node's bytes have in its suffix
                at, _ = find(_low_keys(keys, k), keys[k] & ((1 << 8 * k) - 1))
                shut[k] = count_sorted(keys[k] >> 8, _low_counts(cnts, k)[at])[1] if len(keys[k]) else np.zeros(0, np.int64)
        bits = np.zeros(len(q))
        alive = np.arange(len(q))
        gone_mass, gone_kinds = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for k in range(order, -1, -1):
            key = q[alive] & ((1 << 8 * (k + 1)) - 1)
            at, seen = find(node[k], key >> 8)
            if not len(node[k]):
                continue
            t = np.where(seen, total[k][at] - gone_mass[alive], 0)
            n = np.where(seen, kinds[k][at] - gone_kinds[alive], 0)
            ka, hit = find(keys[k], key)
            hit &= seen
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(hit, -np.log2(cnts[k][ka] / (t + n)), np.where(n > 0, -np.log2(n / (t + n)), 0.0))
            bits[alive] += np.where(seen, cost, 0.0)
            gone_mass[alive] = np.where(seen, shut[k][at], 0) if k else 0
            gone_kinds[alive] = np.where(seen, kinds[k][at], 0)
            alive = alive[~hit]
        bits[alive] += np.log2(np.maximum(256 - gone_kinds[alive], 1))
        return bits

    return f


def _low_keys(keys, k):
    return keys[k - 1]


def _low_counts(cnts, k):
    return cnts[k - 1]


def ppm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, bits, bits_per_byte for every row.

    A null text has null figures; an empty one 0 bytes, 0 bits and a null rate. Repeated rows are scored each; texts of any length are
    scored whole; other columns don't matter. A document whose other
    fold is empty (a table of one document) costs 8 bits a byte. Texts start in a context of zero bytes. order: 2 to 6.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    x, c, *_ = exchange(pick(docs, _id=id_col, _text=text_col), None, order, _summarize, ppm_bits(order), block_bytes, fan=fan)
    run = score(order)

    def rate(z: pa.Table, costs: pa.Table) -> pa.Table:
        d = unpack(z)
        size, bits = run(z.column("_block")[0].as_py(), d, costs)
        null = d.column("_text").is_null().to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            per = bits / size
        return pa.table({"doc_id": d.column("_id"), "n_bytes": pa.array(size, mask=null), "bits": pa.array(np.round(bits, 4), mask=null), "bits_per_byte": pa.array(np.round(per, 6), mask=null | (size == 0))})

    kind = docs.schema[id_col].dataType.simpleString()
    return x.groupBy("_block").cogroup(c.groupBy("_block")).applyInArrow(rate, f"doc_id {kind}, n_bytes long, bits double, bits_per_byte double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score(table(spark, sf_dir, "documents"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
