"""Which documents are copies or near copies of each other, by MinHash: a few bytes a document, no text and no gram is shuffled.

A document's word 3-grams are hashed once; the least hash in each of BINS equal ranges of the hash's values makes its sketch (an empty
range takes the next one's, marked by the distance). The share of equal places estimates two documents' Jaccard. BANDS bands of the
sketch find candidates: each document of a band meets the band's least one only, and is linked with it where the sketches agree in half
their places. Links connect groups. This serves models that are not to learn from copies; operator 7 finds pairs exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import mix, written
from weftline.llm.jaccard_join import _lower, components, gram_sets

BINS, BANDS = 32, 8
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
_PLACES = np.arange(BINS)


def sketch(grams: np.ndarray) -> np.ndarray:
    """BINS values of a set of 64-bit hashes that isn't empty."""
    v = np.sort(mix(grams ^ np.uint64(0xC2B2AE3D27D4EB4F)))
    at = np.append(np.searchsorted(v, _EDGES), len(v))
    full = np.flatnonzero(at[1:] > at[:-1])
    near = full[np.searchsorted(full, _PLACES) % len(full)]
    return mix(v[at[near]] + ((near - _PLACES) % BINS).astype(np.uint64))


#: Rows whose grams are held at once; bounds a worker's memory.
ROWS = 512


def _rows(batches):
    for r in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        own, rows = [], []
        for i, g in enumerate(gram_sets(_lower(r.column("_text")), 3)):
            if len(g):
                own.append(i)
                rows.append(sketch(g))
        if not own:
            continue
        s = np.array(rows)
        lang = r.column("_lk").to_numpy()[own].view(np.uint64)
        band = np.zeros((len(s), BANDS), np.uint64) + lang[:, None] + np.arange(BANDS, dtype=np.uint64)
        for j in range(BINS // BANDS):
            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + s[:, j * BANDS:(j + 1) * BANDS])
        take = pa.array(own)
        yield pa.RecordBatch.from_arrays([
            r.column("_k").take(take), r.column("_h").take(take), pa.array([x.tobytes() for x in s.astype(np.uint8)], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).ravel()))], names=["_k", "_h", "_s", "_bands"])


def _alike(batches):
    for r in batches:
        if r.num_rows:
            x, y = (np.frombuffer(b"".join(r.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("_s", "_t"))
            yield r.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= BINS // 2))


def near_groups(docs: DataFrame) -> DataFrame:
    """docs: _k (a row's key), _h, _lk (key of what groups don't cross), _text. Returns _k, _h, _first: the group's least _k, for rows of groups of two or more."""
    k = written(docs.select("_k", "_h", "_lk", "_text").mapInArrow(_rows, "_k long, _h long, _s binary, _bands array<long>"), "sketches")
    b = k.select("_k", F.explode("_bands").alias("_band"))
    low = b.groupBy("_band").agg(F.min("_k").alias("_to"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    met = b.join(low, "_band").filter("_k <> _to").select(F.col("_k").alias("a"), F.col("_to").alias("b")).distinct()
    one = k.groupBy("_k").agg(F.first("_h").alias("_h"), F.first("_s").alias("_s"))
    pairs = met.join(one.select(F.col("_k").alias("a"), "_s"), "a").join(one.select(F.col("_k").alias("b"), F.col("_s").alias("_t")), "b")
    comp = components(pairs.select("a", "b", "_s", "_t"), "copies", _alike)
    return comp.toDF("_k", "_first").join(k.select("_k", "_h").distinct(), "_k")
