"""The pipeline's stages against what each must do with a small table, and run() against the stages' brute-force versions."""

import random
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from weftline.llm import common
from weftline.llm.bpe import VOCABULARY, codec
from weftline.llm.pii import redact

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    rng = random.Random(11)
    syl = ["ba", "rin", "to", "mel", "ku", "sa", "dor", "vi", "lan", "pe"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(40) for _ in range(3)]
    docs = [(i + 1000, text(rng.randrange(60, 160))) for i in range(400)]
    docs += [(9100, docs[0][1]), (9101, docs[1][1] + " ba"), (9102, docs[1][1].replace(" ", "  "))]
    docs += [(200, text(50) + " " + items[0] + " " + text(50)), *[(300 + i, text(60) + f" write to {word()}@mail.example.org now " + text(60)) for i in range(40)]]
    docs += [(400, ""), (401, None), (500, "".join(chr(33 + rng.randrange(90)) for _ in range(800)))]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(docs)


def grams(t):
    w = t.lower().split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}


def test_run(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    first = P.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    kept = {r.doc_id for r in first.collect()}
    assert {400, 401, 500}.isdisjoint(kept) and len(kept & set(range(1000, 1400))) > 380 and {200, 300, 1000, 1001, 9100, 9101} <= kept
    ids = sorted(kept)
    root = {i: i for i in ids}
    g = {i: grams(docs[i]) for i in ids}
    for i in ids:
        for j in ids:
            a, b = g[i], g[j]
            if i < j and len(a & b) / len(a | b) >= 0.5:
                x, y = sorted((root[i], root[j]))
                root = {k: x if v == y else v for k, v in root.items()}
    want = {i for i in ids if root[i] == i} - {200}
    assert set(got) == want and not {9100, 9101, 9102} & want
    enc = codec(VOCABULARY).enc
    for i, r in got.items():
        assert r.text == redact(docs[i]) and r.tokens == enc.encode_ordinary(r.text) and r.n_tokens == len(r.tokens)
    assert "[EMAIL]" in got[300].text and got[300].n_chars == len(got[300].text)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path))
    empty = spark.createDataFrame([], DOCS)
    for name, f in P.STAGES:
        out = f(spark, empty, str(tmp_path))
        assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Repeated rows, nulls in every column, a very long text and columns of clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "rin", "to", "mel", "ku", "sa"]) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, twice, long = text(30), text(90), text(80_000)
    rows = [(i, text(100), "en", "s", 1) for i in range(120)] + [(500, twice, "en", "s", 2)] * 3 + [(501, twice, "en", "s", 2), (600, long, "en", None, None), (None, text(100), "en", "s", 3), (None, None, None, None, None), (700, text(100), None, None, None),
                                                                                           (800, text(40) + " " + item, "en", "s", 1), (801, "  ", "en", "s", 2)]
    schema = DOCS + ", _text string, _id int, tokens string, _k long, _block int, _c0 int, key string"
    spark.createDataFrame([(*r, "x", 1, "t", 5, 7, 9, "k") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    assert [c for c in out.columns if c not in ("tokens", "n_tokens")] == ["doc_id", "text", "lang", "source", "n_chars", "_text", "_id", "_k", "_block", "_c0", "key"]
    got = out.select("doc_id", "text", "n_tokens", "tokens", "_k").collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert ids.count(500) == 3 and not {501, 800, 801} & set(ids) and len(set(ids) & set(range(120))) >= 110
    assert sum(r.doc_id is None for r in got) == 1  # of the rows without an id, the one with a text
    enc = codec(VOCABULARY).enc
    assert all(r._k == 5 and r.n_tokens == len(enc.encode_ordinary(r.text)) for r in got)


def python_steps(plan):
    """The most steps that run in Python workers one after the other within a stage of a physical plan."""
    kids = lambda n: [n.children().apply(i) for i in range(n.children().size())]

    def walk(n):
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(n.initialPlan())
        below = [walk(x) for x in kids(n)]
        most, own = max([0, *(m for m, _ in below)]), max([0, *(o for _, o in below)])
        own += any(x in name for x in ("InArrow", "InPandas", "EvalPython"))
        return max(most, own), 0 if "Exchange" in name else own

    return walk(plan)[0]


def test_one_python_step_a_stage(spark, tmp_path, monkeypatch):
    """Two steps in a stage hold two workers a core, which stay and count against an executor's memory in all later stages."""
    tables(spark, str(tmp_path))
    steps = {}

    def noting(df, name):
        steps[name] = max(steps.get(name, 0), python_steps(df._jdf.queryExecution().executedPlan()))
        return real(df, name)

    real = common.written
    for m in [m for n, m in sys.modules.items() if n.startswith("weftline.llm.") or n == "corpus_pipeline"]:
        if getattr(m, "written", None) is real:
            monkeypatch.setattr(m, "written", noting)
    P.run(spark, str(tmp_path))
    assert {"sketches", "copies", "links", "groups", *(f"stage-{name}" for name, _ in P.STAGES)} <= set(steps)
    assert max(steps.values()) == 1, steps


def test_packing_holds_little_more_than_its_rows(spark, monkeypatch):
    """The worker's function itself, over more than one round: every row once under its block, in small batches, without copies of all that is held."""

    class Kept:
        columns = ["_id", "_text"]
        withColumn = repartition = lambda self, *_: self

        def mapInArrow(self, f, _):
            self.f = f
            return self

    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(97, 123, 4000, np.uint8).tobytes().decode()) for i in range(10_000)]
    rows = rows[:1000] + rows  # repeated within what is packed at once
    block = [i % 37 for i, _ in rows]

    def batches():
        for a in range(0, len(rows), 2000):
            part = rows[a:a + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part]), pa.array(block[a:a + 2000], pa.int32())], names=["_id", "_text", "_block"])

    for once, many in (((), 11_000), (("_id",), 10_000)):
        f, before, out, held = common.packed(Kept(), F.lit(0), 2, once).f, pa.total_allocated_bytes(), [], [0]

        def seen(*args, real=pa.ipc.new_stream, **kw):
            held.append(pa.total_allocated_bytes() - before - sum(x.nbytes for x in out))
            return real(*args, **kw)

        with monkeypatch.context() as m:
            m.setattr(pa.ipc, "new_stream", seen)
            for r in f(batches()):
                out.append(r)
        t = pa.Table.from_batches(out)
        got = []
        for b in range(37):
            own = common.unpack(t.filter(pa.array(t.column("_block").to_numpy() == b)))
            got += [(b, *x.values()) for x in own.to_pylist()]
        assert len(got) == many and set(got) == {(b, *r) for b, r in zip(block, rows)}
        assert max(held) < 1.8 * common.PACK and max(r.nbytes for r in out) < 4 << 20, (once, max(held))
