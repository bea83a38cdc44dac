import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from weftline.llm.ppm import ppm_score

SCHEMA = "doc_id long, text string, block string, bits string, DOC_ID string"


def brute(rows, order):
    """Plain trie with explicit exclusion sets; folds as the operator hashes them."""
    trie = {0: defaultdict(Counter), 1: defaultdict(Counter)}
    for _, text, fold in rows:
        t = b"\0" * order + (text or "").encode()
        for i in range(order, len(t)):
            for k in range(order + 1):
                trie[fold][t[i - k:i]][t[i]] += 1
    out = {}
    for doc, text, fold in rows:
        if text is None:
            out[doc] = None
            continue
        model, bits, t = trie[1 - fold], 0.0, b"\0" * order + text.encode()
        for i in range(order, len(t)):
            gone = set()
            for k in range(order, -1, -1):
                node = model.get(t[i - k:i])
                if node is None:
                    continue
                live = {s: c for s, c in node.items() if s not in gone}
                total, kinds = sum(live.values()), len(live)
                if t[i] in live:
                    bits -= math.log2(live[t[i]] / (total + kinds))
                    break
                if kinds:
                    bits -= math.log2(kinds / (total + kinds))
                gone |= set(live)
            else:
                bits += math.log2(256 - len(gone))
        out[doc] = bits
    return out


TEXTS = ["abracadabra abracadabra", "abra cadabra, abraham", "", None, "ñandú und Äpfel", "x" * 50, "the cat sat on the mat " * 20,
         "the cat sat on the mat", "zzz\0zzz", "abracadabra abracadabra"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "b", None, "x") for i, t in enumerate(texts)], SCHEMA)


def test_matches_brute_force(spark):
    df = frame(spark, TEXTS)
    h = F.xxhash64(F.col("id"), F.col("text"))
    fold = {r[0]: r[1] for r in df.toDF("id", "text", "a", "b", "c").select("id", F.pmod(h, F.lit(2))).collect()}
    for order in (2, 4):
        want = brute([(i, t, fold[i]) for i, t in enumerate(TEXTS)], order)
        got = {r.doc_id: r for r in ppm_score(df, order=order, block_bytes=100).collect()}
        assert len(got) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            if t is None:
                assert got[i].bits is None and got[i].n_bytes is None
            else:
                assert math.isclose(got[i].bits, want[i], abs_tol=0.01), (i, order)
                assert (got[i].bits_per_byte is None) == (t == "")


def test_merging_lists_changes_nothing(spark):
    import random

    rng = random.Random(3)
    df = frame(spark, [" ".join(rng.choice(["abra", "cadabra", "the", "cat", "mat", "ñandú"]) for _ in range(20)) for _ in range(60)])
    want = {r.doc_id: r.bits for r in ppm_score(df).collect()}
    one = {r.doc_id: r.bits for r in ppm_score(df, block_bytes=300).collect()}
    tree = {r.doc_id: r.bits for r in ppm_score(df, block_bytes=300, fan=3).collect()}
    assert one == tree and all(math.isclose(want[i], one[i], abs_tol=0.01) for i in want)


def test_empty_single_and_repeated(spark):
    assert ppm_score(frame(spark, [])).count() == 0
    assert ppm_score(frame(spark, ["abc"])).first().bits == 24.0
    df = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "abc")], "doc_id long, text string")
    assert ppm_score(df).count() == 3


def test_long_text_is_cut_without_effect(spark):
    import weftline.llm.common as c

    texts = ["hello world, " * 60_000, "abc" * 2000, "hello world " * 100, "wide world of hellos " * 30_000, "ab" * 3000]
    assert sum(len(t) > c.PIECE for t in texts) == 2
    df = frame(spark, texts)
    fold = {r[0]: r[1] for r in df.toDF("id", "text", "a", "b", "c").select("id", F.pmod(F.xxhash64("id", "text"), F.lit(2))).collect()}
    assert len(set(fold.values())) == 2
    want = brute([(i, t, fold[i]) for i, t in enumerate(texts)], 4)
    for r in ppm_score(df).collect():
        assert math.isclose(r.bits, want[r.doc_id], rel_tol=1e-5)
    assert [len(g) for g in c.pieces([b"x" * 10, b"y" * 3, b""], 2, 4)] == [1, 1, 1, 1]
    assert b"".join(p for g in c.pieces([b"abcdefghij"], 2, 4) for _, _, p in g) == b"abcdefghij"
    long = [b"mississippi river " * 50, b"miss", b"x" * 100]
    for cut in (1, 5, 64, 1 << 20):
        keys = [[] for _ in long]
        for group in c.pieces(long, 4, cut):
            g, own, size = c.byte_grams(group, 4)
            for i, part in zip(own, c.np.split(g, c.np.cumsum(size)[:-1])):
                keys[i] += part.tolist()
        assert cut == 1 or keys == first
        first = keys
