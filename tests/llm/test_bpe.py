import random

import pytest

from weftline.llm import bpe as B
from weftline.llm import token_counts as C

SCHEMA = "doc_id long, text string, lang string, Tokens string, N_TOKENS int"


def texts(seed=4, n=120):
    rng = random.Random(seed)
    parts = ["the ", "tion", " and", "é", "日本", "　", "\n\n", "\t", "  ", "'ll", "'s", "don't", "1234", "!!!", "\x1c", "🙂", "\xa0", "x" * 40]
    shared = "".join(rng.choice(parts) for _ in range(300))
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 200))) for _ in range(n)]
    return out + [a[:50] + shared + b[:70] for a, b in zip(out[:20], out[20:40])] + ["", " ", "a", "x" * 30_000, "word " * 20_000]


@pytest.mark.parametrize("window, bits, longest", [(4, 2, 20), (8, 3, 60), (32, 9, 1 << 14)])
def test_joins_agree_exactly(window, bits, longest):
    c = B.codec(B.VOCABULARY)
    for t in texts():
        raw = t.encode()
        e = B.cuts(raw, window, bits, longest)
        assert (e[-1] if e else 0) == len(raw) and all(a < b for a, b in zip([0, *e], e))
        parts = [c.encode(raw[a:b].decode()) for a, b in zip([0, *e[:-1]], e)]
        assert B.join_tokens(c, raw, e, parts).tolist() == c.enc.encode_ordinary(t)


@pytest.mark.parametrize("window, bits, longest", [(4, 2, 20), (8, 5, 200), (32, 9, 1 << 14)])
def test_scripts_without_blanks(window, bits, longest):
    c, rng = B.codec(B.VOCABULARY), random.Random(6)
    kinds = ["".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x4E00, 0x4E60))) * 3 + "的一是了我不人在", "".join(map(chr, range(0xAC00, 0xAC40))), "abcXYZ", "12", " \n", "。、'ls", "ー々\u4dc0é"]
    for k in range(60):
        weights = [6, 20, 6, *([0.05 * (k % 3)] * 5)]
        t = "".join(rng.choice(rng.choices(kinds, weights)[0]) for _ in range(rng.choice([50, 500, 4000])))
        raw = t.encode()
        e = B.cuts(raw, window, bits, longest)
        parts = [c.encode(raw[a:b].decode()) for a, b in zip([0, *e[:-1]], e)]
        assert B.join_tokens(c, raw, e, parts).tolist() == c.enc.encode_ordinary(t)
    t = "".join(rng.choice(kinds[1]) for _ in range(60_000))
    raw = t.encode()
    e = B.cuts(raw)
    parts = [c.encode(raw[a:b].decode()) for a, b in zip([0, *e[:-1]], e)]
    again = sum(b - a for a, b, _ in B.joins(raw, e, B._local(c, raw, e, parts)))
    assert len(e) > 100 and again < 0.1 * len(raw) and B.join_tokens(c, raw, e, parts).tolist() == c.enc.encode_ordinary(t)


@pytest.mark.parametrize("block", [3_000, 1 << 25])
def test_encode_equals_direct_encoding(spark, block):
    rows = [(i, t, "en", "kept?", 7) for i, t in enumerate(texts())] + [(900, None, None, None, None), (0, texts()[0], "en", "again", 1)]
    out = B.bpe_decode(B.bpe_encode(spark.createDataFrame(rows, SCHEMA), block_bytes=block)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "lang", "tokens", "n_tokens", "decoded"}
    enc = B.codec(B.VOCABULARY).enc
    for r in out:
        if r.text is None:
            assert r.tokens is None and r.n_tokens is None and r.decoded is None
        else:
            assert r.tokens == enc.encode_ordinary(r.text) and r.n_tokens == len(r.tokens) and r.decoded == r.text


def test_empty_table(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert B.bpe_encode(d).count() == 0 and C.token_counts(d).count() == 0


def test_every_prefix(spark):
    enc = B.codec(B.VOCABULARY).enc
    own = [t[:150] for t in texts(9, 40)] + [None, ""]
    got = {r.doc_id: r for r in C.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id int, text string"), budgets=(5, 20), cuts=(7,)).collect()}
    for i, t in enumerate(own):
        if t is None:
            assert got[i].n_tokens is None and got[i].prefix_counts is None
            continue
        want = [len(enc.encode_ordinary(t[:k])) for k in range(len(t) + 1)]
        assert C.unpack_counts(got[i].prefix_counts).tolist() == want
        assert got[i].n_tokens == want[-1] and got[i].n_chars == len(t) and got[i].tokens_at_7 == want[min(7, len(t))]
        assert got[i].chars_in_5 == max(k for k, n in enumerate(want) if n <= 5)


def test_long_piece_prefixes():
    p = C.prefixes(B.VOCABULARY)
    t = "ab" * 400 + "日本語" * 50
    n = p.steps(t).cumsum()
    assert all(n[k - 1] == len(p.c.enc.encode_ordinary(t[:k])) for k in (1, 63, 64, 65, 799, 800, 801, len(t)))


def test_answers(spark):
    d = C.token_counts(spark.createDataFrame([(1, "one two three four", 2), (2, None, 2), (3, "x", None)], "doc_id int, text string, k int").select("doc_id", "text"))
    d = d.join(spark.createDataFrame([(1, 2), (2, 2), (3, None)], "doc_id int, k int"), "doc_id")
    r = {x.doc_id: (x.a, x.b) for x in C.answers(C.answers(d, "prefix_counts", "k", "chars_in", "a"), "prefix_counts", 7, "tokens_at", "b").collect()}
    assert r == {1: (7, 2), 2: (None, None), 3: (None, 1)}
