import random

import pytest

from weftline.llm import html_runs as H

SCHEMA = "page_id long, url string, html string, HTML int"


def brute(rows, depth):
    hosts, out = {}, {}
    for i, u, h in rows:
        hosts.setdefault(u, []).append((i, H.page_text(h).split(" ") if H.page_text(h) else []))
    for pages in hosts.values():
        where = {}
        for _, w in pages:
            for k in range(len(w) - depth + 1):
                where.setdefault(tuple(w[k:k + depth]), set()).add(tuple(w))
        for i, w in pages:
            gone = set()
            for k in range(len(w) - depth + 1):
                if len(where[tuple(w[k:k + depth])]) > 1:
                    gone |= set(range(k, k + depth))
            runs, run = [], []
            for k, x in enumerate([*w, None]):
                if x is None or k in gone:
                    runs += [" ".join(run)] if run else []
                    run = []
                else:
                    run.append(x)
            out[i] = "\n".join(runs)
    return out


@pytest.mark.parametrize("depth, block", [(5, 1 << 20), (5, 1200), (1, 3000), (8, 1500)])
def test_equals_brute_force(spark, depth, block):
    rng = random.Random(depth)
    boiler = [" ".join(rng.choice("abcdefgh") for _ in range(14)) for _ in range(3)]
    rows = [(i, f"h{rng.randrange(3)}", "<p>" + " ".join(rng.choice([f"w{rng.randrange(40)}", rng.choice(boiler)]) for _ in range(rng.randrange(0, 30))) + "</p>") for i in range(100)]
    rows += [(200, rows[0][1], rows[0][2]), (201, "h0", "")]
    d = spark.createDataFrame([(i, f"http://{h}:80/x", t, 1) for i, h, t in rows], SCHEMA)
    got = H.extract(d, min_tokens=depth, block_bytes=block).collect()
    assert {r.page_id: r.text for r in got} == brute(rows, depth)
    assert len(got) == len(rows) and all(r.n_kept == len(r.text.split()) for r in got)


def test_page_text():
    p = '<!-- a --><head><title>T</title><script>var t="</p>";</script></head><body><P>on<b>e</b><br>two&amp;<a href="x">three</a></P><style>p{}</style>&nbsp;4<!-- open'
    assert H.page_text(p) == "T one two&three 4".replace("two&three", "two&three")
    assert H.page_text("<script>never closed") == "" and H.page_text(None) == "" and H.page_text("a < b") == "a < b"


def test_nulls_and_one_page(spark):
    d = spark.createDataFrame([(1, None, "<p>a b c</p>", 1), (2, "no host", None, 1), (None, "http://x/", "d e f", 1), (3, "http://x/2", " ", 1)], SCHEMA)
    r = {x.page_id: (x.host, x.text, x.n_tokens, x.n_kept) for x in H.extract(d, min_tokens=2).collect()}
    assert r == {1: (None, "a b c", 3, 3), 2: (None, None, 0, 0), None: ("x", "d e f", 3, 3), 3: ("x", "", 0, 0)}
    assert H.extract(d.limit(0)).count() == 0


def test_repeated_rows_and_long_pages(spark):
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(60))
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(150_000))
    rows = [(1, "http://h/1", f"<p>{long} {shared}</p>", 1), (2, "http://h/2", f"<p>own words {shared} tail</p>", 1), (2, "http://h/2", f"<p>own words {shared} tail</p>", 1), (3, "http://h/3", "<p>own words only</p>", 1), (3, "http://h/3", "<p>own words only</p>", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    for block in (1 << 20, 1 << 24):
        got = sorted((x.page_id, x.n_tokens, x.n_kept, x.text) for x in H.extract(d, block_bytes=block).collect())
        assert got == [(1, 150_060, 150_000, long), (2, 63, 3, "own words\ntail"), (2, 63, 3, "own words\ntail"), (3, 3, 3, "own words only"), (3, 3, 3, "own words only")]
