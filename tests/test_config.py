import pytest

from weftline import config as C


def test_env():
    e = C.parse_env("# c\nA=1\nB = 'x=y' \n\nbad\nC=\"\nL=a, ,b\n")
    assert e == {"A": "1", "B": "x=y", "C": '"', "L": "a, ,b"}
    assert C.cast(e["A"], int) == 1 and C.cast(e["L"], list) == ["a", "b"] and C.cast("On", bool) is True and C.cast("", bool) is False and C.cast("x", int, 5) == 5 and C.cast(None, bool, True) is True


def test_auth():
    assert C.Auth("basic", user="u", password="p").request_headers() == {"Authorization": "Basic dTpw"}
    assert C.Auth("bearer", token="t").request_headers() == {"Authorization": "Bearer t"}
    a = C.Auth("api_key", token="t", name="k", place="query")
    assert a.request_headers() == {} and a.request_params() == {"k": "t"}
    for bad in (dict(kind="basic", user="u"), dict(kind="x")):
        with pytest.raises(ValueError):
            C.Auth(**bad)


def test_crawl_settings():
    assert C.Crawl().snapshot()["fetch"]["timeout"] == 10
    with pytest.raises(ValueError):
        C.Crawl(max_depth=-1)


def test_changes_and_precedence():
    c = C.Crawl().with_changes(max_depth=1, fetch_timeout=3, rate_delay=0.5, output_kind="csv")
    assert (c.max_depth, c.fetch.timeout, c.rate.delay, c.output.kind, C.Crawl().fetch.timeout) == (1, 3, 0.5, "csv", 10)
    for bad in ({"x": 1}, {"fetch_x": 1}, {"output_kind": "pdf"}):
        with pytest.raises(ValueError):
            C.Crawl().with_changes(**bad)
    one = lambda **k: C.setting("A", int, 0, **({"env": {}} | k))
    assert [one(env={"A": "1"}, dotenv={"A": "2"}, file={"A": 3}), one(dotenv={"A": "2"}, file={"A": 3}), one(file={"A": 3}), one()] == [1, 2, 3, 0]
    assert C.setting("a.b", int, 0, env={}, file={"a": {"b": "7"}}) == 7 and C.setting("a.b.c", int, 5, env={}, file={"a": {"b": 7}}) == 5


def test_digest():
    a = C.Auth("digest", user="Mufasa", password="Circle of Life")
    assert a.request_headers() == {} and a.pair() == ("Mufasa", "Circle of Life")
    given = 'Digest realm="http-auth@example.org", qop="auth, auth-int", algorithm=MD5, nonce="7ypf/xlj9XXwfDPEoM4URrv/xwf94BcCAzFZH4GiTo0v", opaque="FQhe/qaU925kfnzjCev0ciny7QMkPqMAFRtzCUYo5tdS"'
    h = a.answer(given, "GET", "/dir/index.html", "f2/wE4q74E6zIJEtWaHKaf5wv/H5QzzpXusqGemxURZJ")["Authorization"]
    assert 'response="8ca523f5e9506fed4657c9700eebdbec"' in h and "nc=00000001" in h  # the example of RFC 7616


def test_session_and_logs(tmp_path):
    import json
    import logging

    h = C.Session(headers={"User-Agent": "x", "X-API-Key": "a"}, token="t", api_key="k").request_headers()
    assert (h["User-Agent"], h["Authorization"], h["X-API-Key"]) == ("x", "Bearer t", "k")
    log = C.configure_logging("DEBUG", str(tmp_path / "l"), True, levels={"plans": "ERROR"})
    log.info("hello %s", "you", extra={"url": "u"})
    row = json.loads((tmp_path / "l").read_text())
    assert (row["message"], row["url"], row["level"]) == ("hello you", "u", "INFO") and logging.getLogger("weftline.plans").level == logging.ERROR
    C.configure_logging()
    assert len(log.handlers) == 1
