"""Page functions against values worked out by hand."""

import pytest

from weftline.functions import page as P
from weftline.functions.soup import soup


@pytest.mark.parametrize("base, href, want", [
    ("https://a.b/x/y", "../z/?q=1#f", "https://a.b/z/?q=1"), ("https://a.b/x", "/", "https://a.b"), ("https://a.b/x", "mailto:x", None), ("https://a.b/x", "tel:1", None), ("https://a.b/x", "#s", None),
    ("https://a.b/x", "javascript:0", None), ("https://a.b/x", "data:,", None), ("https://a.b/x", "ftp://h/f", None), ("https://a.b/x", "", None), ("https://a.b/x", None, None), ("https://a.b/x", "p;v=1?q", "https://a.b/p?q")])
def test_link_url(base, href, want):
    assert P.link_url(href, base) == want


def test_links_of_all_elements():
    html = "<a href=/a></a><a href=/a#x></a><img src=i.png><form action=/f></form><link href=//c.d/e><a>none</a>"
    assert P.links(html, "http://h/p/") == ["http://c.d/e", "http://h/a", "http://h/f", "http://h/p/i.png"]


def test_spans():
    assert P.tables("<table><tr><td rowspan=2>A</td><td>B</td></tr><tr><td>C</td></tr></table>") == [[["A", "B"], ["", "C"]]]
    assert P.tables("<table><tr><td colspan=2>A</td></tr><tr><td>B</td><td>C</td></tr></table>") == [[["A", ""], ["B", "C"]]]
    assert P.tables("<table></table>") == [] and P.tables(None) == []


def test_records():
    assert P.table_records([["Total (USD)", "", "Total (USD)"], ["1", "2", "3"]]) == [{"total_usd": "3", "column_2": "2"}]
    assert P.cell_text("Pop.\xa0  10[3]") == "Pop. 10"


def test_no_implied_ends():
    assert [n.text() for n in soup("<p>x<p>y</p>").find_all("p")] == ["xy", "y"]


def test_deep_page_needs_no_recursion():
    assert soup("<b>" * 20_000 + "x").text() == "x"


def test_scripts_are_no_text():
    t = soup('<p>a<script>var t="</p>";track(1);</script>b</p>')
    assert t.text(" ", True) == "a b" and "track" in t.find("script").text()


def test_tokens():
    assert P.tokens("The cat's 42 cats, cat!") == ["cats", "cats", "cat"]
    assert P.keywords("too short") == []


def test_keyphrases_drop_parts():
    assert P.keyphrases("red apple pie, red apple pie") == ["red apple pie"]


def test_honeypots():
    assert P.honeypots('<a href="/x" style="display:none">t</a>')["count"] == 0
    h = P.honeypots('<a href="/bot-trap"></a>')
    assert h["found"] == [{"kind": "hidden_link", "tag": "a", "confidence": 0.8}] and h["risk"] == "high"


def test_language():
    v = P.language('<html lang="en-GB"><body>x</body></html>', "https://h/en/p")
    assert (v["primary"], v["confidence"], sorted(v["methods"])) == ("en", 1.0, ["html_lang", "url"])
    assert P.language("", None)["primary"] is None


def test_structured_repeats_and_nesting():
    s = P.structured('<div itemscope itemtype="https://schema.org/A"><b itemprop=n>1</b><b itemprop=n>2</b><div itemprop=o itemscope itemtype="https://schema.org/B"><i itemprop=m>3</i></div></div><script type="application/ld+json">nope</script>')
    assert s["microdata"] == ['{"@context": "https://schema.org", "@type": "A", "n": ["1", "2"], "o": {"@context": "https://schema.org", "@type": "B", "m": "3"}}']
    assert s["json_ld"] == [] and s["types"] == ["A"]


def test_embedded_json_names():
    assert P.embedded_json('<script type="application/json">1</script><script type="application/json">{"a":2}</script>') == {"json_block": "1", "json_block_1": '{"a": 2}'}
