import random
import time

import pytest
from weftline.llm.pii import find_pii, luhn, mod97, pii_spans, redact, redacted


def slow_luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(s[::-1])) % 10 == 0


def test_checksums():
    rnd = random.Random(1)
    for _ in range(500):
        s = "".join(rnd.choice("0123456789") for _ in range(rnd.randrange(13, 20)))
        assert luhn(s) == slow_luhn(s)
    assert mod97("DE89370400440532013000") and not mod97("DE88370400440532013000") and mod97("GB82WEST12345698765432")


@pytest.mark.parametrize("text,want", [
    ("mail a.b+c@mail9.example.com now", [("EMAIL", "a.b+c@mail9.example.com")]),
    ("é heitlich.55@mail1.example.com.", [("EMAIL", "heitlich.55@mail1.example.com")]),
    ("card 4111 1111 1111 1111 or 4111 1111 1111 1112", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00", [("IBAN", "DE89 3704 0044 0532 0130 00")]),
    ("ssn 123-45-6789, not 000-45-6789", [("US_SSN", "123-45-6789")]),
    ("call +1 (372) 555-7739 224.228.19.86 now", [("PHONE", "+1 (372) 555-7739"), ("IPV4", "224.228.19.86")]),
    ("ip 10.0.0.256 version 1.2.3.4", []),
    ("host fe80::1ff:fe23:4567:890a up", [("IPV6", "fe80::1ff:fe23:4567:890a")]),
    ("token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\" x", [("SECRET", "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde")]),
    ("token = aaaaaaaaaaaaaaaaaaaaa1", []),
    ("plain words, 12 numbers and 1234567890123456", []),
    ("", []), (None, []), ("0" * 5000, []), ("@" * 5000, []),
])
def test_spans(text, want):
    got = find_pii(text)
    assert [(k, text[a:b]) for a, b, k, _ in got] == want
    assert all(0.5 <= s <= 1 for *_, s in got)


def test_context_moves_scores():
    plain, up, down = (find_pii(f"{w} 4111111111111111 {w}", 0)[0][3] for w in ("xx", "visa", "order"))
    assert (plain, up, down) == (0.7, 0.8, 0.45)


def sixteen(w):
    """Whether an issuer's numbers of 16 digits begin like this, by its number ranges."""
    n = int(w[:4])
    ranges = [(3600, 3699), (3800, 3999), (4000, 4999), (5100, 5599), (2221, 2720), (6011, 6011), (6440, 6599), (3528, 3589), (6200, 6299), (5000, 5099), (5600, 5899), (6304, 6304), (6759, 6763), (9792, 9792), (2200, 2204)]
    return any(a <= n <= b for a, b in ranges)


def test_unrelated_numbers_are_left_alone():
    rnd = random.Random(3)
    n = [sum(bool(find_pii("".join(rnd.choice("0123456789") for _ in range(k)))) for _ in range(5000)) for k in (13, 14, 15)]
    assert max(n) < 100 and n[2] < 50
    assert [k for *_, k, _ in find_pii("378282246310005 30569309025904 6011111111111117 3530111333300000 4222222222222")] == ["CREDIT_CARD"] * 5


def test_many_spans_in_linear_time():
    text = " ".join(f"u{i}@h{i % 9}.org" for i in range(100_000))
    t = time.process_time()
    got = find_pii(text)
    assert len(got) == 100_000 and time.process_time() - t < 30 and got == sorted(got)


def naive(text):
    """Planted kinds by scanning tokens and their numbers, without the module's patterns."""
    out = []
    for w in text.split(" "):
        if w.count("@") == 1 and w.endswith(".org"):
            out.append(("EMAIL", w))
        elif w.isdigit() and len(w) == 16 and slow_luhn(w) and sixteen(w):
            out.append(("CREDIT_CARD", w))
        elif w.count(".") == 3 and all(p.isdigit() and str(int(p)) == p and int(p) < 256 for p in w.split(".")):
            out.append(("IPV4", w))
    return out


def test_against_brute_force_and_rows(spark):
    rnd = random.Random(4)
    make = [lambda: "word", lambda: f"u{rnd.randrange(99)}@h{rnd.randrange(9)}.org", lambda: "".join(rnd.choice("0123456789") for _ in range(16)),
            lambda: ".".join(str(rnd.randrange(300)) for _ in range(4))]
    docs = [(i, " ".join(rnd.choice(make)() for _ in range(30))) for i in range(200)]
    texts = dict(docs)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs] + [(900, None, None, 0), (901, "", "y", 5), (0, texts[0], "x", 0)], "doc_id long, text string, kind string, n_chars int")
    rows = pii_spans(df).collect()
    for i, t in docs:
        got = sorted({(r.start, r.kind, t[r.start:r.end]) for r in rows if r.doc_id == i})
        assert [g[1:] for g in got] == naive(t)
    assert len([r for r in rows if r.doc_id == 0]) == 2 * len(naive(texts[0]))
    out = redacted(df)
    assert out.schema == df.schema
    by = {r.doc_id: r for r in out.collect()}
    assert len(by) == 202 and by[900].text is None and by[901].n_chars == 5
    assert all(by[i].text == redact(t) and by[i].n_chars == (len(by[i].text) if by[i].text != t else 0) for i, t in docs)
    assert not any(naive(by[i].text) for i, _ in docs)
    assert redacted(df.limit(0)).count() == 0 and pii_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [
    ("DE89370400440532013000 AND more", [("IBAN", "DE89370400440532013000")]),
    ("4111111111111111 123 cvv", [("CREDIT_CARD", "4111111111111111")]),
    ("4111 1111 1111 1111 12/26", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("4111 1111 1111 1111 12/25", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("4111111111111111 123", [("CREDIT_CARD", "4111111111111111")]),
    ("7 4111111111111111", [("CREDIT_CARD", "4111111111111111")]),
    ("4111111111111111 5500-0055-5555-5559 3", [("CREDIT_CARD", "4111111111111111"), ("CREDIT_CARD", "5500-0055-5555-5559")]),
    ("4111111111111111.5 and 4111111111111111.", [("CREDIT_CARD", "4111111111111111")]),
    ("DE89370400440532013000 BIC COBADEFFXXX", [("IBAN", "DE89370400440532013000")]),
    ("DE89 3704 0044 0532 0130 00 EUR 500", [("IBAN", "DE89 3704 0044 0532 0130 00")]),
    ("REF AB12 DE89370400440532013000 GB82WEST12345698765432 EUR", [("IBAN", "DE89370400440532013000"), ("IBAN", "GB82WEST12345698765432")]),
    ("DE893704004405320130001 AND " + "A1" * 3000, []),
])
def test_values_within_longer_spans(text, want):
    assert [(k, text[a:b]) for a, b, k, _ in find_pii(text)] == want
    assert all(text[a:b] not in redact(text) for a, b, _, _ in find_pii(text) if text.count(text[a:b]) == 1)


@pytest.mark.parametrize("before", ["token=", "password: \"", "xoxb-", "ghp_", "sk-"])
def test_secrets_run_to_their_end(before):
    rnd = random.Random(8)
    value = "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(4000))
    assert redact(f"x {before}{value} y") in (f"x {before}[SECRET] y", "x [SECRET] y")
