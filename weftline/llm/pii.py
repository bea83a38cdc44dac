"""Operator 4, personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

kind          proposed by                                  confirmed by
EMAIL         local part @ domain with a letter top level  length limits of the parts
CREDIT_CARD   13 to 19 digits, single spaces or dashes     Luhn, an issuer's first digits and length
IBAN          country, check digits, 11 to 30 characters   mod-97 and the country's length
US_SSN        3-2-4 digits with dashes                     areas, groups and serials that exist
PHONE         + or parentheses or dashes, 8 to 15 digits   number of digits
IPV4, IPV6    dotted or colon notation                     ranges
MAC           six pairs of hexadecimal digits              -
SECRET        token, key, password = value; known prefixes entropy of the value

Cards and IBANs are looked for within what their patterns propose, so that numbers and words around them hide none. Values of any length
are found to their end. Texts of any length are taken whole; the time is linear in the text but for sorting what is found.
"""

from __future__ import annotations

import bisect
import ipaddress
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import flat, pick, table

THRESHOLD = 0.5
#: Characters on either side in which context words count.
CONTEXT = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


_IBAN_LENGTH = {k: int(v) for k, v in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 "
    "GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 "
    "PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20").split())}


#: First digits (from, to) and lengths of issuers' numbers.
_ISSUERS = [(a, b, frozenset(n)) for a, b, n in (
    ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14,)), ("36", "36", (14, 16)), ("38", "39", (14, 16)), ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("6011", "6011", (16, 19)), ("644", "649", (16, 19)), ("65", "65", (16, 19)),
    ("3528", "3589", (16, 17, 18, 19)), ("62", "62", (16, 17, 18, 19)), ("50", "50", (16,)), ("56", "58", (16,)), ("6304", "6304", (16, 18, 19)), ("6759", "6763", (16, 18, 19)), ("9792", "9792", (16,)), ("2200", "2204", (16, 19)))]


def issued(digits: str) -> bool:
    """Whether an issuer gives out numbers that begin so and are so long."""
    return any(len(digits) in n and a <= digits[:len(a)] <= b for a, b, n in _ISSUERS)


def _card(v: str) -> bool:
    d = re.sub(r"\D", "", v)
    return issued(d) and luhn(d)


def _iban(v: str) -> bool:
    s = v.replace(" ", "")
    return len(s) == _IBAN_LENGTH.get(s[:2], 0) and mod97(s)


def _cards(text: str, m: re.Match) -> list[tuple[int, int]]:
    """Cards in a run of digits with single spaces or dashes: from a group's start to a group's end, the first start first, then the longest."""
    groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer(r"[0-9]+", m[0])]
    out, i = [], 0
    while i < len(groups):
        a, n, ends = groups[i][0], 0, []
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            if n >= 13 and not re.match(r"\.[0-9]", text[groups[j][1]:groups[j][1] + 2]):
                ends.append(j)
        j = next((j for j in reversed(ends) if _card(text[a:groups[j][1]])), None)
        if j is None:
            i += 1
        else:
            out.append((a, groups[j][1]))
            i = j + 1
    return out


_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")


def _ibans(text: str, m: re.Match) -> list[tuple[int, int]]:
    """IBANs in a run of upper-case letters and digits with single spaces: exactly the country's length, up to a border."""
    out, at = [], 0
    for x in _IBAN_START.finditer(text, m.start(), m.end()):
        a, need, b = x.start(), _IBAN_LENGTH.get(x[0][:2], 0), x.start()
        if a < at:
            continue
        while need and b < m.end():
            need -= text[b] != " "
            b += 1
        if not need and b > a and not re.match(r"[A-Za-z0-9]", text[b:b + 1]) and _iban(text[a:b]):
            out.append((a, b))
            at = b
    return out


def _ssn(m: re.Match) -> bool:
    a, g, s = m[0].split("-")
    return a not in ("000", "666") and a < "900" and g != "00" and s != "0000"


def _phone(m: re.Match) -> bool:
    return 8 <= len(re.sub(r"\D", "", m[0])) <= 15


def _ip(m: re.Match) -> bool:
    try:
        ipaddress.ip_address(m[0])
        return True
    except ValueError:
        return False


def _email(m: re.Match) -> bool:
    local, _, domain = m[0].rpartition("@")
    return len(local) <= 64 and len(domain) <= 255 and ".." not in m[0] and local[0] != "." and local[-1] != "."


def _secret(m: re.Match) -> bool:
    v = m[m.lastindex] if m.lastindex else m[0]
    n = len(v)
    return n >= 12 and any(c.isdigit() for c in v) and -sum(c / n * math.log2(c / n) for c in Counter(v).values()) >= 2.5


#: kind, pattern, check, score before context, words that raise it, words that lower it
_KINDS = [
    ("EMAIL", re.compile(r"(?<![\w.+-])[\w.+%-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![\w-])"), _email, 0.9, r"mail|contact|write", r"(?!)"),
    ("IBAN", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+"), _ibans, 0.9, r"iban|bank|account|konto|compte|cuenta", r"(?!)"),
    ("CREDIT_CARD", re.compile(r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,}"), _cards, 0.7, r"card|visa|master|amex|credit|pay|karte|carte|tarjeta", r"isbn|order|invoice|tracking|serial"),
    ("US_SSN", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _ssn, 0.6, r"ssn|social|security", r"part|order|serial|version"),
    ("PHONE", re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?)[0-9]{2,4}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4})?(?![\w-]|\.[0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\w-]|\.[0-9])|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w.-])"),
     _phone, 0.7, r"phone|tel|call|mobile|fax|whatsapp|tele", r"isbn|version|order"),
    ("IPV4", re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])"), _ip, 0.6, r"\bip\b|address|host|server|login", r"version|release|section|chapter"),
    ("IPV6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"), _ip, 0.6, r"\bip(?:v6)?\b|address|host|server", r"time|clock"),
    ("MAC", re.compile(r"(?<![\w:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])"), lambda m: True, 0.6, r"mac|device|ether", r"time"),
    ("SECRET", re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_=.-]{12,})"), _secret, 0.8, r"key|secret|token|password|credential", r"example|dummy"),
    ("SECRET", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])"), _secret, 0.9, r"key|secret|token", r"(?!)"),
]
_KINDS = [(k, p, f, s, re.compile(up, re.I), re.compile(down, re.I)) for k, p, f, s, up, down in _KINDS]
#: Kinds whose check finds the values within a proposed span.
_WITHIN = {"CREDIT_CARD", "IBAN"}
_WORTH = re.compile(r"[0-9@]|::")


def find_pii(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the spans that stand, in order, without overlaps: the higher score, then the longer, then the first wins."""
    if not text or not _WORTH.search(text):
        return []
    found = []
    for rank, (kind, pattern, check, score, up, down) in enumerate(_KINDS):
        for m in pattern.finditer(text):
            if kind in _WITHIN:
                spans = [(a, b, a, b) for a, b in check(text, m)]
            else:
                spans = [(*m.span(m.lastindex or 0), *m.span())] if check(m) else []
            for a, b, start, end in spans:
                near = text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT]
                s = score + 0.1 * bool(up.search(near)) - 0.25 * bool(down.search(near))
                if s >= threshold:
                    found.append((-round(min(s, 1.0), 2), a - b, rank, a, b, kind))
    out: list[tuple[int, int, str, float]] = []  # in the order of the text
    for s, _, _, a, b, kind in sorted(found):
        i = bisect.bisect_left(out, (a,))
        if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or out[i][0] >= b):
            out.insert(i, (a, b, kind, -s))
    return out


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each span as [KIND]."""
    at, parts = 0, []
    for a, b, kind, _ in find_pii(text, threshold):
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return text if not parts else "".join(parts) + text[at:]


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kind, start, end (in characters, end excluded), score for each span of each row.

    Null and empty texts have none; repeated rows each have theirs; of spans that overlap, equal ones too, one stands (find_pii). Very
    long texts are searched whole. A null id is given back as null. Found values themselves are not copied into the result.
    """
    def f(batches):
        for r in batches:
            at, rows = [], []
            for i, t in enumerate(r.column("_text").to_pylist()):
                for x in find_pii(t, threshold):
                    at.append(i)
                    rows.append(x)
            yield pa.RecordBatch.from_arrays([r.column("_id").take(pa.array(at, pa.int64())), pa.array([x[2] for x in rows], pa.string()), pa.array([x[0] for x in rows], pa.int32()),
                                              pa.array([x[1] for x in rows], pa.int32()), pa.array([x[3] for x in rows], pa.float64())], names=["doc_id", "kind", "start", "end", "score"])

    d = pick(docs, _id=id_col, _text=text_col)
    return d.mapInArrow(f, f"doc_id {d.schema['_id'].dataType.simpleString()}, kind string, start int, end int, score double")


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of docs with spans replaced by [KIND]; chars_col, if there, becomes the new length where the text changed.

    Null and empty texts stay as they are; repeated rows are redacted each; columns of other names, of whatever case, are not touched.
    """
    d, at = flat(docs)
    text, chars = at[text_col], at.get(chars_col)
    names = d.columns

    def f(batches):
        for r in batches:
            old = r.column(text).to_pylist()
            new = [redact(t, threshold) for t in old]
            r = r.set_column(names.index(text), text, pa.array(new, pa.string()))
            if chars and pa.types.is_integer(r.schema.field(chars).type):
                n = [len(b) if a != b else c for a, b, c in zip(old, new, r.column(chars).to_pylist())]
                r = r.set_column(names.index(chars), chars, pa.array(n, r.schema.field(chars).type))
            yield r

    return d.mapInArrow(f, d.schema).toDF(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 2))


QUERIES = {"op4_pii": op4_pii}
