"""Personal data: regular expressions propose spans, checksums confirm, context words adjust the score.

Base kinds are those of the contract (email, ip, card, phone) and are always
kept. Added kinds (iban, secret, ssn) need their checksum or enough context:
``iban`` has its country's length and is confirmed by mod 97, ``ssn`` is of a range
that is given out and, like ``secret``, confirmed by context words within ``window``
code points before or behind the span.

Null and empty texts have no spans. Work is linear in the text: each pattern is
anchored so that a long run of one character class is not scanned again and again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = frozenset(KINDS[:4])

#: The contract's patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Added kinds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LENGTH = {c: n for n, cs in IBAN_LENGTHS.items() for c in cs.split()}
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])")

#: Words near a span that raise or lower its score.
CONTEXT = {
    "email": {"mail", "email", "contact", "reach"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "mastercard", "credit", "payment"},
    "phone": {"phone", "call", "tel", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "konto"},
    "ssn": {"ssn", "social", "security", "tax"},
    "secret": {"token", "key", "secret", "password", "api"},
}
AGAINST = {"example", "version", "sample", "test", "isbn", "order"}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.4}
_WORD = re.compile(r"[A-Za-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, single spaces between their characters or not; what follows is not looked at but for a letter or digit that continues them."""
    for m in _IBAN.finditer(text):
        n, at, got = _LENGTH.get(m.group()[:2], 0), m.start(), ""
        while len(got) < n and at < len(text):
            c = text[at]
            if "A" <= c <= "Z" or "0" <= c <= "9":
                got += c
            elif c != " " or text[at - 1] == " ":
                break
            at += 1
        if n and len(got) == n and not text[at : at + 1].isalnum() and mod97(got):
            yield m.start(), at


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: only runs that end at an @ can begin one."""
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _EMAIL.match(text, begin) if begin < at else None
        if m:
            yield m.start(), m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of every kind whose pattern matches and whose validator agrees."""
    for a, b in emails(text):
        yield "email", a, b
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in _IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for a, b in ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        yield "secret", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int, window: int) -> float:
    near = {w.lower() for a, b in ((max(0, start - window), start), (end, end + window)) for w in _WORD.findall(text, a, b)}
    s = PRIOR[kind] + (0.3 if near & CONTEXT[kind] else 0.0) - (0.2 if near & AGAINST else 0.0)
    return min(1.0, max(0.0, s))


def detect(text: str | None, threshold: float = 0.5, window: int = 40) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = [(k, a, b, score(text, k, a, b, window)) for k, a, b in propose(text)]
    found = [x for x in found if x[0] in BASE or x[3] >= threshold]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, window: int = 40) -> DataFrame:
    """One row per document with its spans; columns: id, spans (kind, start, end, score).

    Narrow: no shuffle, one document at a time. Null and empty texts give an
    empty list; repeated rows give repeated results.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in detect(t, threshold, window)] for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["id"], "spans": spans})

    src = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS t")
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>").withColumnRenamed("id", id_col)


def op5(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``find_pii``."""
    base = "filter(spans, s -> s.kind IN ('email','ip','card','phone'))"
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return find_pii(docs).selectExpr(
        "doc_id",
        *[f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS[:4]],
        f"sha2({joined.format(base)}, 256) AS base_sha256",
        f"{joined.format('spans')} AS spans",
        "CAST(size(spans) AS BIGINT) AS n_spans",
        "array_max(transform(spans, s -> s.score)) AS max_score",
    )


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
