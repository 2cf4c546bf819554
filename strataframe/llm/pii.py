"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

One pass over each text, linear in its length: every pattern starts only at the edge of a run of its characters or at
a mark that it must hold (``@``, ``+``), and takes runs whole. The base kinds are reported whatever their score; the
further kinds, whose form alone says little, only from ``THRESHOLD`` on. No shuffle: a scan, a map and a projection.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national", "local")
SPANS = "doc_id long, kinds array<string>, starts array<int>, ends array<int>, scores array<double>"

# The characters and patterns of the base kinds, and their bounds.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_MOST = range(12, 20), range(9, 16), 255

# Lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9-])")

#: What a span is worth by its form, and what a checksum that holds adds.
FORM = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.6, "iban": 0.4, "national": 0.3, "local": 0.3}
CHECKSUM, NEAR, AGAINST, THRESHOLD = 0.3, 0.2, -0.3, 0.5
#: How many code points before and after a span are searched for words.
BEFORE, AFTER = 60, 30
_CALL = "phone telephone tel call mobile cell fax téléphone portable appeler telefon handy anrufen teléfono móvil llamar"
WORDS_FOR = {
    "email": "mail email e-mail contact write courriel contacter schreiben kontakt correo escribir", "ip": "ip host server client address from adresse serveur dirección servidor login",
    "card": "card credit debit visa mastercard amex payment carte carta karte kreditkarte zahlung tarjeta pago", "phone": _CALL, "local": _CALL,
    "iban": "iban account bank transfer compte virement banque konto überweisung cuenta banco transferencia", "national": "ssn social security taxpayer",
}
WORDS_AGAINST = {"ip": "version release build chapter section", "card": "order serial isbn tracking invoice", "phone": "isbn order serial", "local": "isbn order serial", "national": "order serial part"}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without blanks has the length of its country and its check digits hold."""
    if IBAN_LENGTHS.get(account[:2]) != len(account):
        return False
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str):
    free = 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        start = at - len(before) + len(before.rstrip(LOCAL_PART))
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1  # no local part goes past an @
        if m:
            yield start, free
        at = text.find("@", free)


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= IP_MOST


def accounts(text: str):
    m = IBAN.search(text)
    while m:
        want, seen, free = IBAN_LENGTHS.get(m[0][:2], 0), 0, m.start() + 4
        for i, c in enumerate(m[0]):
            seen += c != " "
            if seen == want:
                end = m.start() + i + 1
                if not text[end : end + 1].isalnum() and mod97(m[0][: i + 1].replace(" ", "")):
                    yield m.start(), end
                    free = end
                break
        m = IBAN.search(text, free)


def candidates(text: str):
    """(start, kind, end) of the spans that their checks confirm."""
    for start, end in emails(text):
        yield start, "email", end
    for m in IP.finditer(text):
        if all(map(small_part, m.groups())):
            yield m.start(), "ip", m.end()
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) in CARD_DIGITS and luhn(digits):
            yield m.start(), "card", m.end()
    for m in PHONE.finditer(text):
        if sum(c.isdigit() for c in m[0]) in PHONE_DIGITS:
            yield m.start(), "phone", m.end()
    for start, end in accounts(text):
        yield start, "iban", end
    for kind, pattern in (("national", NATIONAL), ("local", LOCAL_PHONE)):
        for m in pattern.finditer(text):
            yield m.start(), kind, m.end()


def score(text: str, start: int, kind: str, end: int) -> float:
    near = set(_WORD.findall(f"{text[max(0, start - BEFORE) : start]} {text[end : end + AFTER]}".lower()))
    worth = FORM[kind] + CHECKSUM * (kind in ("card", "iban"))
    worth += NEAR * bool(near & _FOR[kind]) + AGAINST * bool(near & _AGAINST[kind])
    return round(min(max(worth, 0.0), 1.0), 3)


_FOR = {k: set(v.split()) for k, v in WORDS_FOR.items()}
_AGAINST = {k: set(WORDS_AGAINST.get(k, "").split()) for k in KINDS}


def scan(text: str) -> list[tuple[int, int, int, float]]:
    """Sorted (start, kind rank, end, score)."""
    found = ((start, kind, end, score(text, start, kind, end)) for start, kind, end in candidates(text))
    return sorted((start, KINDS.index(kind), end, worth) for start, kind, end, worth in found if kind in BASE or worth >= THRESHOLD)


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, kinds, starts, ends, scores: the spans of each row, by start; code points, end exclusive.

    Null and empty texts: no spans. Very long texts: whole, in linear time. Rows that repeat: each its own. No rows: no rows.
    Extra columns, whatever their names, are left out.
    """

    def run(batches):
        for b in batches:
            spans = [scan(t) for t in b.column("text").to_pylist()]
            column = lambda f, kind, spans=spans: pa.array([[f(s) for s in x] for x in spans], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), column(lambda s: KINDS[s[1]], pa.string()), column(lambda s: s[0], pa.int32()), column(lambda s: s[2], pa.int32()), column(lambda s: s[3], pa.float64())],
                names=["doc_id", "kinds", "starts", "ends", "scores"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, SPANS)


def op13_pii(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans of each row, all spans, and their scores in the same order; see ``find_personal``."""
    spans = F.arrays_zip("kinds", "starts", "ends")
    base = F.filter(spans, lambda s: s["kinds"].isin(*BASE))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return find_personal(docs).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), F.array_join(F.transform("scores", lambda s: s.cast("string")), ",").alias("scores"))
