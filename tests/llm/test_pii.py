import hashlib
import re
import time

import pytest

from strataframe.llm import pii
from tests.llm.cases import documents, frame

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
TEXTS = [
    "write to a.b+c@mail5.example.com, x@y or @z.de or a@b.c@d.e_f@g.hi; a@b.-.x..y", "é1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111",
    "+1 (743) 555-3824 +4111111111111111 +49-30/123 +1.2.3.4.5.6.7.8.9 (+33 1 23 45 67 89)", "+123456789.1.1.1 7@x.y+1234567890", "0" * 5000 + ".0.0.0", "1" * 300 + "@" * 9,
]


def by_hand(text):
    """The contract's patterns as they stand, by a plain search."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return (*(sum(k == i for _, k, _ in spans) for i in range(4)), sha(",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in sorted(spans))))


def base(df):
    return sorted((tuple(r) for r in df.drop("spans", "scores").collect()), key=str)


def test_base_kinds(spark):
    rows = [*documents(), *((100 + i, t, "a") for i, t in enumerate(TEXTS))]
    assert base(pii.op13_pii(frame(spark, rows))) == sorted(((d, *by_hand(t)) for d, t, _ in rows), key=str)
    assert pii.op13_pii(frame(spark, [])).count() == 0


def test_the_query_over_its_table(spark):
    """All rows of the given table, whole, against the plain search."""
    from strataframe.llm.common import table
    from strataframe.llm.queries import QUERIES

    given = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    got = QUERIES["op13_pii"](spark, "/root/testdata/sf0.01")
    assert base(got) == sorted(((r.doc_id, *by_hand(r.text)) for r in given), key=str)
    assert all(got.agg({f"n_{k}": "sum"}).first()[0] > 0 for k in pii.BASE)
    kept = [r for r in got.collect() if r.spans]
    assert all(len(r.spans.split(",")) == len(r.scores.split(",")) for r in kept)


def test_random_texts_against_the_plain_search():
    import random

    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("aZ09@..+-+ ()12%_é") for _ in range(r.randrange(60)))
        found = pii.scan(text)
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e, _ in found if k < 4)
        assert (*(sum(k == i for _, k, _, _ in found) for i in range(4)), sha(spans)) == by_hand(text), text


def test_checksums_and_context():
    kinds = lambda t: [pii.KINDS[k] for _, k, _, _ in pii.scan(t)]
    assert kinds("GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("GB82 WEST 1234 5698 7654 33") == [] and kinds("GB82WEST12345698765432x") == []
    assert kinds("GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00") == ["iban"] * 2
    assert kinds("social security 123-45-6789") == ["national"] and kinds("number 123-45-6789") == [] and kinds("SSN 000-45-6789") == []
    assert kinds("please call (030) 1234 567") == ["local"] and kinds("in (030) 1234 567") == []
    worth = lambda t: pii.scan(t)[0][3]
    assert worth("from host 10.0.0.1") > worth("it is 10.0.0.1") > worth("since version 10.0.0.1")
    assert worth("credit card 4111111111111111") > worth("see 4111111111111111") > worth("order 4111111111111111")


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "a." * 500_000, "1.2." * 250_000, "+1" * 500_000, "+1" + " " * 1_000_000, "a@" * 500_000, "1 " * 500_000, "AB12" * 250_000, "(030)" * 500_000, "a@b." * 250_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    pii.scan(text)
    assert time.process_time() - began < 8
