"""Patterns against a linear-time engine: what each finds in each text, and what each refuses."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strataframe.functions.patterns import BadPattern, java_pattern

# fmt: off
PATTERNS = [r"\bb",r"a\Bb",r"(?m)^",r"x|^b$",r"[a-",r"\x{110000}",r"a$",r"(?m)a$",r"^b",r"(?m)^b",r"a.b",r"(?s)a.b",r"\sx",r"\Sx",r"[\s]x",r"[[:alpha:]]+1",r"[^[:digit:]]x",r"[a[b]",r"[a&&b]",r"[]a]",r"[^]a]x",r"(?i)É",r"(?=a)",r"(?!a)",r"(?<=a)b",r"(?<!a)b",r"(a)\1",r"(?P<n>a)b",r"(?<n>a)b",r"(?P=n)",r"a++",r"a*+",r"(?>a)",r"a{2,3}",r"a{,3}",r"a{2}{3}",r"a{1001}",r"{x}",r"a{x",r"\Qa.b\E",r"\pL+",r"\p{L}1",r"\p{Greek}",r"\PL",r"\p{^L}",r"\x41",r"\x{e9}",r"\h",r"\R",r"\K",r"\b",r"\d+",r"\w+\z",r"\Z",r"\A.",r"(",r")",r"[a",r"*a",r"a**",r"a|*",r"()",r"(?i:a)B",r"(?-i)a",r"(?x)a b",r"[b-a]",r"[a\]b]",r"\v",r"[\d-x]",r"a\b",r"$",r"a||b",r"(|a)+x",r"[#]",r"[ ]",r"#",r"\-",r"\_",r"\é", r"[\w&&x]", r"\01", r"\8", r"(?U)a", r"[[:foo:]]", r"\C", r"^*", r"$*",r"\b+",r"(?m)^$",r"(?ms)^.$",r"(?m:a$)|b$",r"x{0}y"]
TEXTS = ["a","b","a\n","x\nb","a\rb","a\nb","aa b","\x0bx"," x","1x","Z1","é","É","ab","aB","[","&","]","a]x","σ","A","aaa","a{,3}","{x}","a{x","a.b","B","","a b","b\na\nb","#","_","-","y","xxy"," x"]
# fmt: on
#: Refused here, known there: matches that go back to the shortest, single bytes.
REFUSED = {r"(?U)a", r"\C"}


@pytest.mark.parametrize("ignore_case", [False, True])
def test_patterns_find_the_same(spark, ignore_case):
    con, want, got, java = duckdb.connect(), {}, {}, {}
    for p in PATTERNS:
        try:
            want[p] = [con.execute("select regexp_matches(?, ?, ?)", [t, p, "i" if ignore_case else ""]).fetchone()[0] for t in TEXTS]
        except duckdb.Error:
            want[p] = "refused"
        try:
            java[p] = java_pattern(p, ignore_case)
        except BadPattern:
            got[p] = "refused"
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", *(F.col("t").rlike(j).alias(f"p{k}") for k, j in enumerate(java.values()))).orderBy("i").collect()
    for k, p in enumerate(java):
        got[p] = [r[f"p{k}"] for r in rows]
    assert {p: got[p] for p in PATTERNS if p not in REFUSED} == {p: want[p] for p in PATTERNS if p not in REFUSED}
    assert all(got[p] == "refused" for p in REFUSED)


def test_a_search_that_cannot_be_linear_is_refused(spark):
    from strataframe.operators.history import text_match

    with pytest.raises(BadPattern):
        text_match(F.col("t"), r"(a)\1", regex=True)
