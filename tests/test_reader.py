"""The clause reader against patterns that say the same, and on lines of a megabyte of any marks."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strataframe.functions import reader
from strataframe.operators import stanzas

# A value, as one pattern: body, block of qualifiers, comment. Right, but it goes back and forth.
VALUE = re.compile(rf'((?:[^"\\{{!]++|{reader.QUOTED}|\\.|[{{!])*?)[ \t]*(\{{(?:[^"{{}}\\]++|{reader.QUOTED}|\\.)*+\}})?[ \t]*((?<![^ \t])![ \t].*|(?<![^ \t])!)?', re.S)


def parts_by_pattern(value):
    m = VALUE.fullmatch(value)
    if m is None:
        return None
    return m[1].rstrip(" \t"), m[2], m[3]


def parts_by_scan(value):
    p = reader.cut(value)
    if p is None:
        return None
    block = value[p.qualifiers.start - 1 : p.qualifiers.stop + 1] if p.qualifiers else None
    return value[: p.body].rstrip(" \t"), block, value[p.comment :] if p.comment is not None else None


def test_parts_against_the_pattern():
    r = random.Random(2)
    for n in range(40_000):
        value = "".join(r.choice('a "\\{}!, =[]') if n % 2 else r.choice(["a", " ", '"', "{", "}", "! ", '"b"', "\\", "{x}"]) for _ in range(r.randrange(12)))
        assert parts_by_scan(value) == parts_by_pattern(value), repr(value)


def test_one_way_of_writing():
    one = lambda line: reader.canonical(line)[1]
    assert one('synonym:   "a,  {x}"   EXACT  [A:1,B:2  , C:3 ]   {note = "a,b",source="S:1"}   !   label  here ') == '"a,  {x}" EXACT [A:1, B:2, C:3] {note="a,b", source="S:1"} ! label  here'
    assert one('synonym: "a" EXACT [W:1 "said, [here]",W:2]{s="1"}') == '"a" EXACT [W:1 "said, [here]", W:2] {s="1"}'
    assert one('name: two  words  {source = "x",k="y"} ! c') == 'two  words {source="x", k="y"} ! c'
    assert one("name: braces {of, text}  stay ! as  they are") == "braces {of, text}  stay ! as  they are"
    assert one(r"subset: a\,  b,c") == r"a\, b,c" and one('def: "open  [A:1]') == '"open  [A:1]' and one("xref: a\\") == "a\\"
    assert reader.canonical("name:close") == ("name", "close") and reader.canonical("comment") == ("comment", "") and reader.canonical("a b: c") == ("a b", "c")
    assert reader.full_id("K:6 ! a kite") == "K:6" and reader.full_id('K:6 {a="b"} ! x') == "K:6" and reader.full_id("K:6 again") == "K:6 again"


MARKS = ['"', "\\", "{", "}", "!", "[", "]", ",", " ", "=", '"a" ', "a\\,b ", "a!b{ ", " ! ", "{a}", '{a="b"}', "[a]", "a  ", '"\\"" ', "\\\\", "é, ", '" {', "! {", "{! "]


@pytest.mark.parametrize("mark", MARKS)
def test_a_megabyte_of_a_mark_takes_linear_time(mark):
    text = mark * (1_000_000 // len(mark))
    began = time.process_time()
    for line in (f"note: {text}", f"name: {text}", f'synonym: "x" EXACT [{text}]', f'def: "{text}" [A:1] {{s="{text}"}}', f"x: {{{text}}} ! {text}"):
        clauses, _ = reader.Reader().stanza(f"[Term]\nid: A:1\n{line}\n", "A:1")
        assert len(clauses) == 1
    assert time.process_time() - began < 30


def test_long_lines_cost_no_other_stanza(spark):
    rows = [(f"A:{i}", f"[Term]\nid: A:{i}\nnote: {m * (1_000_000 // len(m))}\n") for i, m in enumerate(MARKS)] + [("B:1", "[Term]\nid: B:1\nname: b\n"), ("B:2", '[Term]\nid: B:2\nsynonym: "y" VAGUELY [Z:9]\n'), ("B:3", None)]
    got = spark.createDataFrame(rows, "term_id string, stanza string").select("term_id", stanzas.read(F.col("stanza"), F.col("term_id")).alias("r")).select("term_id", F.size("r.clauses").alias("n"), "r.error").collect()
    found = {r.term_id: (r.n, r.error) for r in got}
    assert found == {f"A:{i}": (1, None) for i in range(len(MARKS))} | {"B:1": (1, None), "B:2": (1, "ParseError"), "B:3": (0, None)}
