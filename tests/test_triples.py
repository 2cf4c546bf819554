import random

import pytest

from strataframe.operators import changes
from strataframe.sources import triples
from tests.test_changes import EVENT, document, frame, random_history, rows

P = [("http://x/e/", "E"), ("http://x/", "X"), ("http://p#", "")]


@pytest.mark.parametrize(
    "line,want",
    [
        ('<http://x/e/1> <http://p#name> "a \\"b\\" \\u00e9\\n\\\\" .', ("E:1", "name", 'a "b" é\n\\', None)),
        ("<http://x/e/1>\t<http://p#is_a><http://x/2>.# said", ("E:1", "is_a", "X:2", None)),
        ('_:b0 <http://p#name> "x"@en-GB .', ("_:b0", "name", "x@en-GB", None)),
        ('<http://x/e/1> <http://p#n> "5"^^<http://x/int> .', ("E:1", "n", "5^^X:int", None)),
        ('<http://x/e/1> <http://p#n> "5"^^<http://www.w3.org/2001/XMLSchema#string> .', ("E:1", "n", "5", None)),
        ("<http://y/1> <http://p#n> _:o.1 .", ("<http://y/1>", "n", "_:o.1", None)),
        ("  # only said", None),
        ("", None),
        ("<http://x/e/1> <http://p#n> .", (None, None, None, "ParseError")),
        ('<http://x/e/1> <http://p#n> "open .', (None, None, None, "ParseError")),
        ('<http://x/e/1> <http://p#n> "\\q" .', (None, None, None, "ParseError")),
        ('<http://x/e/1> <http://p#n> "\\uD800" .', (None, None, None, "ParseError")),
        ('<http://x/e/1> <http://p#n> "\\UFFFFFFFF" .', (None, None, None, "ParseError")),
        ('"x" <http://p#n> "y" .', (None, None, None, "ParseError")),
    ],
)
def test_lines(line, want):
    assert triples.parsed(line, P) == want


def test_long_lines_are_read_in_one_pass():
    for inner in ("\\n" * 500_000, "a" * 1_000_000, '\\"' * 500_000):
        found = triples.parsed(f'<http://x/e/1> <http://p#n> "{inner}" .', P)
        assert found[3] is None and len(found[2]) >= 500_000
        assert triples.parsed(f'<http://x/e/1> <http://p#n> "{inner} .', P)[3] == "ParseError"


def test_both_forms_have_the_same_events(spark, tmp_path):
    history = [{t: [x for x in lines if "VAGUELY" not in x] for t, lines in d.items()} for d in random_history(8) if d is not None]
    want = changes.build(frame(spark, [document({t: x for t, x in d.items() if x}) for d in history]))
    r, paths = random.Random(1), {}
    for seq, d in enumerate(history):
        lines = [f'<http://x/e/{t}> <http://p#{p}> "{v}" .' for t, x in d.items() for p, _, v in (y.partition(": ") for y in x)]
        r.shuffle(lines)
        (tmp_path / f"{seq}.nt").write_text("\n".join(["# version", *lines, "broken"]))
        paths[seq] = str(tmp_path / f"{seq}.nt")
    found = triples.triples(triples.version_lines(spark, paths), {"http://x/e/": "", "http://p#": ""})
    assert found.filter("error is not null").count() == len(history)
    versions = spark.createDataFrame([(i, f"s{i}", i) for i in range(len(history))], "commit_seq int, sha string, vidx int")
    made = changes.change_tables(changes.presence_of_state(triples.state_of(found)), versions)
    assert rows(made["events"], *EVENT) == rows(want["events"], *EVENT)
    assert triples.triples(triples.version_lines(spark, {}), {}).count() == 0
