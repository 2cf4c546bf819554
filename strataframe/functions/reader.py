"""Reading clause lines: one pass over a line, in time linear in its length, for any marks in any number.

A line is ``predicate: value``. A value is a body, then perhaps a block of qualifiers in braces, then perhaps a comment after
``!``. Within quotes, and after a backslash, marks are text. The scanner steps from mark to mark; patterns take runs
whole and never go back, so neither time nor stack grows with what a line holds.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# What ends a stretch of plain text for the scanner.
MARK = re.compile(r'["\\{}!\[\]]')
QUOTED = r'"(?:[^"\\]++|\\.)*+"'
#: Quoted text, an escaped character, or a run of blanks.
SPACED = re.compile(rf"{QUOTED}|\\.|[ \t]+", re.S)
EQUALS = re.compile(rf"{QUOTED}|\\.|(?<![ \t])[ \t]*=[ \t]*", re.S)
COMMA = re.compile(rf"{QUOTED}|\\.|,", re.S)
# What a line must look like to be read: any clause, and those with quoted text.
ANY_CLAUSE = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*+:(?: .*)?", re.S)
SHAPES = {
    "synonym": re.compile(rf"{QUOTED} (?:EXACT|BROAD|NARROW|RELATED)(?: [^\s\[]++)? \[.*\].*", re.S),
    "def": re.compile(rf"{QUOTED} \[.*\].*", re.S),
}
QUALIFIER = re.compile(rf'[^\s=",{{}}]++={QUOTED}', re.S)
#: Clauses whose value is running text, in which blanks and commas mean nothing, and braces only if they hold qualifiers.
FREE_TEXT = ("name", "comment", "created_by", "creation_date")
#: Clauses that end in a list of references.
WITH_XREFS = ("synonym", "def")
# A value without marks and double blanks is written in its one way already.
PLAIN = re.compile(r'(?:[^\s"\\{}!\[\]]++ ?)*+')


class Parts(NamedTuple):
    """Where a value is cut: the body ends at ``body``; inner qualifiers and the comment are slices, or None."""

    body: int
    qualifiers: slice | None
    comment: int | None
    #: The unquoted brackets at the end of the body, or None.
    xrefs: slice | None


def cut(value: str) -> Parts | None:
    """None where a quote or an escape stays open."""
    quoted, skip, brace, bang, n = False, -1, -1, -1, len(value)
    opened, closed, lists = -1, -1, -1  # a block of qualifiers at the end; the last unquoted bracket
    xrefs = None
    for m in MARK.finditer(value):
        at, c = m.start(), m[0]
        if at < skip:
            continue
        if c == "\\":
            skip = at + 2
        elif c == '"':
            quoted = not quoted
        elif quoted:
            pass
        elif c == "{":
            if bang >= 0:
                break  # the braces before hold no qualifiers, so their mark is a comment
            brace = at
        elif c == "}" and brace >= 0:
            if _ends(value, at + 1):
                opened, closed = brace, at
                break
            if bang >= 0:
                break
            brace = -1
        elif c == "!" and (at == 0 or value[at - 1] in " \t") and (at + 1 == n or value[at + 1] in " \t"):
            if brace < 0:
                return Parts(at, None, at, _at_end(value, at, xrefs))
            bang = at if bang < 0 else bang
        elif c == "[" and brace < 0:
            lists = at
        elif c == "]" and brace < 0:
            xrefs, lists = slice(lists + 1, at) if lists >= 0 else None, -1
    if opened >= 0:
        rest = value[closed + 1 :].lstrip(" \t")
        return Parts(opened, slice(opened + 1, closed), n - len(rest) if rest else None, _at_end(value, opened, xrefs))
    if bang >= 0:
        return Parts(bang, None, bang, _at_end(value, bang, xrefs))
    return None if quoted or skip > n else Parts(n, None, None, _at_end(value, n, xrefs))


def _ends(value: str, at: int) -> bool:
    """Whether nothing but a comment follows."""
    rest = _AFTER.match(value, at)
    return rest.end() == len(value) or rest[0] != "" and value[rest.end()] == "!" and (rest.end() + 1 == len(value) or value[rest.end() + 1] in " \t")


_AFTER = re.compile(r"[ \t]*+")


def _at_end(value: str, end: int, xrefs: slice | None) -> slice | None:
    return xrefs if xrefs is not None and not value[xrefs.stop + 1 : end].strip(" \t") else None


def one_blank(text: str) -> str:
    return SPACED.sub(lambda m: " " if m[0][0] in " \t" else m[0], text)


def listed(inner: str) -> str:
    """A comma-separated list with one blank after each comma; commas in quotes and escaped ones stay."""
    out, at = [], 0
    for m in COMMA.finditer(inner):
        if m[0] == ",":
            out.append(inner[at : m.start()].strip(" \t"))
            at = m.end()
    return ", ".join([*out, inner[at:].strip(" \t")])


def qualifiers_of(inner: str) -> str:
    return listed(EQUALS.sub(lambda m: "=" if "=" == m[0].strip(" \t") else m[0], inner))


def are_qualifiers(inner: str) -> bool:
    """Whether every item is a name and a quoted value."""
    items, at = [], 0
    for m in COMMA.finditer(inner):
        if m[0] == ",":
            items.append(inner[at : m.start()])
            at = m.end()
    return all(QUALIFIER.fullmatch(EQUALS.sub(lambda m: "=" if "=" == m[0].strip(" \t") else m[0], x).strip(" \t")) for x in [*items, inner[at:]])


def canonical_value(predicate: str, value: str) -> str:
    """A value in its one way of writing: one blank between its parts, none around ``=`` in qualifiers, one after each comma of
    qualifiers and of a list of references. What can't be cut stays as it is."""
    value = value.strip(" ")
    if PLAIN.fullmatch(value):
        return value
    parts = cut(value)
    if parts is None:
        return value
    free = predicate in FREE_TEXT
    if free and (parts.qualifiers is None or not are_qualifiers(value[parts.qualifiers])):
        return value
    if free:
        body = value[: parts.body].rstrip(" \t")
    elif predicate in WITH_XREFS and parts.xrefs is not None:
        before = one_blank(value[: parts.xrefs.start - 1]).rstrip()
        body = f"{before} [{listed(one_blank(value[parts.xrefs]))}]" if before else f"[{listed(one_blank(value[parts.xrefs]))}]"
    else:
        body = one_blank(value[: parts.body]).strip(" ")
    block = f" {{{qualifiers_of(value[parts.qualifiers])}}}" if parts.qualifiers is not None else ""
    said = value[parts.comment + 1 :].strip(" \t") if parts.comment is not None else ""
    return body + block + (f" ! {said}" if said else "")


def canonical(line: str) -> tuple[str, str]:
    """(predicate, value) of a line; blanks after the colon don't count, and without ``": "`` the value is empty."""
    head, colon, rest = line.partition(":")
    if colon and head and not _BLANK.search(head) and (rest := rest.lstrip(" \t")):
        return head, canonical_value(head, rest)
    predicate, _, value = line.partition(": ")
    return predicate, canonical_value(predicate, value)


_BLANK = re.compile(r"\s")


def full_id(line: str) -> str:
    """What stands on an id line besides qualifiers and a comment."""
    m = re.search(r"\s\{|!", line)
    return (line[: m.start()] if m else line).strip()


class Reader:
    """Reads stanzas; short lines that come again are read once, as most lines of a version are those of the one before."""

    MOST, LONGEST = 50_000, 400

    def __init__(self):
        self.known: dict[str, tuple[tuple[str, str], bool]] = {}

    def line(self, line: str) -> tuple[tuple[str, str], bool]:
        """The clause, and whether it can be read."""
        found = self.known.get(line)
        if found is None:
            clause = canonical(line)
            shape = SHAPES.get(clause[0])
            found = clause, bool(ANY_CLAUSE.fullmatch(line)) and (shape is None or bool(shape.fullmatch(clause[1])))
            if len(line) <= self.LONGEST:
                if len(self.known) >= self.MOST:
                    self.known.clear()
                self.known[line] = found
        return found

    def stanza(self, stanza: str, term_id: str | None) -> tuple[list[tuple[str, str]], str | None]:
        """Sorted clauses, without the head, the id, blank lines and comment lines; and why the stanza can't be read, or None."""
        clauses, good, own = [], True, None
        for line in stanza.split("\n")[1:]:
            line = line.rstrip(" ")
            if line.startswith("id:"):
                own = line[4:] if own is None and line.startswith("id: ") else own
            elif line and line[0] != "!":
                clause, ok = self.line(line)
                clauses.append(clause)
                good = good and ok
        error = "ParseError" if not good else "IdMismatch" if own is not None and term_id is not None and full_id(own) != term_id else None
        return sorted(clauses), error
