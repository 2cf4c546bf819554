"""Search patterns in the syntax of linear-time engines, which know no look-around and no references back, as Java patterns that match
the same.

Such an engine never takes more than linear time, so what it can't do is refused here rather than run by one that can. What
both know but mean differently is written out: the end of a text, line ends, blanks, and brackets within classes.
"""

from __future__ import annotations


class BadPattern(ValueError):
    """Says what of a pattern isn't known."""


# The named classes, as Java writes them.
NAMED = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\t\x20", "cntrl": r"\p{Cntrl}", "digit": r"0-9", "graph": r"\p{Graph}",
    "lower": r"a-z", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r\x20", "upper": r"A-Z", "word": r"0-9A-Za-z_", "xdigit": r"0-9A-Fa-f",
}
BLANK = r"\t\n\f\r\x20"
# Words end by ASCII letters, digits and the low line.
_W = "[0-9A-Za-z_]"
EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
WITHIN = f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))"
HEX = set("0123456789abcdefABCDEF")
#: Escapes that mean the same to both, besides marks.
SAME = set("aftnrvdDwWAz") | {"x", "p", "P", "0"}


def _escape(p: str, i: int, in_class: bool) -> tuple[str, int]:
    """What stands for the escape at i, and where it ends."""
    if i + 1 >= len(p):
        raise BadPattern("a backslash at the end")
    c = p[i + 1]
    if c == "s":
        return (BLANK if in_class else f"[{BLANK}]"), i + 2
    if c == "S":
        return f"[^{BLANK}]", i + 2
    if c in "bB" and not in_class:
        return (EDGE if c == "b" else WITHIN), i + 2
    if c == "x" and p[i + 2 : i + 3] == "{":
        end = p.find("}", i)
        digits = p[i + 3 : end] if end > 0 else ""
        if not digits or set(digits) - HEX or int(digits, 16) > 0x10FFFF:
            raise BadPattern("\\x{...}")
        return p[i : end + 1], end + 1
    if c == "v":
        return r"\x0B", i + 2
    if c == "Q":
        end = p.find(r"\E", i + 2)
        text = p[i + 2 : end if end >= 0 else len(p)]
        return "".join("\\" + x if not x.isalnum() and x.isascii() else x for x in text), end + 2 if end >= 0 else len(p)
    if c in "pP":
        end = p.find("}", i) + 1 if p[i + 2 : i + 3] == "{" else i + 3
        name = p[i + 2 : end].strip("{}")
        if not name or end <= 0:
            raise BadPattern("a class without a name")
        negated = (c == "P") != name.startswith("^")
        return f"\\{'P' if negated else 'p'}{{{_script(name.lstrip('^'))}}}", end
    if c == "x":
        if set(p[i + 2 : i + 4]) - HEX or len(p) < i + 4:
            raise BadPattern("two hex digits after \\x")
        return p[i : i + 4], i + 4
    if c in SAME and not (in_class and c in "Az"):
        return p[i : i + 2], i + 2
    if c.isalnum():
        raise BadPattern(f"\\{c}")
    return "\\" + c, i + 2


def _script(name: str) -> str:
    return name if len(name) <= 2 else f"Is{name}"


def _class(p: str, i: int) -> tuple[str, int]:
    """The class that opens at i: what is special to Java alone is escaped."""
    out, i = "[", i + 1
    if p[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while i < len(p) and (p[i] != "]" or first):
        if p.startswith("[:", i) and (end := p.find(":]", i)) > 0:
            name = p[i + 2 : end]
            if name.lstrip("^") not in NAMED:
                raise BadPattern(f"[:{name}:]")
            out += f"[^{NAMED[name[1:]]}]" if name.startswith("^") else NAMED[name]
            i = end + 2
        elif p[i] == "\\":
            text, i = _escape(p, i, True)
            out += text
        else:
            if p[i + 1 : i + 2] == "-" and p[i + 2 : i + 3] not in ("", "]", "\\", "[") and p[i + 2] < p[i]:
                raise BadPattern(p[i : i + 3])
            out += "\\" + p[i] if p[i] in "[]&^#" or p[i].isspace() else p[i]
            i += 1
        first = False
    if i >= len(p):
        raise BadPattern("a class that isn't closed")
    return out + "]", i + 1


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The Java pattern that finds what ``pattern`` finds; BadPattern where a linear-time engine knows none."""
    # line ends are only \n; letters of all alphabets fold
    out, i, lines = "(?d)" + ("(?iu)" if ignore_case else ""), 0, [False]
    repeatable = False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            text, i = _escape(pattern, i, False)
            out, repeatable = out + text, True
        elif c == "[":
            text, i = _class(pattern, i)
            out, repeatable = out + text, True
        elif c == "(":
            lines.append(lines[-1])
            if pattern.startswith("(?", i):
                text, i = _group(pattern, i, lines)
                out += text
            else:
                out, i = out + "(", i + 1
            repeatable = False
        elif c == ")":
            if len(lines) == 1:
                raise BadPattern("a ) without a (")
            lines.pop()
            out, i, repeatable = out + ")", i + 1, True
        elif c in "*+?" or c == "{" and (end := _counted(pattern, i)):
            if not repeatable:
                raise BadPattern(f"{c} repeats nothing")
            end = i + 1 if c != "{" else end
            out += pattern[i:end]
            if pattern[end : end + 1] == "?":
                out, end = out + "?", end + 1
            i = end
            if pattern[i : i + 1] in ("*", "+", "?") or pattern[i : i + 1] == "{" and _counted(pattern, i):
                raise BadPattern("a repetition of a repetition")
        elif c == "$":
            out, i, repeatable = out + (r"(?![^\n])" if lines[-1] else r"\z"), i + 1, True
        elif c == "^":
            out, i, repeatable = out + (r"(?<![^\n])" if lines[-1] else r"\A"), i + 1, True
        else:
            out += "\\" + c if c in "{}]" else c
            i, repeatable = i + 1, c not in "|"
    if len(lines) > 1:
        raise BadPattern("a ( without a )")
    return out


def _counted(p: str, i: int) -> int:
    """Where ``{n}``, ``{n,}`` or ``{n,m}`` ends, 0 if it isn't one."""
    end = p.find("}", i)
    low, comma, high = p[i + 1 : end].partition(",") if end > 0 else ("", "", "")
    if not low.isdigit() or comma and high and not high.isdigit():
        return 0
    if max(int(low), int(high or 0)) > 1000 or high and int(high) < int(low):
        raise BadPattern(p[i : end + 1])
    return end + 1


def _group(p: str, i: int, lines: list[bool]) -> tuple[str, int]:
    """The opening of a group that starts with ``(?``: named, plain, or with flags."""
    if p.startswith("(?P<", i):
        end = p.find(">", i)
        if end > 0 and p[i + 4 : end].replace("_", "").isalnum():
            return "(", end + 1  # searches have no use for names
    end = i + 2
    while end < len(p) and p[end] in "imsU-":
        end += 1
    if p[end : end + 1] not in (":", ")"):
        raise BadPattern(f"group {p[i : end + 1]}")
    on, _, off = p[i + 2 : end].partition("-")
    if "U" in on + off:
        raise BadPattern("flag U")
    flags = lambda x: "".join(f + "u" if f == "i" else f for f in x)
    at = -1 if p[end] == ":" else -2
    if "m" in on:
        lines[at] = True
    if "m" in off:
        lines[at] = False
    if p[end] == ")":
        lines.pop()
    spoken = flags(on) + (f"-{flags(off)}" if off else "")
    return f"(?{spoken}{p[end]}" if spoken or p[end] == ":" else "", end + 1
