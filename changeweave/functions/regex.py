"""Regular expressions of the RE2 dialect on Spark's engine."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# POSIX classes and what they are in Java.
_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "word": r"\w", "ascii": r"\p{ASCII}"}


class PatternError(ValueError):
    """The text is no pattern of the dialect."""


def _class(pattern: str, at: int) -> tuple[str, int]:
    """Translate a character class that begins at ``at``; the text and the place after it."""
    out, i = "[", at + 1
    if pattern[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while True:
        if i >= len(pattern):
            raise PatternError("missing closing ]")
        c = pattern[i]
        if c == "]" and not first:
            return out + "]", i + 1
        first = False
        if c == "[":
            if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
                if m[2] not in _POSIX:
                    raise PatternError(f"unknown class {m[0]}")
                made = _POSIX[m[2]]
                out += (made.replace("\\p", "\\P") if "\\p" in made else made.upper()) if m[1] else made
                i += m.end()
                continue
            out += r"\["
        elif c == "]":
            out += r"\]"
        elif c == "&" and pattern[i : i + 2] == "&&":
            out += r"\&"
        elif c == "\\":
            out += pattern[i : i + 2]
            i += 1
        else:
            out += c
        i += 1


def java_pattern(pattern: str) -> str:
    """The pattern for Java; PatternError for what RE2 would refuse too (look-around, back references, open groups)."""
    out, i, depth, lines = "", 0, 0, re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            following = pattern[i + 1 : i + 2]
            if not following:
                raise PatternError("trailing backslash")
            if following.isdigit() and following != "0":
                raise PatternError("back references are not supported")
            out += r"\z" if following == "z" else pattern[i : i + 2]
            i += 2
        elif c == "[":
            made, i = _class(pattern, i)
            out += made
        elif c == "(":
            depth += 1
            rest = pattern[i:]
            if re.match(r"\(\?(<?[=!]|>)", rest):
                raise PatternError("look-around is not supported")
            if m := re.match(r"\(\?P?<(\w+)>", rest):
                out += f"(?<{m[1].replace('_', 'U')}>"
                i += m.end()
            else:
                out += c
                i += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unexpected )")
            out += c
            i += 1
        elif c == "$" and not lines:
            out += r"\z"
            i += 1
        elif c in "*+?" and re.search(r"(?<!\\)[*+?]\+?$", out) and c == "+":
            raise PatternError("possessive quantifiers are not supported")
        else:
            out += c
            i += 1
    if depth:
        raise PatternError("missing )")
    return "(?d)" + out


def _groups(pattern: str) -> dict[str, int]:
    """Number of each group by number and by name."""
    found, n, i = {"0": 0}, 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            continue
        if pattern[i] == "[":
            i = _class(pattern, i)[1]
            continue
        if pattern[i] == "(":
            m = re.match(r"\(\?P?<(\w+)>", pattern[i:])
            if m or pattern[i + 1 : i + 2] != "?":
                n += 1
                found[str(n)] = n
                if m:
                    found[m[1]] = n
        i += 1
    return found


def java_replacement(replacement: str, pattern: str) -> str:
    """The replacement for Java: the longest name after $ counts, unknown groups are empty, $$ is a dollar."""
    groups, out, i = _groups(pattern), "", 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\":
            out += "\\\\"
        elif c == "$":
            if replacement[i + 1 : i + 2] == "$":
                out += r"\$"
                i += 1
            elif m := re.match(r"\$(?:\{(\w+)\}|(\w+))", replacement[i:]):
                name = m[1] or m[2]
                if name in groups:
                    number = groups[name]
                    # Java reads on while the number is that of a group; a class of one character stops it.
                    out += f"${number}" + ("\\" if replacement[i + m.end() : i + m.end() + 1].isdigit() else "")
                i += m.end() - 1
            else:
                out += r"\$"
        else:
            out += c
        i += 1
    return out


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    """Replace every match.  The pattern is checked when the query is built, not on each row."""
    return F.regexp_replace(text, F.lit(java_pattern(pattern)), F.lit(java_replacement(replacement, pattern)))
