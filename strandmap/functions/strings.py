"""Regex and case functions on strings.

Patterns are Java regular expressions within the part that linear-time engines share: look-around and back-references
are refused when the expression is built.  Replacements name groups as ``$1``, ``${1}`` or ``${name}``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmap.errors import InvalidArgument
from strandmap.functions.scalar import column, text

_REFUSED = re.compile(r"\\[1-9]|\\k<|\(\?<?[=!]|\(\?>|[*+?}]\+")
_GROUP = re.compile(r"\$(?:\$|\{(\w+)\}|(\w+))")


def checked(pattern: str) -> str:
    """The pattern, if it has no look-around, back-reference, atomic group or possessive quantifier."""
    plain = re.sub(r"\\\\|\[(?:\\.|[^\]\\])*\]", "", pattern)
    if _REFUSED.search(plain):
        raise InvalidArgument(f"the pattern '{pattern}' uses look-around, back-references or possessive parts")
    return pattern.replace("(?P<", "(?<")


def groups(pattern: str) -> list[str | None]:
    """Names of the capture groups of a pattern, null for unnamed ones."""
    out: list[str | None] = []
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", lambda m: "x" * len(m[0]), pattern)
    for m in re.finditer(r"\((?!\?)|\(\?P?<([A-Za-z]\w*)>", plain):
        out.append(m[1])
    return out


def _replacement(rep: str, names: list[str | None], shift: int) -> str:
    """A Java replacement string; group numbers are raised by ``shift``, unknown groups are empty."""
    out, at = [], 0
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    for m in _GROUP.finditer(rep):
        out.append(quote(rep[at : m.start()]))
        at = m.end()
        name = m[1] or m[2]
        if name is None:
            out.append("\\$")
            continue
        n = int(name) if name.isdigit() else names.index(name) + 1 if name in names else None
        if n is not None and n <= len(names):
            # A digit after the group would be read as part of its number.
            after = rep[at : at + 1]
            out.append(f"${n + shift}" if n else ("$2" if shift else "$0"))
            if after.isdigit():
                out.append("\\")
    out.append(quote(rep[at:]))
    return "".join(out)


def _literal(value: object, what: str) -> str:
    if isinstance(value, str):
        return value
    raise InvalidArgument(f"{what} must be a string literal")


def extract(value: object, pattern: str) -> Column:
    """Capture group 1 of the first match, null without a match; an unused group gives an empty string."""
    p, v = checked(_literal(pattern, "the pattern")), text(value)
    if not groups(p):
        raise InvalidArgument(f"the pattern '{pattern}' has no capture group")
    return F.when(v.rlike(p), F.regexp_extract(v, p, 1))


def replace(value: object, pattern: str, replacement: str) -> Column:
    """The first match replaced."""
    p = checked(_literal(pattern, "the pattern"))
    rep = _replacement(_literal(replacement, "the replacement"), groups(p), 2)
    # Everything up to the first match is kept as group 1; group 2 is the match.
    return F.regexp_replace(text(value), rf"\A((?s:.*?))({p})", "$1" + rep)


def replace_all(value: object, pattern: str, replacement: object) -> Column:
    """All matches replaced; the replacement may be a column, whose groups are Java's."""
    p = checked(_literal(pattern, "the pattern"))
    if isinstance(replacement, Column):
        return F.regexp_replace(text(value), F.lit(p), replacement)
    return F.regexp_replace(text(value), p, _replacement(replacement, groups(p), 0))


def upper(value: object) -> Column:
    return F.upper(text(value))


def lower(value: object) -> Column:
    return F.lower(text(value))


def trim(value: object) -> Column:
    return F.trim(text(value))


__all__ = ["checked", "column", "extract", "groups", "lower", "replace", "replace_all", "trim", "upper"]
