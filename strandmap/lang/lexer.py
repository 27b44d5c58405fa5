"""Tokens.  White space (carriage returns too) and ``//`` comments are skipped; strings are taken as they are written."""

from __future__ import annotations

import re
from dataclasses import dataclass

from strandmap.errors import SyntaxFault

# The words of the language.
KEYWORDS = frozenset("let type do end each join on suffix ref true false int float bool string".split())

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n\f]+|//[^\n]*)
      | (?P<string>"[^"]*")
      | (?P<int>\d+)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<mark>\|>|\+>|->|\#\[|\.\.|[(){}\]=:,.!?])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # string, int, name, keyword, mark, end
    text: str
    at: int


def tokens(source: str) -> tuple[list[Token], list[SyntaxFault]]:
    """All tokens, and a fault for every character that starts none."""
    out, faults, at = [], [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            faults.append(SyntaxFault(f"unexpected '{source[at]}'", at))
            at += 1
            continue
        kind, text = m.lastgroup, m[0]
        if kind == "word":
            kind = "keyword" if text in KEYWORDS else "name"
        if kind == "string":
            text = text[1:-1]
        if kind != "skip":
            out.append(Token(kind, text, at))
        at = m.end()
    out.append(Token("end", "end of the program", len(source)))
    return out, faults
