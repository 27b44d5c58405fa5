"""A reader for STEP physical files (ISO 10303-21): entities ``#id=NAME(attributes);``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from strandmap.errors import ParseFault


@dataclass(frozen=True)
class Ref:
    id: int


@dataclass(frozen=True)
class Enum:
    name: str


@dataclass(frozen=True)
class Typed:
    name: str
    values: tuple


class _Derived:
    def __repr__(self) -> str:
        return "*"


DERIVED = _Derived()

# No part of a text can be matched in two ways, so a cut-off file takes no longer than a whole one.
_BLANK = r"(?:\s|/\*.*?\*/)*+"
_SKIP = re.compile(_BLANK, re.S)
#: What a search for entities meets: a string or a comment, each to its end or to that of the file, or the start of an entity.
_NEXT = re.compile(rf"'[^']*+'?|/\*(?:.*?\*/|.*)|#(\d++){_BLANK}={_BLANK}([A-Za-z_][A-Za-z0-9_]*+){_BLANK}\(", re.S)
_STRING = re.compile(r"'((?:[^']++|'')*+)'", re.S)
_NUMBER = re.compile(r"[+-]?\d+(?:(\.\d*)?(?:[eE][+-]?\d+)?)")
_ENUM = re.compile(r"\.([A-Za-z0-9_]+)\.")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_BINARY = re.compile(r'"([0-9A-Fa-f]*)"')
_CODED = re.compile(r"\\X2\\((?:[0-9A-Fa-f]{4})+)\\X0\\|\\X4\\((?:[0-9A-Fa-f]{8})+)\\X0\\|\\X\\([0-9A-Fa-f]{2})|\\S\\(.)|(\\\\)")


def decoded(raw: str) -> str:
    """Text of a STEP string: doubled quotes and the standard's character codes."""

    def one(m: re.Match) -> str:
        if m[1]:
            return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
        if m[2]:
            return bytes.fromhex(m[2]).decode("utf-32-be", "replace")
        if m[3]:
            return chr(int(m[3], 16))
        return chr(ord(m[4]) + 128) if m[4] else "\\"

    text = raw.replace("''", "'")
    return _CODED.sub(one, text) if "\\" in text else text


class _Reader:
    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def skip(self) -> str:
        self.at = _SKIP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self, pattern: re.Pattern) -> re.Match:
        m = pattern.match(self.text, self.at)
        if not m:
            raise ParseFault(f"unexpected '{self.text[self.at : self.at + 20]}' in a STEP file", self.at)
        self.at = m.end()
        return m

    def items(self) -> tuple:
        """Values up to the closing bracket; the opening one has been read."""
        out = []
        if self.skip() == ")":
            self.at += 1
            return ()
        while True:
            out.append(self.value())
            c = self.skip()
            self.at += 1
            if c == ")":
                return tuple(out)
            if c != ",":
                raise ParseFault(f"',' or ')' is expected in a STEP file, not '{c}'", self.at)

    def value(self):
        c = self.skip()
        if c == "'":
            return decoded(self.take(_STRING)[1])
        if c == "$":
            self.at += 1
            return None
        if c == "*":
            self.at += 1
            return DERIVED
        if c == "#":
            self.at += 1
            return Ref(int(self.take(_NUMBER)[0]))
        if c == "(":
            self.at += 1
            return list(self.items())
        if c == ".":
            return Enum(self.take(_ENUM)[1])
        if c == '"':
            return bytes.fromhex(self.take(_BINARY)[1].zfill(2))
        if c.isalpha() or c == "_":
            name = self.take(_NAME)[0]
            self.skip()
            self.take(re.compile(r"\("))
            return Typed(name, self.items())
        m = self.take(_NUMBER)
        return float(m[0]) if re.search(r"[.eE]", m[0]) else int(m[0])


def entities(text: str, kind: str) -> Iterator[tuple[int, tuple]]:
    """(id, attributes) of every entity of a type, in order; the type's case doesn't matter.

    Complex entities are passed over, and so is what stands in strings and comments.  An entity of the type that is cut off is an error.
    """
    wanted, at = kind.upper(), 0
    while True:
        m = _NEXT.search(text, at)
        if not m:
            return
        at = m.end()
        if m[2] and m[2].upper() == wanted:
            r = _Reader(text, at)
            yield int(m[1]), r.items()
            at = r.at


def as_string(value: object, enums: bool = False) -> str | None:
    """A string, also inside a typed value; with ``enums`` an enumeration's name too.  Anything else is null."""
    if isinstance(value, str):
        return value
    if isinstance(value, Typed) and len(value.values) == 1:
        return as_string(value.values[0], enums)
    return value.name if enums and isinstance(value, Enum) else None


def as_float(value: object) -> float | None:
    """A number as a float; anything else is null."""
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
