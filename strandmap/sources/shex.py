"""Record types from ShEx compact syntax (ShExC): prefixes, shapes, triple constraints, facets, cardinalities, references."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urljoin

from strandmap.errors import ParseFault, Undefined
from strandmap.plans.terms import RDF_TYPE
from strandmap.types import BOOL, FLOAT, INT, STRING, XSD, Constraints, Field, Named, Optional, Record

# Language type of each XSD datatype; others are strings.
_DATATYPES = {
    INT: "integer int long short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte",
    FLOAT: "double float decimal",
    BOOL: "boolean",
}
TYPE_OF = {XSD + n: t for t, names in _DATATYPES.items() for n in names.split()}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*|/\*.*?\*/)
      | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
      | (?P<regex>/(?:[^/\\\n]|\\.)+/[smix]*)
      | (?P<annotation>//)
      | (?P<string>\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?P<lang>@[A-Za-z-]+)?
      | (?P<card>\{\s*\d+\s*(?:,\s*(?:\d+|\*)?\s*)?\})
      | (?P<code>%(?:<[^>]*>|[\w:.-]*)\{.*?%\}|%(?:<[^>]*>|[\w:.-]*)%)
      | (?P<bnode>_:[\w.-]*\w)
      | (?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      | (?P<ref>@)
      | (?P<name>(?:[A-Za-z][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]*[\w:%-])?)?|[A-Za-z]\w*)
      | (?P<mark>\^\^|[{}()\[\];|?*+,.=$&~!^-])""",
    re.X | re.S,
)


@dataclass
class Triple:
    predicate: str
    value: object = None  # a Shape, ("ref", IRI), ("datatype", IRI), ("values", [IRI...]) or None
    minimum: int = 1
    constraints: Constraints = field(default_factory=Constraints)
    inverse: bool = False


@dataclass
class Shape:
    kind: str  # shape, and, or, ref, other
    triples: list[Triple] = field(default_factory=list)
    parts: list[Shape] = field(default_factory=list)
    ref: str = ""
    node: Triple | None = None  # datatype and facets of a node constraint


def local_name(iri: str) -> str:
    """After the last #, or else the last /."""
    return iri.rpartition("#" if "#" in iri else "/")[2]


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseFault(f"unexpected '{text[at : at + 20]}' in a shape schema", at)
            kind = m.lastgroup if m.lastgroup != "lang" else "string"
            if kind != "skip":
                self.tokens.append((kind, m[kind], at))
            at = m.end()
        self.i, self.base, self.prefixes, self.shapes = 0, "", {}, {}

    # --- tokens ---

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0] if self.i < len(self.tokens) else "end"

    @property
    def word(self) -> str:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else ""

    def next(self) -> str:
        if self.i >= len(self.tokens):
            raise ParseFault("a shape schema ends too early")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def take(self, word: str) -> bool:
        if self.word.upper() == word and self.kind in ("name", "mark"):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ParseFault(f"'{word}' is expected in a shape schema, not '{self.word}'")

    def iri(self) -> str:
        if self.kind == "iri":
            return self.resolved(self.next()[1:-1])
        word = self.next()
        if word == "a":
            return RDF_TYPE
        prefix, colon, name = word.partition(":")
        if not colon or prefix not in self.prefixes:
            raise ParseFault(f"unknown prefix in '{word}'")
        return self.prefixes[prefix] + name

    def resolved(self, iri: str) -> str:
        """An absolute IRI as it is (also with an empty fragment, which joining would drop), a relative one by the base."""
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) or not self.base else urljoin(self.base, iri)

    def label(self) -> str:
        return self.next() if self.kind == "bnode" else self.iri()

    # --- grammar ---

    def schema(self) -> dict[str, Shape]:
        while self.kind != "end":
            if self.take("PREFIX"):
                prefix = self.next()
                self.prefixes[prefix.rstrip(":")] = self.iri()
            elif self.take("BASE"):
                self.base = self.resolved(self.next()[1:-1])
            elif self.take("IMPORT"):
                self.iri()
            elif self.take("START"):
                self.need("=")
                self.expression()
            elif self.kind == "code":
                self.i += 1
            else:
                self.take("ABSTRACT")
                label = self.label()
                if self.take("EXTERNAL"):
                    continue
                self.shapes[label] = self.expression()
        return self.shapes

    def expression(self) -> Shape:
        """OR of ANDs of optionally negated atoms."""
        ors = [self.conjunction()]
        while self.take("OR"):
            ors.append(self.conjunction())
        return ors[0] if len(ors) == 1 else Shape("or", parts=ors)

    def conjunction(self) -> Shape:
        ands = [self.negation()]
        while self.take("AND"):
            ands.append(self.negation())
        return ands[0] if len(ands) == 1 else Shape("and", parts=ands)

    def negation(self) -> Shape:
        if self.take("NOT"):
            self.atom()
            return Shape("other")
        return self.atom()

    def atom(self) -> Shape:
        """A reference, a bracketed expression, or a node constraint and a shape."""
        if self.kind == "ref":
            self.i += 1
            return Shape("ref", ref=self.label())
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.take("."):
            return Shape("other")
        node = self.node_constraint()
        own = None
        while self.kind == "name" and self.word.upper() in ("EXTRA", "CLOSED", "EXTENDS"):
            word = self.next().upper()
            while word != "CLOSED" and (self.kind == "iri" or ":" in self.word or self.word == "a" or self.kind == "ref"):
                self.i += self.kind == "ref"
                self.iri()
        if self.take("{"):
            own = Shape("shape", triples=self.triples())
            self.need("}")
            self.annotations()
        if node and own:
            return Shape("and", parts=[Shape("other", node=node), own])
        if own or node:
            return own or Shape("other", node=node)
        raise ParseFault(f"a shape is expected, not '{self.word}'")

    def node_constraint(self) -> Triple | None:
        """Kind, datatype, value set and facets."""
        out, found = Triple(""), False
        if self.kind == "name" and self.word.upper() in ("IRI", "LITERAL", "BNODE", "NONLITERAL"):
            self.i += 1
            found = True
        elif self.kind == "iri" or (self.kind == "name" and ":" in self.word):
            out.value, found = ("datatype", self.iri()), True
        elif self.take("["):
            values = []
            while not self.take("]"):
                if self.kind == "iri" or (self.kind == "name" and ":" in self.word):
                    values.append(self.iri())
                else:
                    self.next()
            out.value, found = ("values", values), True
        while True:
            word = self.word.upper()
            if self.kind == "regex":
                out.constraints.pattern, found = self.pattern(self.next()), True
            elif word in ("MINLENGTH", "MAXLENGTH"):
                self.i += 1
                setattr(out.constraints, "min_length" if word == "MINLENGTH" else "max_length", int(self.next()))
                found = True
            elif word == "PATTERN":
                self.i += 1
                raw = self.next()
                out.constraints.pattern, found = self.pattern(raw) if raw[0] == "/" else raw[1:-1].replace('\\"', '"').replace("\\\\", "\\"), True
            elif word in ("LENGTH", "MININCLUSIVE", "MINEXCLUSIVE", "MAXINCLUSIVE", "MAXEXCLUSIVE", "TOTALDIGITS", "FRACTIONDIGITS"):
                self.i += 1
                self.next()
                found = True
            else:
                return out if found else None

    @staticmethod
    def pattern(raw: str) -> str:
        body, flags = raw[1:].rsplit("/", 1)
        body = body.replace("\\/", "/")
        return f"(?{flags}){body}" if flags else body

    def triples(self) -> list[Triple]:
        """All triple constraints of a triple expression; the branches of a choice count alike."""
        out: list[Triple] = []
        while self.word not in ("}", ")") and self.kind != "end":
            if self.take(";") or self.take(",") or self.take("|"):
                continue
            if self.take("$"):
                self.label()
            if self.take("&"):
                self.label()
                continue
            if self.take("("):
                inner = self.triples()
                self.need(")")
                least = self.cardinality()
                for t in inner:
                    t.minimum = min(t.minimum, least)
                out += inner
                self.annotations()
                continue
            inverse = self.take("^")
            predicate = self.iri()
            out.append(self.constraint(predicate, inverse))
        return out

    def constraint(self, predicate: str, inverse: bool) -> Triple:
        value = self.expression()
        node = value.node
        if value.kind == "and":
            node = next((p.node for p in value.parts if p.node), None)
        t = Triple(predicate, inverse=inverse)
        if node:
            t.value, t.constraints = node.value, node.constraints
        if t.value is None and (target := self._reference(value)):
            t.value = ("ref", target)
        t.minimum = self.cardinality()
        self.annotations()
        return t

    @staticmethod
    def _reference(value: Shape) -> str | None:
        if value.kind == "ref":
            return value.ref
        if value.kind in ("and", "or"):
            return next((p.ref for p in value.parts if p.kind == "ref"), None)
        return None

    def cardinality(self) -> int:
        if self.take("?") or self.take("*"):
            return 0
        if self.take("+"):
            return 1
        if self.kind == "card":
            return int(re.search(r"\d+", self.next())[0])
        return 1

    def annotations(self) -> None:
        while self.kind in ("annotation", "code"):
            if self.kind == "annotation":
                self.i += 1
                self.iri()
                self.next()
                if self.take("^^"):
                    self.iri()
            else:
                self.i += 1


def parse(text: str) -> dict[str, Shape]:
    """Shapes by label."""
    return _Parser(text).schema()


def find(shapes: dict[str, Shape], name: str) -> str:
    """The first label whose local name is the wanted one, or that ends with it."""
    for label in shapes:
        if local_name(label) == name or label.endswith(name):
            return label
    raise Undefined("shape", name)


def flat(shapes: dict[str, Shape], shape: Shape, seen: frozenset[str] = frozenset()) -> list[Triple]:
    """Triples of a shape: all parts of an AND, the first alternative of an OR, what a reference names."""
    if shape.kind == "shape":
        return shape.triples
    if shape.kind == "and":
        return [t for p in shape.parts for t in flat(shapes, p, seen)]
    if shape.kind == "or":
        return flat(shapes, shape.parts[0], seen)
    if shape.kind == "ref" and shape.ref in shapes and shape.ref not in seen:
        return flat(shapes, shapes[shape.ref], seen | {shape.ref})
    return []


def record(text: str, shape: str, name: str, params: list[tuple[str, object]] | None = None, types: dict[str, str] | None = None) -> Record:
    """The record type of one shape.  ``types`` gives the names of the types that other shapes' IRIs stand for."""
    shapes = parse(text)
    label = find(shapes, shape)
    out = Record(name, params=list(params or []), identity=label)
    for t in flat(shapes, shapes[label]):
        kind, value = t.value if isinstance(t.value, tuple) else ("", None)
        if t.predicate == RDF_TYPE:
            if kind == "values" and value:
                out.rdf_type = value[0]
            continue
        own: object = STRING
        if kind == "datatype":
            own = TYPE_OF.get(value, STRING)
        elif kind == "ref":
            own = Named((types or {}).get(value, local_name(value)))
        out.fields.append(Field(local_name(t.predicate), Optional(own) if t.minimum == 0 else own, t.predicate, t.constraints))
    out.__post_init__()
    return out
