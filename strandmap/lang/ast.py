"""Syntax tree.  ``at`` is the offset of a node in the source text."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Node:
    at: int


@dataclass
class Literal(Node):
    value: int | bool | str


@dataclass
class Unit(Node):
    pass


@dataclass
class Interpolation(Node):
    parts: list[str | Name | Access]


@dataclass
class Name(Node):
    """A possibly dotted name; what its first part means decides how it is read."""

    parts: list[str]

    def __str__(self) -> str:
        return ".".join(self.parts)


@dataclass
class Access(Node):
    value: Expr
    field: str


@dataclass
class Argument(Node):
    name: str | None
    value: Expr


@dataclass
class Call(Node):
    callee: Name
    args: list[Argument]


@dataclass
class Construct(Node):
    type: Name
    args: list[Argument]
    spread: Expr | None
    fields: list[Argument]


@dataclass
class Ref(Node):
    type: Name
    args: list[Argument]


@dataclass
class Provider(Node):
    name: str
    args: list[Argument]


@dataclass
class Each(Node):
    binder: str
    body: Expr


@dataclass
class Projection(Node):
    source: Expr
    outputs: list[Each]


@dataclass
class Join(Node):
    left: Expr
    right: Expr
    left_on: list[str]
    right_on: list[str]
    suffix: str


Expr = Literal | Unit | Interpolation | Name | Access | Call | Construct | Ref | Provider | Projection | Join


@dataclass
class TypeName(Node):
    """A type as written: a name, or a provider call, perhaps optional."""

    name: str
    optional: bool = False
    provider: Provider | None = None


@dataclass
class Attribute(Node):
    space: str
    positional: list[object]
    named: dict[str, object]


@dataclass
class FieldDef(Node):
    name: str
    type: TypeName
    attributes: list[Attribute] = field(default_factory=list)


@dataclass
class Let(Node):
    name: str
    value: Expr


@dataclass
class TypeDef(Node):
    name: str
    params: list[FieldDef]
    attributes: list[Attribute]
    fields: list[FieldDef] | None
    alias: TypeName | None


@dataclass
class Statement(Node):
    value: Expr
