"""Types of the mapping language: primitives, optionals, nominal records, and the attributes they carry."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import types as T

from strandmap.errors import ArityMismatch, FieldNotFound, InvalidArgument

XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class Prim:
    name: str

    def __str__(self) -> str:
        return self.name


INT, FLOAT, BOOL, STRING = Prim("int"), Prim("float"), Prim("bool"), Prim("string")
UNIT = Prim("()")
PRIMITIVES = {p.name: p for p in (INT, FLOAT, BOOL, STRING)}

# Spark type and XSD datatype of each primitive; a string is a simple literal.
SPARK_TYPES = {INT: T.LongType(), FLOAT: T.DoubleType(), BOOL: T.BooleanType(), STRING: T.StringType()}
DATATYPES = {INT: XSD + "integer", FLOAT: XSD + "double", BOOL: XSD + "boolean"}


@dataclass(frozen=True)
class Optional:
    inner: object

    def __str__(self) -> str:
        return f"{self.inner}?"


@dataclass(frozen=True)
class Named:
    """A record type by its name."""

    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Rows:
    """A structural record: the columns of a frame that has no name of its own, such as a join's."""

    fields: tuple[tuple[str, object], ...]

    def __str__(self) -> str:
        return "{" + ", ".join(f"{n}: {t}" for n, t in self.fields) + "}"


@dataclass(frozen=True)
class Var:
    """A type that is still to be found."""

    name: str

    def __str__(self) -> str:
        return f"'{self.name}"


@dataclass(frozen=True)
class Poly:
    """A type for all values of its variables."""

    variables: frozenset[Var]
    kind: object

    def __str__(self) -> str:
        return str(self.kind)


def strip(t: object) -> object:
    return strip(t.inner) if isinstance(t, Optional) else t


@dataclass
class Attributes:
    """Base of attribute sets; named keys are read, and the first positional literal where a set says so."""

    @classmethod
    def of(cls, named: dict[str, object]):
        known = {f.name: f.metadata.get("key", f.name) for f in fields(cls)}
        return cls(**{n: named[k] for n, k in known.items() if k in named})


@dataclass
class FieldRdf(Attributes):
    uri: str | None = None
    lang: str | None = None


@dataclass
class TypeRdf(Attributes):
    type: str | None = None
    base: str | None = None


@dataclass
class Constraints(Attributes):
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None

    def listed(self) -> list[tuple[str, object]]:
        """(name, expected) in checking order."""
        return [(n, v) for n, v in (("min_length", self.min_length), ("max_length", self.max_length), ("pattern", self.pattern)) if v is not None]


@dataclass
class Field:
    name: str
    type: object = STRING
    uri: str | None = None
    validate: Constraints = field(default_factory=Constraints)
    attributes: dict[str, dict[str, object]] = field(default_factory=dict)
    lang: str | None = None
    """Language tag of the field's literals."""


@dataclass
class Record:
    """A nominal record type.  Calling it makes an `Output`: constructor arguments by position, fields by keyword.

    The first constructor argument is the RDF subject, the second the named graph.
    """

    name: str
    fields: list[Field] = field(default_factory=list)
    params: list[tuple[str, object]] = field(default_factory=list)
    rdf_type: str | None = None
    base: str | None = None
    attributes: dict[str, dict[str, object]] = field(default_factory=dict)
    identity: str | None = None
    """IRI that other schemas refer to this type by."""

    def __post_init__(self):
        for f in self.fields:
            for n, limit in f.validate.listed():
                if n != "pattern" and not (isinstance(limit, int) and 0 <= limit < 1 << 32):
                    raise InvalidArgument(f"{self.name}.{f.name}: {n} must be an integer from 0 to 4294967295")

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise FieldNotFound(name, f"type {self.name}")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES.get(strip(f.type), T.StringType())) for f in self.fields])

    def constrained(self) -> list[Field]:
        return [f for f in self.fields if f.validate.listed()]

    def __call__(self, *args: Column, **values: Column) -> Output:
        return self.make(list(args), list(values.items()))

    def make(self, args: list[Column], values: list[tuple[str, Column]], spread: bool = False) -> Output:
        from pyspark.sql import functions as F

        if len(args) != len(self.params):
            raise ArityMismatch(f"constructor of {self.name}", len(self.params), len(args))
        for n, _ in values:
            self.field(n)
        given = {n for n, _ in values}
        if spread:
            values = [(f.name, F.col(f"`{f.name}`")) for f in self.fields if f.name not in given] + values
        return Output(self, args, values)

    def positional(self, *values: Column) -> Output:
        """An output from one value for each field, in order; only for types without constructor parameters."""
        if len(values) != len(self.fields):
            raise ArityMismatch(f"record {self.name}", len(self.fields), len(values))
        return Output(self, [], list(zip((f.name for f in self.fields), values, strict=True)))


@dataclass
class Output:
    """One record constructor of a projection: its type, constructor arguments and field expressions, in order."""

    record: Record
    args: list[Column]
    values: list[tuple[str, Column]]

    def value(self, name: str) -> Column | None:
        return next((c for n, c in self.values if n == name), None)


#: Rows of `errors`: what was violated first, all as strings.
VALIDATION_ERROR = Record("ValidationError", [Field(n) for n in ("source_type", "field", "constraint", "expected", "actual")])
