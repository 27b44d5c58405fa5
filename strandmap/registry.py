"""Extension points: providers, function modules, generators of a type's functions, and how references are resolved."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from strandmap.errors import AlreadyDefined
from strandmap.sources import paths
from strandmap.types import VALIDATION_ERROR, Record

#: Stands for any type in a function's signature.
ANY = "any"


@dataclass
class Runtime:
    """What functions may use while a program runs."""

    spark: SparkSession
    outputs: Any = None
    base: str | None = None
    storage: dict[str, str] = field(default_factory=dict)


@dataclass
class Function:
    """A function of a module: parameter names and types, a result type (or a rule that gives it), and what it does.

    Types may hold variables (`types.Var`), which stand for one type each at every call.

    ``call(runtime, types, *values)`` gets columns and frames and gives one of them, or None.
    """

    params: list[tuple[str, object]]
    result: object | Callable[[list[object]], object]
    call: Callable[..., Any]
    optional: int = 0


@dataclass
class ProviderArg:
    name: str
    kind: type
    default: object = None
    required: bool = False


@dataclass
class ProviderContext:
    """What a provider may use at compile time."""

    registry: Registry
    type_name: str
    params: list[tuple[str, object]]
    spark: SparkSession | None
    base: str | None
    identities: dict[str, str]


@dataclass
class Provided:
    """A record type, and for data providers how its rows are loaded."""

    record: Record
    load: Callable[[Runtime], Any] | None = None


@dataclass
class Provider:
    """A compile-time source of types; ``kind`` is data (for ``let``), schema (for ``type``) or both."""

    kind: str
    args: list[ProviderArg]
    provide: Callable[[ProviderContext, dict[str, object]], Provided]
    identity: Callable[[ProviderContext, dict[str, object]], str | None] | None = None


@dataclass
class Registry:
    providers: dict[str, Provider] = field(default_factory=dict)
    modules: dict[str, dict[str, Function]] = field(default_factory=dict)
    generators: list[Callable[[Record], dict[str, Function]]] = field(default_factory=list)
    records: dict[str, Record] = field(default_factory=lambda: {VALIDATION_ERROR.name: VALIDATION_ERROR})
    read_file: paths.FileReader = paths.read_text
    base_of: Callable[[Record], str | None] = lambda record: record.base

    def provider(self, name: str, provider: Provider) -> None:
        if name in self.providers:
            raise AlreadyDefined(name)
        self.providers[name] = provider

    def module(self, name: str, functions: dict[str, Function]) -> None:
        self.modules.setdefault(name, {}).update(functions)

    def generator(self, make: Callable[[Record], dict[str, Function]]) -> Callable:
        """Functions for every record type; those that it makes none for have none."""
        self.generators.append(make)
        return make
