"""Errors of the mapping language and its engine, each with a stable diagnostic code."""

from __future__ import annotations


class MappingError(Exception):
    """Base of all errors a program can cause; ``at`` is a position in its source, where there is one."""

    code = "mapping"

    def __init__(self, message: str, at: int | None = None):
        super().__init__(message)
        self.message, self.at = message, at


class SyntaxFault(MappingError):
    code = "syntax"


class Undefined(MappingError):
    """A name that nothing defines; ``kind`` is variable, type, function, module or provider."""

    code = "undefined"

    def __init__(self, kind: str, name: str, at: int | None = None):
        super().__init__(f"undefined {kind} '{name}'", at)
        self.kind, self.name = kind, name


class AlreadyDefined(MappingError):
    code = "already-defined"

    def __init__(self, name: str, at: int | None = None):
        super().__init__(f"'{name}' is already defined", at)
        self.name = name


class NotA(MappingError):
    """A value or type of the wrong kind, such as a call of what is no function."""

    code = "not-a"

    def __init__(self, wanted: str, name: str, at: int | None = None):
        super().__init__(f"'{name}' is not a {wanted}", at)
        self.wanted, self.name = wanted, name


class TypeMismatch(MappingError):
    code = "type-mismatch"

    def __init__(self, expected: object, actual: object, at: int | None = None):
        super().__init__(f"expected {expected}, found {actual}", at)
        self.expected, self.actual = expected, actual


class ArityMismatch(MappingError):
    code = "arity-mismatch"

    def __init__(self, what: str, expected: int, actual: int, at: int | None = None):
        super().__init__(f"{what} takes {expected}, {actual} given", at)
        self.expected, self.actual = expected, actual


class InfiniteType(MappingError):
    code = "infinite-type"


class FieldNotFound(MappingError):
    code = "field-not-found"

    def __init__(self, field: str, owner: str, at: int | None = None):
        super().__init__(f"no field '{field}' in {owner}", at)
        self.field, self.owner = field, owner


class RecordSizeMismatch(MappingError):
    code = "record-size-mismatch"

    def __init__(self, expected: int, actual: int, at: int | None = None):
        super().__init__(f"a record of {expected} fields is expected, one of {actual} found", at)


class EvaluationFault(MappingError):
    code = "evaluation"


class MissingArgument(MappingError):
    code = "missing-argument"

    def __init__(self, name: str, owner: str, at: int | None = None):
        super().__init__(f"{owner} needs the argument '{name}'", at)
        self.name = name


class InvalidArgument(MappingError):
    code = "invalid-argument-type"


class SourceNotFound(MappingError):
    code = "file-not-found"


class NotAFile(MappingError):
    code = "not-a-file"


class InvalidExtension(MappingError):
    code = "invalid-extension"


class ReadFault(MappingError):
    code = "read-error"


class ParseFault(MappingError):
    """A source file (shapes, STEP) that can't be parsed."""

    code = "parse-error"


class DataFault(MappingError):
    code = "data-error"


class ProviderKind(MappingError):
    """A data provider used for a type, or a schema provider for a value."""

    code = "provider-kind-mismatch"


class CompileErrors(Exception):
    """All errors found in one program, in order of position."""

    def __init__(self, errors: list[MappingError]):
        self.errors = sorted(errors, key=lambda e: -1 if e.at is None else e.at)
        super().__init__("; ".join(e.message for e in self.errors))
