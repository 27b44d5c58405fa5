"""Compile and run programs."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from strandmap.errors import CompileErrors, MappingError
from strandmap.lang.checker import Checker
from strandmap.lang.declare import Declarations
from strandmap.lang.parser import parse
from strandmap.lang.runtime import Evaluator
from strandmap.registry import Registry, Runtime
from strandmap.sinks.output import Outputs
from strandmap.sources import paths
from strandmap.stdlib import standard


@dataclass
class Program:
    """A checked program; ``types`` has the type of each statement."""

    source: str
    statements: list
    types: list[object]
    declared: Declarations
    checker: Checker
    warnings: list[str]
    base: str | None = None

    def run(self, spark: SparkSession, storage: dict[str, str] | None = None) -> list[object]:
        """Values of all statements.  Files appear when the last statement has succeeded; if one fails none does."""
        if storage:
            paths.configure(spark, storage)
        outputs = Outputs(spark)
        # Names of the language differ by case too; plans are analyzed while the program runs.
        folded = spark.conf.get("spark.sql.caseSensitive")
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            values = Evaluator(self.declared, self.checker, Runtime(spark, outputs, self.base, storage or {})).program(self.statements)
            outputs.commit()
        except BaseException:
            outputs.abort()
            raise
        finally:
            spark.conf.set("spark.sql.caseSensitive", folded)
        return values


def compile_text(source: str, registry: Registry | None = None, spark: SparkSession | None = None, base: str | None = None) -> Program:
    """Parse, declare and check a program; `CompileErrors` has all of its errors.  Relative paths are below ``base``."""
    statements, faults = parse(source)
    if faults:
        raise CompileErrors(faults)
    declared = Declarations(registry or standard(), spark, base)
    declared.collect(statements)
    checker = Checker(declared)
    types = checker.program(statements) if not declared.errors else []
    errors: list[MappingError] = [*declared.errors, *checker.errors]
    if errors:
        raise CompileErrors(errors)
    return Program(source, statements, types, declared, checker, declared.warnings, base)


def compile_program(path: str, registry: Registry | None = None, spark: SparkSession | None = None, base: str | None = None) -> Program:
    return compile_text(paths.read_text(path, spark), registry, spark, base)


def run_text(source: str, spark: SparkSession, registry: Registry | None = None, base: str | None = None) -> list[object]:
    return compile_text(source, registry, spark, base or os.getcwd()).run(spark)
