"""Command line: ``python -m strandmap compile -p FILE`` and ``python -m strandmap run -p FILE``."""

from __future__ import annotations

import argparse
import sys

from strandmap.errors import CompileErrors, MappingError
from strandmap.lang.compiler import compile_program


def place(source: str, at: int | None) -> str:
    """Line and column of an offset, and the line."""
    if at is None:
        return ""
    line = source.count("\n", 0, at) + 1
    start = source.rfind("\n", 0, at) + 1
    text = source[start:].split("\n", 1)[0]
    return f"{line}:{at - start + 1}\n  {text}\n  {' ' * (at - start)}^"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandmap", description="Declarative mapping of tables to graphs.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("compile", "run"):
        c = commands.add_parser(name)
        c.add_argument("-p", "--path", required=True)
        c.add_argument("--master", default=None, help="Spark master; the session's default without it")
    args = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    source = ""
    try:
        spark = None
        if args.command == "run" or "://" in args.path:
            builder = SparkSession.builder.appName("strandmap")
            spark = (builder.master(args.master) if args.master else builder).getOrCreate()
        if "://" not in args.path:
            with open(args.path, encoding="utf-8") as f:
                source = f.read()
        program = compile_program(args.path, spark=spark)
        for w in program.warnings:
            print(f"warning: {w}", file=sys.stderr)
        if args.command == "run":
            program.run(spark)
        return 0
    except CompileErrors as e:
        first = e.errors[0]
        print(f"error[{first.code}]: {first.message}\n{args.path}:{place(source, first.at)}", file=sys.stderr)
    except (MappingError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
    return 1
