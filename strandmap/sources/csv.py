"""CSV: schema by a sample of 100 rows, and a scan that holds every later row to it."""

from __future__ import annotations

import csv
import re
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandmap.errors import DataFault, InvalidArgument
from strandmap.sources import paths
from strandmap.types import BOOL, FLOAT, INT, SPARK_TYPES, STRING, Field, Optional, Record

#: Rows that types are inferred from.
SAMPLE = 100
_BOOL = re.compile(r"(?i)\A(?:true|false)\Z")
_INT = re.compile(r"\A[+-]?\d+\Z")
_FLOAT = re.compile(r"\A[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?\Z|\A[+-]?(?:inf|NaN)\Z")


def infer(values: list[str | None]):
    """Type of sampled cells: bool, int, float or string; empty cells don't count, and a column of them is string."""
    cells = [v for v in values if v not in (None, "")]
    if not cells:
        return STRING
    if all(_BOOL.match(v) for v in cells):
        return BOOL
    if all(_INT.match(v) and -(1 << 63) <= int(v) < 1 << 63 for v in cells):
        return INT
    if all(_FLOAT.match(v) for v in cells):
        return FLOAT
    return STRING


def delimiter_of(delimiter: str) -> str:
    if not isinstance(delimiter, str) or not delimiter:
        raise InvalidArgument("the delimiter must be a string of one character at least")
    return delimiter[0]


def sample(path: str, spark: SparkSession | None, delimiter: str, has_header: bool) -> tuple[list[str], list[list[str | None]]]:
    """Column names and up to SAMPLE rows as strings."""
    n = SAMPLE + has_header
    if paths.is_local(path):
        try:
            with open(path, encoding="utf-8", newline="") as f:
                rows = [r for r in islice((r for r in csv.reader(f, delimiter=delimiter) if r), n)]
        except (OSError, UnicodeDecodeError, csv.Error) as e:
            raise DataFault(f"'{path}' can't be read as CSV: {e}") from e
    else:
        session = spark or SparkSession.getActiveSession()
        found = session.read.csv(path, sep=delimiter, quote='"', escape='"', header=False, inferSchema=False).limit(n).collect()
        rows = [list(r) for r in found]
    if not rows:
        raise DataFault(f"'{path}' is empty")
    names = [c or f"column_{i}" for i, c in enumerate(rows[0], 1)] if has_header else [f"column_{i}" for i in range(1, len(rows[0]) + 1)]
    names[0] = names[0].removeprefix("\ufeff")
    return names, rows[1:] if has_header else rows


def record(path: str, name: str, spark: SparkSession | None = None, delimiter: str = ",", has_header: bool = True) -> Record:
    """The record type of a CSV file."""
    names, rows = sample(path, spark, delimiter_of(delimiter), has_header)
    columns = [[r[i] if i < len(r) else None for r in rows] for i in range(len(names))]
    return Record(name, [Field(n, Optional(t) if (t := infer(c)) is not STRING and any(v in (None, "") for v in c) else t) for n, c in zip(names, columns, strict=True)])


def load(path: str, schema: Record, spark: SparkSession, delimiter: str = ",", has_header: bool = True, multiline: bool = False) -> DataFrame:
    """A lazy scan; a row that doesn't fit the types fails it rather than becoming null.

    ``multiline`` lets quoted cells hold line breaks; a file is then read by one task.
    """
    types = T.StructType([T.StructField(f.name, SPARK_TYPES[getattr(f.type, "inner", f.type)]) for f in schema.fields])
    return spark.read.schema(types).csv(
        path, sep=delimiter_of(delimiter), quote='"', escape='"', header=has_header, mode="FAILFAST", multiLine=multiline, enforceSchema=True
    )
