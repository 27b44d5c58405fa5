"""Parquet tables as sources; their own schema gives the record type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.errors import EvaluationFault
from strandmap.types import BOOL, FLOAT, INT, STRING, Field, Optional, Record

_TYPES = {"byte": INT, "short": INT, "integer": INT, "long": INT, "float": FLOAT, "double": FLOAT, "decimal": FLOAT, "boolean": BOOL, "string": STRING}


def language_type(t: T.DataType):
    """int, float, bool or string; dates and times are read as strings, nested types not at all (None)."""
    name = t.typeName()
    if name in _TYPES:
        return _TYPES[name]
    return STRING if name in ("date", "timestamp", "timestamp_ntz", "char", "varchar") else None


def record(path: str, name: str, spark: SparkSession | None) -> Record:
    session = spark or SparkSession.getActiveSession()
    if session is None:
        raise EvaluationFault("a Spark session is needed to read a table's schema")
    kinds = [(f.name, language_type(f.dataType)) for f in session.read.parquet(path).schema.fields]
    return Record(name, [Field(n, Optional(t)) for n, t in kinds if t is not None])


def load(path: str, schema: Record, spark: SparkSession) -> DataFrame:
    """The table's columns of the record's fields; times as strings."""
    df = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keep = lambda n: F.col(f"`{n}`").cast("string").alias(n) if language_type(kinds[n]) is STRING and kinds[n] != T.StringType() else F.col(f"`{n}`")
    return df.select(*[keep(f.name) for f in schema.fields])
