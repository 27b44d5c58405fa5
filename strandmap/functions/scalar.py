"""Literals, interpolation, references and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.types import BOOL, FLOAT, INT, SPARK_TYPES, STRING, Record, strip


def column(value: object) -> Column:
    """A column as it is, anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def text(value: object) -> Column:
    return column(value).cast("string")


def interpolate(*parts: object) -> Column:
    """All parts as one string; nulls are skipped, so a string of nulls only is empty."""
    return F.concat_ws("", *[text(p) for p in parts])


def ref(record: Record, *args: object) -> Column:
    """The subject that ``record`` gives a row with this first constructor argument; null without arguments."""
    if not args:
        return F.lit(None).cast("string")
    return F.concat_ws("", F.lit(record.base), text(args[0])) if record.base else text(args[0])


#: Text that a number can be read from, blanks and controls around it left aside.  Casts of other text would throw and catch an exception for each cell.
_AROUND = r"[\x00-\x20\x7f]*"
NUMERIC = {
    INT: rf"^{_AROUND}[+-]?[0-9]+{_AROUND}$",
    FLOAT: rf"^{_AROUND}(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity)|(?i:nan)){_AROUND}$",
}


def to_declared(value: Column, declared: object, given: T.DataType | None = None) -> Column:
    """value cast to a declared primitive, null where it can't be; strings and records are left alone.

    Integers are cut towards zero.  A string is a boolean only if it reads true or false.  ``given`` is the type of value,
    where it is known: text is looked at before it is cast.
    """
    kind = strip(declared)
    if kind == STRING or kind not in SPARK_TYPES:
        return value
    if kind == BOOL:
        as_text = F.lower(value.cast("string"))
        return F.when(as_text.isin("true", "false"), as_text == "true")
    if isinstance(given, T.StringType) and kind in NUMERIC:
        return F.when(value.rlike(NUMERIC[kind]), value.try_cast(SPARK_TYPES[kind]))
    return value.try_cast(SPARK_TYPES[kind])
