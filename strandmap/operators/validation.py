"""Row validation by the constraints that a record type's fields declare.

Constraints are checked on the values that the frame's last output gives the fields, in declaration order and within a
field as min_length, max_length, pattern.  Lengths count code points, patterns match anywhere.  A null value makes its
constraint unknown: such a row is neither valid nor, unless another constraint fails, an error.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmap.errors import EvaluationFault, FieldNotFound
from strandmap.functions.scalar import text
from strandmap.functions.strings import checked
from strandmap.operators.frame import Frame
from strandmap.types import VALIDATION_ERROR, Field, Record


def _value(frame: Frame, name: str) -> Column:
    if frame.outputs:
        value = frame.outputs[-1].value(name)
    else:
        value = F.col(f"`{name}`") if name in frame.source.columns else None
    if value is None:
        raise FieldNotFound(name, "the validated rows")
    return text(value)


def holds(value: Column, name: str, expected: object) -> Column:
    if name == "min_length":
        return F.char_length(value) >= F.lit(expected)
    if name == "max_length":
        return F.char_length(value) <= F.lit(expected)
    return value.rlike(checked(str(expected)))


def checks(frame: Frame, record: Record | None) -> tuple[Record, list[tuple[Field, str, object, Column, Column]]]:
    """(field, constraint, expected, value, condition) of each constraint, in order."""
    record = record or (frame.outputs[-1].record if frame.outputs else frame.record)
    if record is None:
        raise EvaluationFault("validation needs rows of a record type")
    out = []
    for f in record.constrained():
        v = _value(frame, f.name)
        out += [(f, n, e, v, holds(v, n, e)) for n, e in f.validate.listed()]
    if not out:
        raise EvaluationFault(f"type {record.name} has no constraints")
    return record, out


def validate(frame: Frame, record: Record | None = None) -> Frame:
    """Rows for which all constraints are true; outputs stay."""
    _, all_ = checks(frame, record)
    return replace(frame, source=frame.source.where(reduce(lambda a, b: a & b, [c[4] for c in all_])))


def errors(frame: Frame, record: Record | None = None) -> Frame:
    """Rows that violate a constraint, as ``source_type, field, constraint, expected, actual`` of the first one violated."""
    record, all_ = checks(frame, record)
    ok = reduce(lambda a, b: a & b, [c[4] for c in all_])
    first = F.coalesce(
        *[
            F.when(~holds_, F.struct(F.lit(f.name).alias("field"), F.lit(n).alias("constraint"), F.lit(str(e)).alias("expected"), v.alias("actual")))
            for f, n, e, v, holds_ in all_
        ]
    )
    found = frame.source.where(~ok).select(first.alias("_e"))
    return Frame(found.select(F.lit(record.name).alias("source_type"), "_e.field", "_e.constraint", "_e.expected", "_e.actual"), [], VALIDATION_ERROR)
