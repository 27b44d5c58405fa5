"""A frame: source rows and the record outputs made of each of them.

The source view is the DataFrame that outputs read; the mapped view has the fields of the last output.  Validation,
reports, joins and further projections use the mapped view; RDF output makes one pass over the source view for all
outputs.  Nothing is computed or cached before a sink asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.errors import ArityMismatch, EvaluationFault, FieldNotFound
from strandmap.types import Output, Record


class Row:
    """What ``each`` binds: its attributes and items are the columns of the frame."""

    def __init__(self, names: Sequence[str]):
        self._names = list(names)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise FieldNotFound(name, "row")
        return F.col(f"`{name}`")


@dataclass
class Frame:
    source: DataFrame
    outputs: list[Output] = field(default_factory=list)
    record: Record | None = None
    """Type of the rows of the source view, where it has a name."""

    @staticmethod
    def empty(spark: SparkSession, record: Record) -> Frame:
        """No rows of a record type."""
        return Frame(spark.createDataFrame([], record.schema()), record=record)

    # --- views ---

    def mapped(self) -> DataFrame:
        """Fields of the last output, or the source rows where there is none."""
        if not self.outputs:
            return self.source
        return self.source.select(*[c.alias(n) for n, c in self.outputs[-1].values])

    @property
    def columns(self) -> list[str]:
        return [n for n, _ in self.outputs[-1].values] if self.outputs else self.source.columns

    def view(self) -> Frame:
        """The mapped view as a frame without outputs."""
        return Frame(self.mapped(), [], self.outputs[-1].record if self.outputs else self.record) if self.outputs else self

    def row(self) -> Row:
        return Row(self.columns)

    # --- projections ---

    def each(self, *make: Callable[[Row], Output] | Output) -> Frame:
        """A projection with one or several outputs over the same rows; a frame that already has outputs is read by its mapped view."""
        base = self.view()
        row = base.row()
        outputs = [m(row) if callable(m) and not isinstance(m, Output) else m for m in make]
        for o in outputs:
            if not isinstance(o, Output):
                raise EvaluationFault("each must make a record")
        return replace(base, outputs=outputs)

    def also(self, *make: Callable[[Row], Output] | Output) -> Frame:
        """Further outputs over the rows that the frame's outputs read."""
        if not self.outputs:
            return self.each(*make)
        row = Row(self.source.columns)
        more = [m(row) if callable(m) and not isinstance(m, Output) else m for m in make]
        return replace(self, outputs=[*self.outputs, *more])

    def spread(self, record: Record, *args: Column, **values: Column) -> Frame:
        """Each row as a record: fields that aren't given are the columns of their names and come first."""
        base = self.view()
        out = record.make(list(args), list(values.items()), spread=True)
        for f in record.fields:
            if f.name not in values and f.name not in base.columns:
                raise FieldNotFound(f.name, "row")
        return replace(base, outputs=[out])

    # --- joins ---

    def join(self, right: Frame, left_on: str | Sequence[str], right_on: str | Sequence[str], suffix: str = "_right") -> Frame:
        """Inner equi-join of the mapped views on one or several columns.

        All columns of both sides stay, keys too; right ones whose name the left has get the suffix.  Null keys
        match nothing.
        """
        l_on, r_on = ([x] if isinstance(x, str) else list(x) for x in (left_on, right_on))
        if len(l_on) != len(r_on):
            raise ArityMismatch("join", len(l_on), len(r_on))
        left, other = self.mapped(), right.mapped()
        for name, frame, side in [(n, left, "left") for n in l_on] + [(n, other, "right") for n in r_on]:
            if name not in frame.columns:
                raise FieldNotFound(name, f"the {side} side of the join")
        names = joined_names(left.columns, other.columns, suffix)
        renamed = other.toDF(*names)
        on = [left[f"`{a}`"] == renamed[f"`{names[other.columns.index(b)]}`"] for a, b in zip(l_on, r_on, strict=True)]
        return Frame(left.join(renamed, reduce(lambda a, b: a & b, on), "inner"))

    # --- filters and extensions ---

    def where(self, condition: Column) -> Frame:
        """Rows of the source view for which a condition over its columns holds; outputs stay."""
        return replace(self, source=self.source.where(condition))

    def validate(self, record: Record | None = None) -> Frame:
        from strandmap.operators.validation import validate

        return validate(self, record)

    def errors(self, record: Record | None = None) -> Frame:
        from strandmap.operators.validation import errors

        return errors(self, record)

    def concat(self, other: Frame) -> Frame:
        """Rows of both mapped views, by column name."""
        return Frame(self.mapped().unionByName(other.mapped()))

    # --- results ---

    def to_quads(self, distinct: bool = False) -> DataFrame:
        from strandmap.plans.quads import quads

        return quads(self, distinct)

    def serialize(self, path: str, **options) -> str:
        from strandmap.sinks.rdf import serialize

        return serialize(self, path, **options)

    def report(self, path: str, **options) -> str:
        from strandmap.sinks.report import write_csv

        return write_csv(self, path, **options)


def joined_names(left: Sequence[str], right: Sequence[str], suffix: str) -> list[str]:
    """Names of the right columns in a join: those that collide get the suffix, again until they don't."""
    out: list[str] = []
    taken = set(left)
    for n in right:
        name = n
        while name in taken or name in out:
            name += suffix or "_right"
        out.append(name)
    return out
