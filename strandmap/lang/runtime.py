"""Evaluation of a checked program: expressions become columns and frames; sinks run jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmap.errors import EvaluationFault, FieldNotFound
from strandmap.functions.scalar import column, interpolate, ref
from strandmap.lang import ast
from strandmap.lang.checker import Checker, bind
from strandmap.lang.declare import Declarations
from strandmap.operators.frame import Frame
from strandmap.registry import Runtime
from strandmap.types import Output, Record


@dataclass
class BoundRow:
    """The row that ``each`` binds."""

    names: Sequence[str]

    def get(self, name: str) -> Column:
        if name not in self.names:
            raise FieldNotFound(name, "row")
        return F.col(f"`{name}`")


class Evaluator:
    def __init__(self, declared: Declarations, checker: Checker, runtime: Runtime):
        self.d, self.checker, self.rt = declared, checker, runtime

    def program(self, statements: list) -> list[object]:
        """Values of all statements; ``let`` binds, and a name may be bound again."""
        env: dict[str, object] = {}
        out = []
        for s in statements:
            value = None
            if isinstance(s, ast.Let):
                value = self.d.loads[s.name](self.rt) if isinstance(s.value, ast.Provider) else self.eval(s.value, env)
                env[s.name] = value
            elif isinstance(s, ast.Statement):
                value = self.eval(s.value, env)
            out.append(value)
        return out

    def frame(self, value: object) -> Frame:
        """Rows of a value: a frame's own, or one row."""
        if isinstance(value, Frame):
            return value
        one = self.rt.spark.range(1)
        if isinstance(value, Output):
            if not value.values and not value.args:
                return Frame.empty(self.rt.spark, value.record)
            return Frame(one, [value], value.record)
        if value is None:
            raise EvaluationFault("rows are needed")
        return Frame(one.select(column(value).alias("value")))

    def scalar(self, value: object, at: int) -> Column:
        if isinstance(value, (Frame, Output, BoundRow)) or value is None:
            raise EvaluationFault("a value of one column is needed, not rows", at)
        return column(value)

    # --- expressions ---

    def eval(self, e: ast.Expr, env: dict[str, object]) -> object:
        return getattr(self, "_" + type(e).__name__.lower())(e, env)

    def get(self, value: object, name: str, at: int) -> object:
        if isinstance(value, BoundRow):
            return value.get(name)
        if isinstance(value, Frame):
            return value.row()[name]
        if isinstance(value, Output):
            found = value.value(name)
            return F.lit(None) if found is None else found
        raise EvaluationFault(f"'{name}' can't be read from a value of one column", at)

    def _literal(self, e: ast.Literal, env) -> object:
        return e.value

    def _unit(self, e: ast.Unit, env) -> None:
        return None

    def _interpolation(self, e: ast.Interpolation, env) -> object:
        parts = [p if isinstance(p, str) else self.eval(p, env) for p in e.parts]
        if all(isinstance(p, (str, int)) and not isinstance(p, bool) for p in parts):
            return "".join(map(str, parts))
        return interpolate(*[self.scalar(p, e.at) for p in parts])

    def _name(self, e: ast.Name, env) -> object:
        value = env[e.parts[0]]
        for p in e.parts[1:]:
            value = self.get(value, p, e.at)
        return value

    def _access(self, e: ast.Access, env) -> object:
        return self.get(self.eval(e.value, env), e.field, e.at)

    def _make(self, record: Record, args: list[ast.Argument], fields: list[tuple[str, Column]], env) -> Output:
        return Output(record, [self.scalar(self.eval(a.value, env), a.at) for a in args], fields)

    def _construct(self, e: ast.Construct, env) -> Output:
        record = self.d.records[str(e.type)]
        given = [(f.name, self.scalar(self._field(f.value, env), f.at)) for f in e.fields]
        if e.spread is not None:
            own, names = self.eval(e.spread, env), {n for n, _ in given}
            given = [(f.name, self.scalar(self.get(own, f.name, e.at), e.at)) for f in record.fields if f.name not in names] + given
        return self._make(record, e.args, given, env)

    def _field(self, e: ast.Expr, env) -> object:
        value = self.eval(e, env)
        # A record as a field's value stands for its subject.
        return ref(value.record, *value.args[:1]) if isinstance(value, Output) and value.args else value

    def _call(self, e: ast.Call, env) -> object:
        name = str(e.callee)
        if name in self.d.records and name not in env:
            record = self.d.records[name]
            order = bind(e.args, [f.name for f in record.fields], name)
            values = [self.scalar(self._field(e.args[i].value, env), e.args[i].at) for i in order]
            return Output(record, [], list(zip((f.name for f in record.fields), values, strict=True)))
        f = self.checker.function(e.callee)
        order = bind(e.args, [n for n, _ in f.params], name)
        values = [self.eval(e.args[i].value, env) for i in order]
        values = [self.frame(v) if isinstance(v, Output) else v for v in values]
        return f.call(self.rt, [self.checker.types.get(id(e.args[i].value)) for i in order], *values)

    def _ref(self, e: ast.Ref, env) -> Column:
        record = self.d.records[str(e.type)]
        args = [self.scalar(self.eval(a.value, env), a.at) for a in e.args]
        base = self.d.registry.base_of(record)
        return ref(record if base == record.base else Record(record.name, base=base), *args)

    def _projection(self, e: ast.Projection, env) -> Frame:
        base = self.frame(self.eval(e.source, env)).view()
        outputs = []
        for each in e.outputs:
            made = self.eval(each.body, env | {each.binder: BoundRow(base.columns)})
            if not isinstance(made, Output):
                raise EvaluationFault("each must make a record", each.at)
            outputs.append(made)
        return Frame(base.source, outputs, base.record)

    def _join(self, e: ast.Join, env) -> Frame:
        left, right = self.frame(self.eval(e.left, env)), self.frame(self.eval(e.right, env))
        return left.join(right, e.left_on, e.right_on, e.suffix)
