"""Type variables of plugged-in functions: unification, occurs check, generalisation."""

import pytest
from pyspark.sql import functions as F

from strandmap.errors import CompileErrors, FieldNotFound, InfiniteType, RecordSizeMismatch, TypeMismatch
from strandmap.lang import compile_text
from strandmap.lang.unify import Unifier, free
from strandmap.registry import ANY, Function
from strandmap.stdlib import standard
from strandmap.types import BOOL, INT, STRING, Named, Optional, Poly, Rows, Var

A, B = Var("a"), Var("b")


def rows(**fields):
    return Rows(tuple(fields.items()))


def unifier():
    def fields(kind, at):
        assert isinstance(kind, Rows), kind
        return list(kind.fields)

    return Unifier(fields)


def test_variables_are_found_through_records_and_optionals():
    u = unifier()
    u.unify(rows(x=A, y=B), rows(y=Optional(STRING), x=B), None)
    assert u.resolved(A) == STRING == u.resolved(B) and u.resolved(rows(z=Optional(A))) == rows(z=Optional(STRING))
    u.unify(A, Optional(STRING), None)
    u.unify(ANY, Named("T"), None)
    for a, b, error in ((A, INT, TypeMismatch), (rows(x=INT), rows(x=INT, y=INT), RecordSizeMismatch), (rows(x=INT), rows(z=INT), FieldNotFound), (rows(x=INT), rows(x=BOOL), TypeMismatch), (INT, rows(x=INT), TypeMismatch)):
        with pytest.raises(error):
            u.unify(a, b, None)


def test_a_type_never_holds_itself():
    u = unifier()
    u.unify(A, rows(x=B), None)
    with pytest.raises(InfiniteType):
        u.unify(B, rows(y=Optional(A)), None)
    u.unify(A, A, None)


def test_generalisation_leaves_what_the_environment_holds():
    u = unifier()
    assert u.general(INT, []) == INT and u.general(A, []) == Poly(frozenset([A]), A)
    assert u.general(rows(x=A, y=B), [A]) == Poly(frozenset([B]), rows(x=A, y=B))
    (one,) = u.instance([rows(x=A, y=B)], [B])
    (two,) = u.instance([rows(x=A, y=B)], [B])
    assert free(one) & free(two) == {A} and len(free(one)) == 2 and free(Poly(frozenset([A]), rows(x=A, y=B))) == {B}


def registry():
    r = standard()
    r.module(
        "Own",
        {
            "same": Function([("x", A), ("y", A)], A, lambda rt, types, x, y: F.coalesce(x, y)),
            "pair": Function([("x", A), ("y", B)], rows(first=A, second=B), lambda rt, types, x, y: x),
            "none": Function([], A, lambda rt, types: F.lit(None)),
            "open": Function([], rows(x=A), lambda rt, types: None),
            "inner": Function([("x", A)], rows(of=A), lambda rt, types, x: x),
        },
    )
    return r


def errors(source):
    with pytest.raises(CompileErrors) as e:
        compile_text(source, registry=registry())
    return e.value.errors


def test_calls_have_variables_of_their_own():
    types = compile_text('let a = Own.same(1, 2) let b = Own.same("x", "y") let p = Own.pair(a, b) let f = p.first let s = p.second', registry=registry()).types
    assert types[0] == INT and types[1] == STRING and types[2] == rows(first=INT, second=STRING) and types[3:] == [INT, STRING]
    found = errors('let a = Own.same(1, "x") let b = Own.same("x", true) let c = a |> String.upper()')
    assert [type(e) for e in found] == [TypeMismatch, TypeMismatch]


def test_let_is_polymorphic():
    compile_text('let n = Own.none() let a = Own.same(n, 1) let b = Own.same(n, "x") let c = b |> String.upper()', registry=registry())
    assert isinstance(errors('let n = Own.none() let a = Own.same(n, 1) let b = Own.same(a, "x")')[0], TypeMismatch)


def test_infinite_types_are_reported():
    found = errors("type T do v: int end let t = Own.open() |> each r -> T { v = Own.same(r.x, Own.inner(r.x)) }")
    assert [type(e) for e in found] == [InfiniteType] and found[0].code == "infinite-type" and found[0].at is not None
