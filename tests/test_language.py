"""Lexer, parser, checker: programs and the errors they cause."""

import pytest

from strandmap.errors import (
    AlreadyDefined,
    ArityMismatch,
    CompileErrors,
    EvaluationFault,
    FieldNotFound,
    InvalidArgument,
    InvalidExtension,
    MissingArgument,
    NotA,
    NotAFile,
    ProviderKind,
    SourceNotFound,
    SyntaxFault,
    TypeMismatch,
    Undefined,
)
from strandmap.lang import ast, compile_text
from strandmap.lang.lexer import KEYWORDS, tokens
from strandmap.lang.parser import parse
from strandmap.types import BOOL, INT, STRING, Named, Optional, Rows


def errors(source: str, **options) -> list:
    with pytest.raises(CompileErrors) as e:
        compile_text(source, **options)
    return e.value.errors


def first(source: str, **options):
    return errors(source, **options)[0]


def kinds(source: str) -> list:
    return compile_text(source).types


def expr(source: str):
    statements, faults = parse(source)
    assert not faults
    return statements[-1].value


# --- tokens and syntax ---


def test_strings_are_raw_and_comments_skipped():
    found, faults = tokens('let x = "(\\d+)" // "no"\r\n 1')
    assert not faults and [t.text for t in found[:-1]] == ["let", "x", "=", "(\\d+)", "1"]


def test_all_keywords():
    assert len(KEYWORDS) == 15


@pytest.mark.parametrize("source", ["let x", "type T do Name: string", "let = 3", "let x = 1 +> join y on a = b", "x |> 3", "let x = #", "type T do A int end"])
def test_syntax_faults(source):
    assert isinstance(first(source), SyntaxFault)


def test_every_fault_is_found():
    assert len(errors("let a = \nlet b = 1\nlet = 2\ntype T do x end")) >= 2


def test_keywords_name_fields():
    p = compile_text('type T do type: string end: int end\nlet t = T { type = "a", end = 1 }\nlet u = t.type')
    assert p.types[-1] == STRING


def test_pipe_is_a_call():
    e = expr("x |> f(b)")
    assert isinstance(e, ast.Call) and str(e.callee) == "f" and len(e.args) == 2
    assert len(expr("x |> A.g").args) == 1


def test_outputs_of_one_projection():
    e = expr("x |> each r -> A { X = 1 } +> each r -> B { Y = 2 }")
    assert isinstance(e, ast.Projection) and len(e.outputs) == 2
    e = expr("x |> each r -> A { X = 1 } |> each r -> B { Y = 2 }")
    assert len(e.outputs) == 1 and isinstance(e.source, ast.Projection)
    assert len(expr("x +> each r -> A { X = 1 }").outputs) == 1


def test_joins_are_left_deep():
    e = expr('a |> join b on x = y |> join c on (p, q,) = (r, s) suffix "_c"')
    assert e.left_on == ["p", "q"] and e.suffix == "_c" and isinstance(e.left, ast.Join) and e.left.suffix == "_right"


def test_trailing_commas_and_spread():
    e = expr("x |> each r -> T(1,) { ..r, a = 1, }")
    body = e.outputs[0].body
    assert body.spread is not None and [f.name for f in body.fields] == ["a"] and len(body.args) == 1


def test_interpolation_of_names_only():
    e = expr('"a ${r.x} b ${y}"')
    assert isinstance(e, ast.Interpolation) and [str(p) for p in e.parts] == ["a ", "r.x", " b ", "y"]
    assert expr('"a ${r.x} ${1 + 2}"').value == "a ${r.x} ${1 + 2}"
    assert expr('"a ${open"').value == "a ${open"


def test_attributes():
    statements, _ = parse('#[rdf(type = "T", base = "b",)] #[x("p", true, 3)] type T(id: string) do #[validate(min_length = 2)] a: string? end')
    t = statements[0]
    assert t.attributes[0].named == {"type": "T", "base": "b"} and t.attributes[1].positional == ["p", True, 3]
    assert t.fields[0].attributes[0].named == {"min_length": 2} and t.fields[0].type.optional


# --- types ---


def test_literals_and_propagation():
    assert kinds('let a = 42 let b = "x" let c = true let d = a let e = "hi ${b}"') == [INT, STRING, BOOL, INT, STRING]


def test_records():
    assert kinds('type P do Name: string Age: int end let p = P { Name = "a", Age = 3 } let n = p.Age')[1:] == [Named("P"), INT]
    assert kinds('type T(id: string) do N: string end let t = T("x") { N = "a" }')[1] == Named("T")
    assert kinds("type T do N: string end let t = T {}")[1] == Named("T")
    assert kinds('type T do A: int B: string end let t = T(1, "b")')[1] == Named("T")


def test_optional_widening_and_fields():
    p = compile_text("type T do Age: int? end let t = T { Age = 42 }")
    assert p.declared.records["T"].field("Age").type == Optional(INT)


def test_nested_field_access():
    assert kinds("type I do V: int end type O do C: I end let i = I { V = 1 } let o = O { C = i } let v = o.C.V")[-1] == INT


def test_projection_has_the_last_output_type():
    source = 'type A do X: int end type B do Y: string end let x = 42 let r = x |> each r -> A { X = 1 } +> each r -> B { Y = "h" }'
    assert kinds(source)[-1] == Named("B")


def test_join_type_keeps_all_columns():
    source = 'type A do X: int Y: string end type B do X: int Z: bool end let a = A { X = 1, Y = "" } let b = B { X = 1, Z = true } let j = a |> join b on X = X'
    t = kinds(source)[-1]
    assert isinstance(t, Rows) and [n for n, _ in t.fields] == ["X", "Y", "X_right", "Z"]


def test_names_can_be_bound_again():
    assert kinds('let x = 1 let x = "${x}"')[-1] == STRING


def test_ref_is_of_its_type():
    source = 'type L(id: string) do a: int end type T do l: L end let t = T { l = ref L("x") }'
    assert kinds(source)[-1] == Named("T")


def test_aliases():
    assert kinds('type A do X: int end type B = A let b = B { X = 1 } let x = b.X')[-1] == INT
    assert isinstance(first("type S = string let s = S { }"), NotA)


def test_named_arguments_are_bound_by_name():
    compile_text('let a = String.replace("x", replacement: "b", pattern: "a")')
    assert isinstance(first('let a = String.replace("x", wrong: "b", pattern: "a")'), Undefined)


@pytest.mark.parametrize(
    ("source", "kind", "payload"),
    [
        ("let y = unknown_var", Undefined, {"kind": "variable", "name": "unknown_var"}),
        ("type T do Name: Missing end", Undefined, {"kind": "type", "name": "Missing"}),
        ("let t = Missing { a = 1 }", Undefined, {"kind": "type"}),
        ("let t = Missing.f(1)", Undefined, {"kind": "module"}),
        ("let t = String.f(1)", Undefined, {"kind": "function"}),
        ("type T do A: int end type T do B: string end", AlreadyDefined, {"name": "T"}),
        ('type T do N: string end let t = T { N = "a" } let z = t.Missing', FieldNotFound, {"field": "Missing"}),
        ('type D do N: string end let d = D { N = "a" } let r = d |> each row -> row.Missing', FieldNotFound, {"field": "Missing"}),
        ('type T do N: string end let t = T { Bad = "a" }', FieldNotFound, {"field": "Bad"}),
        ('type T(id: string) do N: string end let t = T { N = "a" }', ArityMismatch, {"expected": 1, "actual": 0}),
        ('type T do N: string end let t = T("a", "b")', ArityMismatch, {}),
        ('type T(id: string) do N: string end let t = ref T()', ArityMismatch, {}),
        ("let x = String.extract(1, \"(a)\")", TypeMismatch, {}),
        ("let x = String.upper()", ArityMismatch, {}),
        ("let x = 1 let y = x.a", NotA, {}),
        ("let x = 1 let y = x(2)", NotA, {}),
        ('type A do X: int end let a = A { X = 1 } let j = a |> join a on X = Y', FieldNotFound, {"field": "Y"}),
        ('type A do X: int end let a = A { X = 1 } let j = a |> join a on (X, X) = (X)', ArityMismatch, {}),
        ('type A do X: int end let a = A { X = 1 } let j = a |> each r -> r.X', EvaluationFault, {}),
        ('type A do X: int end let a = A { X = 1 } let s = "${a}"', EvaluationFault, {}),
        ('type A do #[validate(min_length = 4294967296)] X: string end', InvalidArgument, {}),
        ('let x = nothing!("a")', Undefined, {"kind": "provider"}),
        ("let x = csv!()", MissingArgument, {"name": "path"}),
        ("let x = csv!(3)", InvalidArgument, {}),
        ('let x = csv!("missing.csv")', SourceNotFound, {}),
        ('let x = csv!("file.txt")', InvalidExtension, {}),
        ('let x = shex!("f.shex", shape: "S")', ProviderKind, {}),
        ('type X = ifc!("f.ifc", "IfcWall")', ProviderKind, {}),
        ('let x = csv!("ftp://host/a.csv")', InvalidArgument, {}),
    ],
)
def test_errors(source, kind, payload):
    e = first(source)
    assert isinstance(e, kind), e
    for k, v in payload.items():
        assert getattr(e, k) == v
    assert e.at is not None


def test_a_folder_is_no_file(tmp_path):
    (tmp_path / "d.csv").mkdir()
    assert isinstance(first('let x = csv!("d.csv")', base=str(tmp_path)), NotAFile)


def test_errors_of_all_statements():
    assert len(errors("let a = unknown1\nlet b = unknown2\nlet c = a")) == 2


def test_warning_for_two_rdf_types():
    p = compile_text('#[rdf(type = "http://e/T")] type T(i: string) do #[rdf(uri = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type")] t: string end')
    assert p.warnings


def test_functions_exist_only_for_constrained_types():
    assert isinstance(first('type T do N: string end let t = T { N = "a" } let v = t |> T.validate()'), Undefined)
    compile_text('type T do #[validate(min_length = 1)] N: string end let t = T { N = "a" } let v = t |> T.validate()')
