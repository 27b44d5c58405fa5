"""Whole programs: mappings of small tables and the quads they must give, compared as sets."""

import os
import subprocess
import sys

import pytest

from strandmap.errors import CompileErrors
from strandmap.lang import compile_text, run_text

FOAF = "http://xmlns.com/foaf/0.1/name"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


def run(spark, tmp_path, source, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    run_text(source, spark, base=str(tmp_path))
    return {" ".join(x.split()) for x in (tmp_path / "out.nq").read_text().splitlines()}


def one_name(ctor: str, value: str, base: str = "") -> str:
    return f"""let input = csv!("t.csv")
    {base}
    type Output(subject: string) do
        #[rdf(uri = "{FOAF}")]
        Name: string
    end
    input |> each row -> Output({ctor}) {{ Name = {value} }} |> Rdf.serialize("out.nq")"""


CASES = [
    ("Name\n", one_name("row.Name", "row.Name", '#[rdf(base = "http://example.com/")]'), set()),
    ("Name\nVenus\n", one_name("row.Name", "row.Name", '#[rdf(base = "http://example.com/")]'), {f'<http://example.com/Venus> <{FOAF}> "Venus" .'}),
    ("Name\nVenus\n", one_name('"_:${row.Name}"', "row.Name"), {f'_:Venus <{FOAF}> "Venus" .'}),
    ("ID,Name\n10,Venus\n", one_name('"http://example.com/${row.ID}/${row.Name}"', "row.Name"), {f'<http://example.com/10/Venus> <{FOAF}> "Venus" .'}),
    ("ID,Name\n10,Venus\n", one_name('"_:students${row.ID}"', "row.Name"), {f'_:students10 <{FOAF}> "Venus" .'}),
    ("ID,F,L\n10,Venus,Williams\n", one_name('"http://example.com/Student${row.ID}"', '"${row.F} ${row.L}"'), {f'<http://example.com/Student10> <{FOAF}> "Venus Williams" .'}),
    # Constants, and blank nodes of several columns.
    ("f,l,a\nBob,Smith,30\nSue,Jones,20\n", one_name('"_:${row.f}${row.l}${row.a}"', '"${row.f} ${row.l}"'), {f'_:BobSmith30 <{FOAF}> "Bob Smith" .', f'_:SueJones20 <{FOAF}> "Sue Jones" .'}),
    # Invalid subjects are dropped with their row, never moved to the next.
    ("ID\na b\nc\n", one_name('"http://e/${row.ID}"', "row.ID"), {f'<http://e/c> <{FOAF}> "c" .'}),
]


@pytest.mark.parametrize(("table", "source", "expected"), CASES)
def test_cases(spark, tmp_path, table, source, expected):
    assert run(spark, tmp_path, source, t=table) == expected


def test_two_types_of_one_row(spark, tmp_path):
    source = f"""let t = csv!("t.csv")
    #[rdf(type = "http://example.com/Student")] type Student(s: string) do #[rdf(uri = "{FOAF}")] Name: string end
    #[rdf(type = "http://example.com/Sport")] type Sport(s: string) do #[rdf(uri = "{FOAF}")] Name: string end
    t |> each row -> Student("http://example.com/${{row.Student}}") {{ Name = row.Student }}
      +> each row -> Sport("http://example.com/${{row.Sport}}") {{ Name = row.Sport }}
      |> Rdf.serialize("out.nq")"""
    assert run(spark, tmp_path, source, t="Student,Sport\nVenus,Tennis\n") == {
        f"<http://example.com/Venus> <{RDF}> <http://example.com/Student> .", f'<http://example.com/Venus> <{FOAF}> "Venus" .',
        f"<http://example.com/Tennis> <{RDF}> <http://example.com/Sport> .", f'<http://example.com/Tennis> <{FOAF}> "Tennis" .',
    }


def test_float_into_int(spark, tmp_path):
    source = """let input = csv!("t.csv")
    type Output(s: string) do #[rdf(uri = "http://example.com/owes")] owes: int end
    input |> each row -> Output("http://example.com/${row.f};${row.l}") { owes = row.amount } |> Rdf.serialize("out.nq")"""
    got = run(spark, tmp_path, source, t="f,l,amount\nBob,Smith,30.0E0\nSue,Jones,20.0E0\nBob,Smith,30.0E0\n")
    assert got == {f'<http://example.com/{s}> <http://example.com/owes> "{n}"^^<{XSD}integer> .' for s, n in (("Bob;Smith", 30), ("Sue;Jones", 20))}


def test_graphs_and_joins(spark, tmp_path):
    source = """let student = csv!("student.csv")
    let sport = csv!("sport.csv")
    #[rdf(base = "http://e/")]
    type S(id: string, graph: string) do #[rdf(uri = "http://e/practises")] p: Sport end
    #[rdf(base = "http://e/sport_")]
    type Sport(id: string) do #[rdf(uri = "http://e/label")] l: string end
    student |> join sport on Sport = ID suffix "_2"
        |> each r -> S("student_${r.ID}", "http://e/graph") { p = ref Sport(r.ID_2) }
        +> each r -> Sport(r.ID_2) { l = r.Name_2 }
        |> Rdf.serialize("out.nq")"""
    got = run(spark, tmp_path, source, student="ID,Sport,Name\n10,100,Venus\n20,,Demi\n", sport="ID,Name\n100,Tennis\n")
    assert got == {"<http://e/student_10> <http://e/practises> <http://e/sport_100> <http://e/graph> .", '<http://e/sport_100> <http://e/label> "Tennis" .'}


def test_shapes_validation_and_report(spark, tmp_path):
    (tmp_path / "person.shex").write_text("PREFIX f: <http://f/>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n<http://e/PersonShape> { f:name xsd:string MinLength 2 ; f:age xsd:integer }")
    source = """let data = csv!("people.csv")
    #[rdf(base = "http://e/person/")]
    type Person(id: string) = shex!("person.shex", shape: "PersonShape")
    let mapped = data |> each row -> Person(row.email) { name = row.name, age = row.age }
    mapped |> Person.validate() |> Rdf.serialize("out.nq")
    mapped |> Person.errors() |> Report.csv("errors.csv")"""
    got = run(spark, tmp_path, source, people="name,age,email\nAlice,30,a@x\nBob,25,b@x\nCarol,35,c@x\nA,20,d@x\n")
    assert len(got) == 6 and f'<http://e/person/b@x> <http://f/age> "25"^^<{XSD}integer> .' in got
    assert (tmp_path / "errors.csv").read_text() == "source_type,field,constraint,expected,actual\nPerson,name,min_length,2,A\n"


def test_shapes_refer_to_each_other(tmp_path):
    (tmp_path / "s.shex").write_text("PREFIX e: <http://e/>\ne:A { e:b @e:B }\ne:B { e:x . }")
    p = compile_text('type First = shex!("s.shex", shape: "A") type Second = shex!("s.shex", shape: "B")', base=str(tmp_path))
    assert str(p.declared.records["First"].field("b").type) == "Second"


def test_loaded_types_and_extracted_keys(spark, tmp_path):
    source = """type A = csv!("a.csv")
    type B = csv!("b.csv")
    let a = A.load() |> each row -> A { ..row, unit = row.unit |> String.extract("(\\d+)") }
    let b = B.load() |> each row -> B { ..row, code = row.code |> String.extract("(\\d+)") }
    #[rdf(type = "http://u/V", base = "http://u/")] type V(s: string) do #[rdf(uri = "http://u/score")] score: float #[rdf(uri = "http://u/flag")] flag: bool end
    a |> join b on (unit, at) = (code, time)
      |> each row -> V("V_${row.unit}") { score = row.score, flag = row.flag } |> Rdf.serialize("out.nq")"""
    got = run(spark, tmp_path, source, a="unit,at,score\n001-A,t1,2\n002-A,t1,3\n", b="code,time,flag\nBus#001,t1,True\nBus#002,t2,False\n")
    assert got == {f"<http://u/V_001> <{RDF}> <http://u/V> .", f'<http://u/V_001> <http://u/score> "2.0"^^<{XSD}double> .', f'<http://u/V_001> <http://u/flag> "true"^^<{XSD}boolean> .'}


def test_building_models(spark, tmp_path):
    (tmp_path / "b.ifc").write_text("#1=IFCWALL('g1',#2,'W1','D',$,$,$,'t',.SOLID.);#3=IFCWALL('g2',#2,$,$,$,$,$,$,$);")
    source = """let walls = ifc!("b.ifc", "IfcWall")
    #[rdf(type = "http://b/Wall", base = "http://b/wall/")]
    type Wall(id: string) do #[rdf("http://b/label")] Name: string #[rdf("http://b/kind")] Kind: string? end
    walls |> each w -> Wall(w.GlobalId) { Name = w.Name, Kind = w.PredefinedType } |> Rdf.serialize("out.nq")"""
    assert run(spark, tmp_path, source) == {
        f"<http://b/wall/g1> <{RDF}> <http://b/Wall> .", f"<http://b/wall/g2> <{RDF}> <http://b/Wall> .", '<http://b/wall/g1> <http://b/label> "W1" .', '<http://b/wall/g1> <http://b/kind> "SOLID" .',
    }


@pytest.mark.parametrize("source", ['csv!("t.csv") |> each r -> 3', 'let i = csv!("t.csv") type O(s: string) do N: string end i |> each r -> O(r.IDs) { N = r.ID }', 'let i = csv!("none.csv")', 'let i = csv!("t.csv") type O(s: string) do N: string end i |> each r -> O { N = r.ID }'])
def test_wrong_programs(tmp_path, source):
    (tmp_path / "t.csv").write_text("ID\n1\n")
    with pytest.raises(CompileErrors):
        compile_text(source, base=str(tmp_path))


def test_records_are_rows_too(spark, tmp_path):
    source = 'type T(s: string) do #[rdf(uri = "http://e/n")] n: string end let t = T("http://e/1") { n = "x" } t |> Rdf.serialize("out.nq")'
    assert run(spark, tmp_path, source) == {'<http://e/1> <http://e/n> "x" .'}


def test_command_line(tmp_path):
    bad = tmp_path / "bad.map"
    bad.write_text("let a = 1\nlet b = missing\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    r = subprocess.run([sys.executable, "-m", "strandmap", "compile", "-p", str(bad)], cwd=root, capture_output=True, text=True)
    assert r.returncode == 1 and "error[undefined]" in r.stderr and ":2:9" in r.stderr
    bad.write_text("let a = 1\n")
    assert subprocess.run([sys.executable, "-m", "strandmap", "compile", "-p", str(bad)], cwd=root, capture_output=True).returncode == 0


def test_several_types_and_constants(spark, tmp_path):
    """Two record types of one subject, a constant subject in a named graph, encoded templates, relative subjects, languages."""
    source = """let t = csv!("t.csv")
    #[rdf(type = "http://example.com/Student", base = "http://example.com/")]
    type Student(s: string, g: string) do #[rdf(uri = "http://example.com/id")] id: string end
    #[rdf(type = "http://xmlns.com/foaf/0.1/Person", base = "http://example.com/")]
    type Person(s: string) do #[rdf(uri = "http://xmlns.com/foaf/0.1/name", lang = "en")] name: string end
    type Bad(s: string, g: string) do #[rdf(uri = "http://example.com/description")] d: string end
    type Rel(s: string) do #[rdf(uri = "http://example.com/rel")] d: string end
    t |> each r -> Student("Student/${r.ID}/${r.Enc}", "http://example.com/graph/${r.ID}") { id = r.ID }
      +> each r -> Person("Student/${r.ID}/${r.Enc}") { name = r.Name }
      +> each r -> Bad("http://example.com/BadStudent", "http://example.com/graph/student") { d = "Bad Student" }
      +> each r -> Rel(Iri.resolve(r.Name, "http://example.com/base/")) { d = "x" }
      |> Rdf.serialize("out.nq")""".replace("r.Enc}", "r.ID}")
    got = run(spark, tmp_path, source.replace('"Student/${r.ID}/${r.ID}"', "r.Name |> Iri.encode()"), t="ID,Name\n10,Venus Williams\n20,http://example.com/ns#Jhon\n")
    assert f"<http://example.com/Venus%20Williams> <{RDF}> <http://example.com/Student> <http://example.com/graph/10> ." in got
    assert f'<http://example.com/Venus%20Williams> <{FOAF}> "Venus Williams"@en .' in got and f"<http://example.com/Venus%20Williams> <{RDF}> <http://xmlns.com/foaf/0.1/Person> ." in got
    assert '<http://example.com/BadStudent> <http://example.com/description> "Bad Student" <http://example.com/graph/student> .' in got
    assert '<http://example.com/ns#Jhon> <http://example.com/rel> "x" .' in got and '<http://example.com/http%3A%2F%2Fexample.com%2Fns%23Jhon> <http://example.com/id> "20" <http://example.com/graph/20> .' in got


def test_many_to_many(spark, tmp_path):
    source = """let s = csv!("s.csv") let p = csv!("p.csv") let l = csv!("l.csv")
    #[rdf(base = "http://e/s/")] type S(i: string) do #[rdf(uri = "http://e/plays")] p: P end
    #[rdf(base = "http://e/p/")] type P(i: string) do #[rdf(uri = "http://e/d")] d: string end
    l |> join s on ID_S = ID |> join p on ID_P = ID suffix "_p"
      |> each r -> S(r.ID_S) { p = ref P(r.ID_P) } +> each r -> P(r.ID_P) { d = r.D } |> Rdf.serialize("out.nq")"""
    got = run(spark, tmp_path, source, s="ID,N\n10,V\n11,F\n", p="ID,D\n110,Tennis\n111,Football\n", l="ID_S,ID_P\n10,110\n11,110\n11,111\n9,110\n")
    assert len([x for x in got if "plays" in x]) == 3 and '<http://e/p/110> <http://e/d> "Tennis" .' in got
