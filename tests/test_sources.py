"""CSV inference, STEP files, shape schemas, paths."""

import pytest
from strandmap.errors import InvalidExtension, ParseFault, Undefined
from strandmap.sources import csv, ifc, paths, shex, step
from strandmap.types import BOOL, FLOAT, INT, STRING, Named, Optional


@pytest.mark.parametrize(
    ("cells", "kind"),
    [
        (["1", "-2", ""], INT), (["1", "2.5"], FLOAT), (["30.0E0"], FLOAT), (["True", "false"], BOOL), (["1", "x"], STRING), (["", None], STRING),
        (["2025-02-01T08:00:00Z"], STRING), (["9223372036854775808"], FLOAT), ([" 1"], STRING), (["1", "true"], STRING),
    ],
)
def test_inference(cells, kind):
    assert csv.infer(cells) == kind


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_csv_rows(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id,name,x\n1,"a, ""b""",1.5\n2,,2\n3,c,\n')
    r = csv.record(path, "A")
    assert [(f.name, f.type) for f in r.fields] == [("id", INT), ("name", STRING), ("x", Optional(FLOAT))]
    assert [tuple(x) for x in csv.load(path, r, spark).collect()] == [(1, 'a, "b"', 1.5), (2, None, 2.0), (3, "c", None)]


def test_csv_options(spark, tmp_path):
    path = write(tmp_path, "b.csv", "1;x\n2;y\n")
    r = csv.record(path, "B", delimiter=";;", has_header=False)
    assert [f.name for f in r.fields] == ["column_1", "column_2"]
    assert csv.load(path, r, spark, ";", False).count() == 2


def test_csv_header_only(spark, tmp_path):
    path = write(tmp_path, "c.csv", "Name\n")
    r = csv.record(path, "C")
    assert r.fields[0].type == STRING and csv.load(path, r, spark).count() == 0


def test_rows_past_the_sample_must_fit(spark, tmp_path):
    path = write(tmp_path, "d.csv", "n\n" + "1\n" * 120 + "x\n")
    r = csv.record(path, "D")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        csv.load(path, r, spark).collect()


def values(text, kind="IFCWALL"):
    return [v for _, v in step.entities(text, kind)]


def test_step_tokens():
    (v,) = values("#1=IFCWALL('0abc',#2,'Wall Name','Description',$,*,#5,$,.STANDARD.);")
    assert v[0] == "0abc" and v[1] == step.Ref(2) and v[4] is None and v[5] is step.DERIVED and v[8] == step.Enum("STANDARD")
    assert values("#1=IFCWALL('it''s a test');")[0] == ("it's a test",)
    assert values("#1=IFCWALL(IFCIDENTIFIER('hello'));")[0] == (step.Typed("IFCIDENTIFIER", ("hello",)),)
    assert values("#1=IFCWALL(\n  '0abc',\n  #2, /* x */\n  'Wall'\n);")[0][2] == "Wall"
    assert values("#1=IFCWALL(42,-3,1.5,-2.7,3E10,1.5E-3);")[0] == (42, -3, 1.5, -2.7, 3e10, 1.5e-3)
    assert values("#1=IFCWALL((1,2,(3)),());")[0] == ([1, 2, [3]], [])
    assert values(r"#1=IFCWALL('\X2\00E9\X0\ \S\i \X\E9 \\');")[0] == ("é é é \\",)


def test_step_types_and_strings():
    text = "ISO-10303-21;DATA;#1=IFCWALL('a;#9=IFCWALL(');#2=IfcWall('b');#3=IFCDOOR('c');#4=IFCWALL ('d');"
    assert [v[0] for v in values(text, "ifcwall")] == ["a;#9=IFCWALL(", "b", "d"]
    with pytest.raises(ParseFault):
        values("#1=IFCWALL('a' 'b');")


def test_step_accessors():
    assert step.as_string(step.Typed("X", ("a",))) == "a" and step.as_string(step.Enum("E")) is None and step.as_string(step.Enum("E"), True) == "E"
    assert step.as_float(3) == 3.0 and step.as_float("3") is None and step.as_float(step.Typed("X", (3.0,))) is None


def test_ifc(spark, tmp_path):
    text = "#1=IFCBUILDINGSTOREY('g',#2,'N é',$,$,$,$,'long',.ELEMENT.,3.5);\n#2=IFCDOOR('d',#2,$,$,$,$,$,'t',2,0.9,.DOOR.,.SINGLE.);"
    path = write(tmp_path, "m.ifc", text)
    assert [tuple(r) for r in ifc.load(path, "IfcStorey", spark).collect()] == [("g", "N é", None, None, "long", 3.5)]
    assert [tuple(r)[-4:] for r in ifc.load(path, "IfcDoor", spark).collect()] == [(2.0, 0.9, "DOOR", "SINGLE")]
    assert [tuple(r)[-2:] for r in ifc.load(path, "IfcDoor", spark, strict=True).collect()] == [(None, None)]
    assert ifc.load(path, "IfcWall", spark).count() == 0 and len(ifc.ENTITIES) == 8
    with pytest.raises(Undefined):
        ifc.record("IfcTree")


SHAPES = """
BASE <http://e.org/s#>
PREFIX ex: <http://e.org/>  # note
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
<Person> EXTRA a CLOSED {
  a [ex:Person ex:Human] ;
  ex:name xsd:string MinLength 2 MAXLENGTH 9 ;
  ex:code PATTERN "^[a-z]+$" ? ;
  ex:zip /^\\d{3}\\/x$/i * ;
  ( ex:age xsd:integer {0,1} | ex:born xsd:date ) ;
  ex:score xsd:decimal + // rdfs:comment "c" ;
  ex:home @<Place> {1,2} ;
  ex:ok xsd:boolean
}
<Place> { ex:at . } AND { ex:to IRI }
<Either> @<Place> OR @<Person>
"""


def test_shapes():
    r = shex.record(SHAPES.replace("rdfs:comment", "ex:comment"), "Person", "P", types={"http://e.org/Place": "PlaceType"})
    assert r.rdf_type == "http://e.org/Person" and r.identity == "http://e.org/Person"
    kinds = {f.name: f.type for f in r.fields}
    assert kinds == {"name": STRING, "code": Optional(STRING), "zip": Optional(STRING), "age": Optional(INT), "born": STRING, "score": FLOAT, "home": Named("PlaceType"), "ok": BOOL}
    assert r.field("name").validate.listed() == [("min_length", 2), ("max_length", 9)] and r.field("name").uri == "http://e.org/name"
    assert r.field("code").validate.pattern == "^[a-z]+$" and r.field("zip").validate.pattern == "(?i)^\\d{3}/x$"
    assert [f.name for f in shex.record(SHAPES.replace("rdfs:comment", "ex:comment"), "Either", "E").fields] == ["at", "to"]


def test_shape_faults():
    with pytest.raises(Undefined):
        shex.record("PREFIX e: <http://e/> e:A { e:b . }", "C", "C")
    with pytest.raises(ParseFault):
        shex.parse("<A> { x:y . }")


def test_paths(tmp_path):
    assert paths.checked("s3://b/a.csv", "csv") == "s3a://b/a.csv" and paths.checked("az://b/a.csv").startswith("abfss://")
    with pytest.raises(InvalidExtension):
        paths.checked("s3://b/a.txt", "csv")
