"""Frames, validation, functions, quads and sinks."""

import glob
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import strandmap as sm
from strandmap.errors import EvaluationFault, FieldNotFound, InvalidArgument, InvalidExtension
from strandmap.functions import strings
from strandmap.lang import run_text
from strandmap.operators.frame import Frame
from strandmap.plans import quads as plan
from strandmap.plans import terms
from strandmap.sinks.rdf import serialize

E = "http://e/"
T = sm.Record("T", [sm.Field("a", sm.STRING, E + "a", sm.Constraints(min_length=2, pattern="x")), sm.Field("n", sm.INT, E + "n")], [("id", sm.STRING)], E + "T", E)


def frame(spark, rows, schema="id string, a string, n double"):
    return Frame(spark.createDataFrame(rows, schema))


def made(f):
    return f.each(lambda r: T(r.id, a=r.a, n=r.n))


def value(spark, column, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]).select(column.alias("v")).first()[0]


def test_first_match_only(spark):
    c = F.col("s")
    assert value(spark, strings.replace(c, "[0-9]", "<$0>"), s="a1b2") == "a<1>b2"
    assert value(spark, strings.replace(c, "(?P<k>b)(c)", "${k}${2}2$$\\"), s="abcbc") == "abc2$\\bc"
    assert value(spark, strings.replace(c, "x", "y"), s="abc") == "abc"
    assert value(spark, strings.replace(c, "\n", "-"), s="a\nb\nc") == "a-b\nc"
    assert value(spark, strings.replace_all(c, "(b)", "[$1a]"), s="abb") == "a[][]"
    assert value(spark, strings.replace_all(c, "(b)", "${1}9"), s="abb") == "ab9b9"


def test_extract(spark):
    assert value(spark, strings.extract(F.col("s"), r"(\d+)"), s="Bus#001") == "001"
    assert value(spark, strings.extract(F.col("s"), r"(\d+)"), s="Bus") is None
    with pytest.raises(InvalidArgument):
        strings.extract(F.lit("s"), "x")


@pytest.mark.parametrize("pattern", ["(?=a)b", "(?<!a)b", r"(a)\1", "a++", "(?>a)"])
def test_refused_patterns(pattern):
    with pytest.raises(InvalidArgument):
        strings.checked(pattern)


def test_interpolation_skips_nulls(spark):
    assert value(spark, sm.interpolate("a", F.col("x"), 1), x=None) == "a1" and value(spark, sm.interpolate(F.col("x")), x=None) == ""


def test_mapped_view_is_what_follows_read(spark):
    """Validation, reports, joins and projections see the record's fields, not the source's columns."""
    f = frame(spark, [("1", "q", 1.0)]).each(lambda r: T(r.id, a=F.concat(r.a, F.lit("x")), n=r.n))
    assert f.columns == ["a", "n"] and f.validate().mapped().count() == 1 and f.errors().source.count() == 0
    assert f.join(frame(spark, [("9", "qx", 2.0)]), "a", "a").source.columns == ["a", "n", "id", "a_right", "n_right"]
    with pytest.raises(FieldNotFound):
        f.each(lambda r: T(r.id, a=r.a))


def test_validation_keeps_outputs(spark):
    f = made(frame(spark, [("1", "ax", 1.9), ("2", "b", 2.0), ("3", None, 3.0), ("4", "abc", 4.0)]))
    assert f.validate().to_quads().where("predicate = 'http://e/a'").select("subject").collect()[0][0] == "http://e/1"
    assert sorted(tuple(r) for r in f.errors().source.collect()) == [("T", "a", "min_length", "2", "b"), ("T", "a", "pattern", "x", "abc")]
    with pytest.raises(EvaluationFault):
        frame(spark, []).validate()


def test_lengths_count_code_points(spark):
    assert made(frame(spark, [("1", "😀x", 1.0)])).validate().mapped().count() == 1


def test_quads(spark):
    f = made(frame(spark, [("1", "http://x", 1.9), (None, "_:b", None), ("<bad iri", "http: //no", 2.0), ("2", "<u:v>", -1.9)]))
    got = sorted(tuple(r)[:5] for r in f.to_quads().where("predicate <> '%s'" % terms.RDF_TYPE).collect())
    xsd = "http://www.w3.org/2001/XMLSchema#integer"
    assert got == [
        ("http://e/", "http://e/a", "_:b", "bnode", None),
        ("http://e/1", "http://e/a", "http://x", "iri", None),
        ("http://e/1", "http://e/n", "1", "literal", xsd),
        ("http://e/2", "http://e/a", "u:v", "iri", None),
        ("http://e/2", "http://e/n", "-1", "literal", xsd),
    ]


def test_one_scan_for_all_outputs(spark, tmp_path):
    frame(spark, [("1", "a", 1.0)]).source.write.parquet(str(tmp_path / "t"))
    f = Frame(spark.read.parquet(str(tmp_path / "t")))
    q = f.each(lambda r: T(r.id, a=r.a)).also(lambda r: T(r.a, n=r.n), lambda r: T(r.id, a=r.id)).to_quads()
    text = q._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Generate") == 1 and q.count() == 6


def test_same_predicate_twice_and_wide_outputs(spark):
    wide = sm.Record("W", [sm.Field(f"f{i}", sm.STRING, E + "p") for i in range(450)], [("id", sm.STRING)])
    f = frame(spark, [("http://e/1", "a", 1.0)])
    q = f.each(lambda r: wide(r.id, **{f"f{i}": r.a for i in range(450)})).to_quads()
    assert q.count() == 450 and q.distinct().count() == 1


def test_no_subject_no_outputs_no_predicates(spark):
    plain = sm.Record("P", [sm.Field("a")])
    f = frame(spark, [("1", "a", 1.0)])
    with pytest.raises(EvaluationFault):
        f.each(lambda r: plain(a=r.a)).to_quads()
    with pytest.raises(EvaluationFault):
        f.to_quads()
    assert f.each(lambda r: sm.Record("Q", [sm.Field("a")], [("id", sm.STRING)])(r.id, a=r.a)).to_quads().count() == 0
    bad = sm.Record("B", [sm.Field("a", sm.STRING, "no iri")], [("id", sm.STRING)])
    with pytest.raises(InvalidArgument):
        f.each(lambda r: bad(r.id, a=r.a)).to_quads()


def test_strict_objects_raise(spark):
    f = made(frame(spark, [("1", "http: //no", 2.0)]))
    assert plan.quads(f).count() == 3
    with pytest.raises(PySparkException):
        plan.quads(f, strict=True).collect()


def test_booleans_and_casts(spark):
    r = sm.Record("B", [sm.Field("a", sm.BOOL, E + "a"), sm.Field("n", sm.INT, E + "n")], [("id", sm.STRING)], base=E)
    f = frame(spark, [("1", "TRUE", 1.0), ("2", "yes", 2.0)])
    got = {tuple(x) for x in f.each(lambda x: r(x.id, a=x.a, n=x.a)).to_quads().select("subject", "object").collect()}
    assert got == {("http://e/1", "true")}


def test_line_escapes(spark):
    f = frame(spark, [("1", 'a"\\\n\r\t\x01é😀', 1.0)]).each(lambda r: T(r.id, a=r.a))
    lines = {r[0] for r in plan.lines(f.to_quads()).collect()}
    assert '<http://e/1> <http://e/a> "a\\"\\\\\\n\\r\\t\\u0001é😀" .' in lines


def test_languages_and_encoding(spark):
    f = frame(spark, [("1", "a b/é", 1.0)]).each(lambda r: T(terms.encode_iri(r.a), a=r.a))
    lines = [r[0] for r in plan.lines(plan.with_language(f.to_quads(), "en-GB")).collect()]
    assert '<http://e/a%20b%2F%C3%A9> <http://e/a> "a b/é"@en-GB .' in lines
    with pytest.raises(InvalidArgument):
        plan.with_language(f.to_quads(), "not a tag")
    assert value(spark, terms.resolve_iri(F.col("x"), "http://b/"), x="c") == "http://b/c" and value(spark, terms.resolve_iri(F.col("x"), "http://b/"), x="u:c") == "u:c"


def test_formats(spark, tmp_path):
    g = sm.Record("G", [sm.Field("a", sm.STRING, E + "a")], [("id", sm.STRING), ("graph", sm.STRING)], base=E)
    f = frame(spark, [("1", "v", 1.0)]).each(lambda r: g(r.id, "http://g", a=r.a))
    out = str(tmp_path / "o.")
    assert open(serialize(f, out + "nq")).read() == '<http://e/1> <http://e/a> "v" <http://g> .\n'
    assert open(serialize(f, out + "trig")).read() == '<http://g> { <http://e/1> <http://e/a> "v" . }\n'
    with pytest.raises(PySparkException):
        serialize(f, out + "nt")
    with pytest.raises(InvalidExtension):
        serialize(f, out + "xyz")
    assert sorted(os.listdir(tmp_path)) == ["o.nq", "o.trig"]
    assert open(serialize(made(frame(spark, [("1", "v", 1.0)])), str(tmp_path / "plain"))).read().count("\n") == 3
    serialize(f, out + "parts.nq", layout="folder")
    assert glob.glob(out + "parts.nq/part-*")


def test_reports(spark, tmp_path):
    p = str(tmp_path / "r.csv")
    frame(spark, [("1", 'a,"b"', 1.5), ("2", None, 2.0), ("", "l\nm", None)]).report(p)
    assert open(p).read() == 'id,a,n\n1,"a,""b""",1.5\n2,,2.0\n"","l\nm",\n'
    frame(spark, []).report(p)
    assert open(p).read() == "id,a,n\n"
    frame(spark, [("1", "a", 1.0)]).report(str(tmp_path / "f"), layout="folder")
    assert spark.read.text(str(tmp_path / "f")).first()[0] == "1,a,1.0" and open(str(tmp_path / "f/_header")).read() == "id,a,n\n"
    frame(spark, []).report(p, strict=True)
    assert open(p).read() == ""


def test_a_failing_program_leaves_no_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,n\n1,2\n")
    source = """
    let d = csv!("d.csv")
    #[rdf(base = "http://e/")] type T(id: string, graph: string) do #[rdf(uri = "http://e/n")] n: int end
    let m = d |> each r -> T(r.id, "http://g") { n = r.n }
    m |> Rdf.serialize("ok.nq")
    m |> Rdf.serialize("fails.nt")
    """
    with pytest.raises(PySparkException):
        run_text(source, spark, base=str(tmp_path))
    assert os.listdir(tmp_path) == ["d.csv"]


def test_null_keys_never_match(spark):
    a = frame(spark, [(None, "a", 1.0), ("1", "b", 1.0)])
    assert a.join(a, "id", "id").source.count() == 1


def test_spread_order(spark):
    f = frame(spark, [("1", "a", 2.0)])
    r = sm.Record("S", [sm.Field("id"), sm.Field("a"), sm.Field("n", sm.FLOAT)])
    assert f.spread(r, a=F.lit("z")).columns == ["id", "n", "a"]
    with pytest.raises(FieldNotFound):
        f.spread(sm.Record("S", [sm.Field("missing")]))


def test_streams(spark, tmp_path):
    from strandmap.streaming import line_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame(spark, [("1", "a", 1.0), ("2", "b", 2.0)]).source.write.parquet(src)
    s = Frame(spark.readStream.schema("id string, a string, n double").parquet(src))
    q = line_stream(made(s), out, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.text(out).count() == 6


def test_document_formats(spark, tmp_path):
    import json
    import xml.etree.ElementTree as ET

    f = made(frame(spark, [("1", 'a"<&>\né', 1.0), ("_:b", "http://x/y", None)]))
    f = Frame(f.source, [sm.Output(sm.Record("L", [sm.Field("a", sm.STRING, E + "a", lang="en")], [("id", sm.STRING)]), [F.concat(F.lit(E), F.col("id"))], [("a", F.col("a"))]), *f.outputs])
    nodes = json.loads(open(serialize(f, str(tmp_path / "o.jsonld"))).read())
    assert nodes[0] == {} and {"@id": "http://e/1", E + "a": [{"@value": 'a"<&>\né', "@language": "en"}]} in nodes
    assert {"@id": "http://e/1", "@type": [E + "T"]} in nodes and {"@id": "http://e/1", E + "n": [{"@value": "1", "@type": "http://www.w3.org/2001/XMLSchema#integer"}]} in nodes
    root = ET.parse(serialize(f, str(tmp_path / "o.rdf"))).getroot()
    rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
    found = {(d.get(rdf + "about"), d[0].tag, d[0].get(rdf + "resource"), d[0].text) for d in root}
    assert ("http://e/1", "{http://e/}a", None, 'a"<&>\né') in found and ("http://e/1", rdf + "type", E + "T", None) in found and len(root) == len(nodes) - 1
    g = sm.Record("G", [sm.Field("a", sm.STRING, E + "a")], [("id", sm.STRING), ("graph", sm.STRING)], base=E)
    named = frame(spark, [("1", "v", 1.0)]).each(lambda r: g(r.id, "http://g", a=r.a))
    assert json.loads(open(serialize(named, str(tmp_path / "g.jsonld"))).read())[1]["@graph"][0]["@id"] == "http://e/1"
    with pytest.raises(PySparkException):
        serialize(named, str(tmp_path / "g.rdf"))


def test_extension_points(spark, tmp_path):
    """A provider, a module, a generator, a reference rule and a file reader of one's own."""
    from strandmap.lang import compile_text
    from strandmap.registry import Function, Provided, Provider, ProviderArg
    from strandmap.stdlib import standard
    from strandmap.types import INT, STRING, Named

    r = standard()
    record = lambda name: sm.Record(name, [sm.Field("n", INT)])
    r.provider("numbers", Provider("data", [ProviderArg("to", int, required=True)], lambda ctx, a: Provided(record(ctx.type_name), lambda rt: Frame(rt.spark.range(a["to"]).withColumnRenamed("id", "n"), record=record(ctx.type_name)))))
    r.module("Math", {"double": Function([("x", INT)], INT, lambda rt, types, x: x * 2)})
    r.generator(lambda rec: {"few": Function([("rows", Named(rec.name))], Named(rec.name), lambda rt, types, rows: rows.where(F.col("n") < 2))})
    r.base_of = lambda rec: f"http://own/{rec.name}/"
    r.read_file = lambda path: "<http://s/S> { <http://s/n> <http://www.w3.org/2001/XMLSchema#integer> }"
    (tmp_path / "s.shex").write_text("not this")
    source = """let xs = numbers!(5)
    type S(id: string) = shex!("s.shex", shape: "S")
    type L do n: int at: S end
    xs |> xs.few() |> each r -> L { n = Math.double(r.n), at = ref S("k${r.n}") }"""
    out = compile_text(source, r, base=str(tmp_path)).run(spark)[-1].mapped()
    assert sorted(map(tuple, out.collect())) == [(0, "http://own/S/k0"), (2, "http://own/S/k1")]
    assert Frame.empty(spark, record("E")).source.count() == 0 and STRING


def test_rows_of_a_text_format(spark):
    assert sm.Frame(spark.createDataFrame([("a b", 1)], "`odd name` string, n int")).row()["odd name"] is not None
