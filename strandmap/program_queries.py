"""Driver queries of files, shapes and whole programs, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap import functions as fn
from strandmap.errors import CompileErrors, MappingError
from strandmap.lang import compile_text
from strandmap.operators.frame import Frame
from strandmap.plans import quads as quad_plan
from strandmap.queries import CUSTOMER, EX, NATION, REGION, TYPE, XSD, _C, _N, _R, quads_sql, query, scratch
from strandmap.registry import Function
from strandmap.sinks.output import Outputs
from strandmap.sources import csv, ifc, jsonld, paths, shex
from strandmap.stdlib import standard
from strandmap.streaming import quad_stream
from strandmap.types import INT, STRING, Field, Record, Rows, Var

# --- RDF files, written and read back ---------------------------------------------------------------------------


def _customers(table):
    rows = Frame(table("customer").source.withColumn("note", F.expr("case when c_nationkey = 4 then concat('a \"b\"\\n\\\\', c_name) else c_name end")))
    return rows.each(lambda r: CUSTOMER(r.c_custkey, name=r.note, segment=r.c_mktsegment, nation=fn.ref(NATION, r.c_nationkey)))


def _file(table, spark, extension: str, frame: Frame | None = None, **options) -> DataFrame:
    path = f"{scratch(spark, 'quads')}.{extension}"
    (frame or _customers(table)).serialize(path, **options)
    return spark.read.text(path)


_NOTE = "CASE WHEN c_nationkey = 4 THEN 'a \\\"b\\\"\\n\\\\' || c_name ELSE c_name END"
_LINES = f"""SELECT '<' || {_C} || '> <{TYPE}> <{EX}Customer> .' AS value FROM customer
UNION ALL SELECT '<' || {_C} || '> <{EX}name> "' || {_NOTE} || '" .' FROM customer
UNION ALL SELECT '<' || {_C} || '> <{EX}segment> "' || c_mktsegment || '" .' FROM customer
UNION ALL SELECT '<' || {_C} || '> <{EX}nation> <http://example.com/nation/' || c_nationkey || '> .' FROM customer"""


@query(_LINES)
def nq_file(table, spark, sf_dir):
    return _file(table, spark, "nq")


@query(_LINES)
def nt_folder(table, spark, sf_dir):
    """A folder of parts, as large outputs are written."""
    return _file(table, spark, "nt", layout="folder")


@query(_LINES)
def turtle_file(table, spark, sf_dir):
    return _file(table, spark, "ttl")


_G = "'http://example.com/graph/' || n_regionkey"


@query(f"SELECT CASE WHEN n_regionkey = 1 THEN '' ELSE '<' || {_G} || '> {{ ' END || '<' || {_N} || '> <{EX}name> \"' || n_name || '\" .' || CASE WHEN n_regionkey = 1 THEN '' ELSE ' }}' END AS value FROM nation")
def trig_file(table, spark, sf_dir):
    record = Record("Nation", [Field("name", STRING, EX + "name")], [("id", STRING), ("graph", STRING)], base=EX + "nation/")
    graph = F.expr("case when n_regionkey = 1 then null else concat('http://example.com/graph/', n_regionkey) end")
    return _file(table, spark, "trig", Frame(table("nation").source.withColumn("g", graph)).each(lambda r: record(r.n_nationkey, r.g, name=r.n_name)))


@query(f"""SELECT {_C} AS id, '{EX}Customer' AS of_type, c_name AS name, c_mktsegment AS segment, 'http://example.com/nation/' || c_nationkey AS nation FROM customer""")
def jsonld_file(table, spark, sf_dir):
    """An expanded JSON-LD document, parsed as JSON and put together by subject."""
    frame = table("customer").each(lambda r: CUSTOMER(r.c_custkey, name=r.c_name, segment=r.c_mktsegment, nation=fn.ref(NATION, r.c_nationkey)))
    return _nodes(spark, scratch(spark, "quads") + ".jsonld", frame)


@query(f"""SELECT {_C} AS id, '{EX}Customer' AS of_type, c_name AS name, c_mktsegment AS segment, 'http://example.com/nation/' || c_nationkey AS nation FROM customer""")
def jsonld_folder(table, spark, sf_dir):
    """The same as a folder of lines, each of them a document."""
    frame = table("customer").each(lambda r: CUSTOMER(r.c_custkey, name=r.c_name, segment=r.c_mktsegment, nation=fn.ref(NATION, r.c_nationkey)))
    return _nodes(spark, scratch(spark, "quads") + ".jsonld", frame, layout="folder")


def _nodes(spark, path: str, frame: Frame, layout: str = "file") -> DataFrame:
    frame.serialize(path, layout=layout)
    value, link = "array<struct<`@value`: string>>", "array<struct<`@id`: string>>"
    schema = f"`@id` string, `@type` array<string>, `{EX}name` {value}, `{EX}segment` {value}, `{EX}nation` {link}"
    nodes = jsonld.load(path, schema, spark) if layout == "file" else spark.read.schema(schema).json(path).where("`@id` is not null")
    first = lambda c: F.max(c)
    return nodes.groupBy(F.col("`@id`").alias("id")).agg(
        first(F.col("`@type`")[0]).alias("of_type"), first(F.col(f"`{EX}name`")[0]["@value"]).alias("name"),
        first(F.col(f"`{EX}segment`")[0]["@value"]).alias("segment"), first(F.col(f"`{EX}nation`")[0]["@id"]).alias("nation"),
    )


@query(f"""SELECT '<rdf:Description rdf:about="' || {_N} || '"><p:name xmlns:p="{EX}">a&lt;b &amp; ' || n_name || '</p:name></rdf:Description>' AS value FROM nation
UNION ALL SELECT '<rdf:Description rdf:about="' || {_N} || '"><p:key xmlns:p="{EX}" rdf:datatype="{XSD}integer">' || n_nationkey || '</p:key></rdf:Description>' FROM nation""")
def rdfxml_file(table, spark, sf_dir):
    record = Record("Nation", [Field("name", STRING, EX + "name"), Field("key", INT, EX + "key")], [("id", STRING)], base=EX + "nation/")
    frame = table("nation").each(lambda r: record(r.n_nationkey, name=fn.interpolate("a<b & ", r.n_name), key=r.n_nationkey))
    return _file(table, spark, "rdf", frame).where("value like '<rdf:Description%'")


@query(f"SELECT {_N} AS subject, '{EX}name' AS predicate, n_name AS object, 'literal' AS object_kind, CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS graph FROM nation WHERE false")
def quads_without_uris(table, spark, sf_dir):
    """Fields without a predicate, and no type: nothing to select, and so no quads."""
    record = Record("Nation", [Field("name", STRING)], [("id", STRING)], base=EX + "nation/")
    return table("nation").each(lambda r: record(r.n_nationkey, name=r.n_name)).to_quads()


@query(quads_sql((_N, EX + "name", "n_name", "literal", "", "nation")))
def quads_streamed(table, spark, sf_dir):
    """The same plan over a stream of files."""
    record = Record("Nation", [Field("name", STRING, EX + "name")], [("id", STRING)], base=EX + "nation/")
    place = scratch(spark, "stream")
    stream = spark.readStream.schema(table("nation").source.schema).option("pathGlobFilter", "nation.parquet").parquet(sf_dir)
    frame = Frame(stream).each(lambda r: record(r.n_nationkey, name=r.n_name))
    quad_stream(frame, f"{place}/state").format("parquet").option("path", f"{place}/quads").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(quad_plan.SCHEMA).parquet(f"{place}/quads")


_WIDE = [(f"f{i:03d}", f"{EX}f{i:03d}") for i in range(450)]


@query("SELECT " + _N + " AS subject, 'http://example.com/f' || lpad(CAST(i AS VARCHAR), 3, '0') AS predicate, n_name || i AS object, 'literal' AS object_kind, CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS graph FROM nation, range(450) t(i)")
def quads_wide(table, spark, sf_dir):
    """A record of 450 fields: still one scan."""
    record = Record("Wide", [Field(n, STRING, uri) for n, uri in _WIDE], [("id", STRING)], base=EX + "nation/")
    return table("nation").each(lambda r: record(r.n_nationkey, **{n: fn.interpolate(r.n_name, i) for i, (n, _) in enumerate(_WIDE)})).to_quads()


# --- CSV --------------------------------------------------------------------------------------------------------


def _csv_file(spark, rows: DataFrame, head: str = "") -> str:
    """Rows of column ``value`` as one file."""
    path = scratch(spark, "table") + ".csv"
    out = Outputs(spark)
    out.write_lines(rows, path, head, layout="file")
    out.commit()
    return path.removeprefix("file://")


@query("SELECT p_partkey AS column_1, p_retailprice AS column_2, p_name || ';' || chr(10) || '\"q\"' AS column_3, p_size > 25 AS column_4, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice / 8 END AS column_5 FROM part")
def csv_delimited(table, spark, sf_dir):
    """Floats, another delimiter, no header, quoted line breaks, empty cells."""
    rows = table("part").source.select(F.expr("concat_ws(';', p_partkey, p_retailprice, concat('\"', p_name, ';\\n\"\"q\"\"\"'), if(p_size > 25, 'True', 'False'), if(p_size % 3 = 0, '', cast(p_retailprice / 8 as string)))").alias("value"))
    path = _csv_file(spark, rows)
    record = csv.record(path, "Parts", spark, delimiter=";", has_header=False)
    return csv.load(path, record, spark, delimiter=";", has_header=False, multiline=True)


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey > 3")
def csv_arguments(table, spark, sf_dir):
    """The provider's arguments, by name, in a program."""
    path = _csv_file(spark, table("customer").source.where("c_nationkey > 3").select(F.concat_ws("|", "c_custkey", "c_name").alias("value")))
    source = f'let t = csv!("{path}", delimiter: "|", has_header: false) type R do id: int name: string end t |> each r -> R {{ id = r.column_1, name = r.column_2 }}'
    return compile_text(source, spark=spark).run(spark)[-1].mapped()


# --- building models --------------------------------------------------------------------------------------------

_STEP = {
    "IfcWall": "IFCWALL('{g}',#2,'{n}','d',$,$,$,'t',.SOLID.)", "IfcSlab": "IfcSlab('{g}',#2,'{n}',$,'o',$,$,$,.FLOOR.)", "IfcRoof": "IFCROOF('{g}',#2,'{n}',$,$,$,$,$,$)",
    "IfcDoor": "IFCDOOR('{g}',#2,'{n}',$,$,$,$,'t',2.5,1,.DOOR.,.SWING.)", "IfcWindow": "IFCWINDOW('{g}',#2,'{n}',$,$,$,$,$,1.5E0,2.,.X.)", "IfcSpace": "IFCSPACE('{g}',#2,'{n}',$,$,$,$,'long',$,.IN.,-0.5)",
    "IfcBuilding": "IFCBUILDING('{g}',#2,'{n}',$,$,$,$,'long',$,7.5,-1.25)", "IfcStorey": "IFCBUILDINGSTOREY('{g}',#2,'{n}',$,$,$,$,$,$,3.25)",
}
#: Last text and number of each, and how it is named in SQL.
_LAST = {"IfcWall": ("PredefinedType", None, "'SOLID'", "NULL"), "IfcSlab": ("PredefinedType", None, "'FLOOR'", "NULL"), "IfcRoof": ("PredefinedType", None, "NULL", "NULL"), "IfcDoor": ("OperationType", "OverallHeight", "'SWING'", "2.5"), "IfcWindow": ("PredefinedType", "OverallWidth", "'X'", "2.0"), "IfcSpace": ("LongName", "ElevationWithFlooring", "'long'", "-0.5"), "IfcBuilding": ("LongName", "ElevationOfTerrain", "'long'", "-1.25"), "IfcStorey": ("LongName", "Elevation", "NULL", "3.25")}


@query("\nUNION ALL\n".join(f"SELECT '{e}' AS entity, '{e}' || n_nationkey AS \"GlobalId\", n_name AS \"Name\", CAST({text} AS VARCHAR) AS last_text, CAST({number} AS DOUBLE) AS last_number FROM nation" for e, (_, _, text, number) in _LAST.items()))
def ifc_entities(table, spark, sf_dir):
    """All eight entities of files with comments, entities in comments and strings, and other types between them."""
    each = [F.format_string(f"/* it's #{k}=IFCWALL('c'); */ #%s%d /* id */ = " + s.replace("{g}", f"{e}%s").replace("{n}", "%s") + "; #99=IFCLABEL('#1=IFCWALL(''x'',$)');", F.col("n_nationkey") + 1, F.lit(k), F.col("n_nationkey"), F.col("n_name")) for k, (e, s) in enumerate(_STEP.items())]
    lines = table("nation").source.select("n_regionkey", F.concat_ws("\n", *each).alias("value"))
    texts = lines.groupBy("n_regionkey").agg(F.concat_ws("\n", F.lit("HEADER; /* don't */"), F.array_join(F.collect_list("value"), "\n")).alias("value"))
    path = scratch(spark, "models")
    texts.repartition(5, "n_regionkey").write.partitionBy("n_regionkey").text(path)  # a file for each region
    out = None
    for e, (text, number, _, _) in _LAST.items():
        rows = ifc.load(f"{path}/*", e, spark)
        rows = rows.select(F.lit(e).alias("entity"), "GlobalId", "Name", F.col(text).alias("last_text"), (F.col(number) if number else F.lit(None)).cast("double").alias("last_number"))
        out = rows if out is None else out.unionAll(rows)
    return out


# --- shapes -----------------------------------------------------------------------------------------------------

PART_SHAPES = """
PREFIX ex: <http://example.com/>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
ex:Base { a [ex:Part] ; ex:name xsd:string MINLENGTH 12 }
ex:Priced { ex:price xsd:double ; ex:large xsd:boolean }
ex:PartShape @ex:Base AND @ex:Priced AND { ex:kind xsd:string MAXLENGTH 12 ; ex:size xsd:integer ? ; ex:brand xsd:string /^Brand#[1-3]/ * ; ex:made xsd:date ; ex:of @ex:Nation + }
ex:Nation { ex:name xsd:string } OR { ex:label xsd:string }
"""
_P = "'http://example.com/part/' || p_partkey"
_VALID = "(SELECT * FROM (SELECT *, split_part(p_type, ' ', 1) AS kind FROM part) WHERE length(p_name) >= 12 AND length(kind) <= 12 AND regexp_matches(p_brand, '^Brand#[1-3]')) AS part"


@query(quads_sql(
    (_P, TYPE, f"'{EX}Part'", "iri", "", _VALID), (_P, EX + "name", "p_name", "literal", "", _VALID), (_P, EX + "price", "CAST(p_retailprice AS VARCHAR)", "literal", XSD + "double", _VALID),
    (_P, EX + "large", "CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END", "literal", XSD + "boolean", _VALID), (_P, EX + "kind", "kind", "literal", "", _VALID), (_P, EX + "size", "CAST(nullif(p_size, 10) AS VARCHAR)", "literal", XSD + "integer", _VALID),
    (_P, EX + "brand", "p_brand", "literal", "", _VALID), (_P, EX + "made", "'2024-01-02'", "literal", "", _VALID), (_P, EX + "of", "'http://example.com/nation/' || p_size % 25", "iri", "", _VALID),
))
def shex_fields(table, spark, sf_dir):
    """All fields of a shape of three parts: datatypes, facets, cardinalities and references."""
    record = shex.record(PART_SHAPES, "PartShape", "Part", [("id", STRING)])
    record.base = EX + "part/"
    rows = Frame(table("part").source.withColumns({"kind": F.split("p_type", " ")[0], "some": F.expr("nullif(p_size, 10)"), "large": F.col("p_size") > 25, "home": F.col("p_size") % 25}))
    made = lambda r: record(r.p_partkey, name=r.p_name, price=r.p_retailprice, large=r.large, kind=r.kind, size=r.some, brand=r.p_brand, made=F.lit("2024-01-02"), of=fn.ref(NATION, r.home))
    return rows.each(made).validate().to_quads()


@query("SELECT 'Part' AS source_type, CASE WHEN length(p_name) < 12 THEN 'name' ELSE 'brand' END AS field, CASE WHEN length(p_name) < 12 THEN 'min_length' ELSE 'pattern' END AS \"constraint\", CASE WHEN length(p_name) < 12 THEN '12' ELSE '^Brand#[1-3]' END AS expected, CASE WHEN length(p_name) < 12 THEN p_name ELSE p_brand END AS actual FROM part WHERE NOT (length(p_name) >= 12 AND regexp_matches(p_brand, '^Brand#[1-3]'))")
def shex_errors(table, spark, sf_dir):
    """The errors of the same facets, by a shape that is reached through an OR and a reference."""
    shapes = PART_SHAPES + "\nex:Chosen @ex:Wanted OR @ex:Nation\nex:Wanted { ex:name xsd:string MINLENGTH 12 ; ex:brand xsd:string /^Brand#[1-3]/ }"
    record = shex.record(shapes, "Chosen", "Part", [("id", STRING)])
    return table("part").each(lambda r: record(r.p_partkey, name=r.p_name, brand=r.p_brand)).errors().source


# --- programs ---------------------------------------------------------------------------------------------------


def _program(spark, sf_dir, source: str, **more):
    return compile_text(source.replace("{dir}", sf_dir), spark=spark, **more).run(spark)[-1]


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def each_alone(table, spark, sf_dir):
    """``+>`` with nothing before it is an ordinary projection."""
    return _program(spark, sf_dir, 'let n = parquet!("{dir}/nation.parquet") type R do id: int name: string end n +> each r -> R { id = r.n_nationkey, name = r.n_name }').mapped()


@query("SELECT r_regionkey AS id, r_name AS name FROM region WHERE false")
def record_of_no_rows(table, spark, sf_dir):
    return Frame.empty(spark, REGION).mapped()


@query("SELECT c_custkey AS id, CASE WHEN regexp_matches(c_name, '0*([1-9][0-9]*)$') THEN regexp_extract(c_name, '0*([1-9][0-9]*)$', 1) END AS name FROM customer")
def named_arguments(table, spark, sf_dir):
    """Arguments in another order than the function's, by name; keywords as field names; a type's own loader."""
    source = 'type C = parquet!("{dir}/customer.parquet") type R do id: int name: string end C.load() |> each r -> R { id = r.c_custkey, name = String.extract(pattern: "0*([1-9][0-9]*)$", text: r.c_name) }'
    return _program(spark, sf_dir, source).mapped()


@query("SELECT s_suppkey AS id, reverse(s_name) || '!' AS name FROM supplier")
def plugged_in_function(table, spark, sf_dir):
    """A module that the caller has registered."""
    r = standard()
    r.module("Own", {"shout": Function([("text", STRING)], STRING, lambda rt, types, v: F.concat(F.reverse(v), F.lit("!")))})
    return _program(spark, sf_dir, 'let s = parquet!("{dir}/supplier.parquet") type R do id: int name: string end s |> each x -> R { id = x.s_suppkey, name = x.s_name |> Own.shout() }', registry=r).mapped()


@query("SELECT b.n_nationkey AS id, b.name || '/' || r_name AS name FROM (SELECT n_nationkey, n_regionkey, upper(n_name) AS name FROM nation) b JOIN region ON b.n_regionkey = r_regionkey")
def join_of_mapped_rows(table, spark, sf_dir):
    """Both sides of a join are read by their mapped views."""
    source = """let n = parquet!("{dir}/nation.parquet") let r = parquet!("{dir}/region.parquet")
    type N do key: int region: int name: string end
    type G do of: int label: string end
    type R do id: int name: string end
    let g = r |> each x -> G { of = x.r_regionkey, label = x.r_name }
    n |> each x -> N { key = x.n_nationkey, region = x.n_regionkey, name = x.n_name |> String.upper() }
      |> join g on region = of
      |> each x -> R { id = x.key, name = "${x.name}/${x.label}" }"""
    return _program(spark, sf_dir, source).mapped()


#: Programs with the codes of all their errors.
_A = "type A do x: int end let a = A { x = 1 } "
WRONG = [
    ("let y = missing", "undefined"), ("type T do n: Missing end", "undefined"), ("let t = String.f(1)", "undefined"), ('let c = nothing!("x")', "undefined"), ("let a = missing let b = other", "undefined undefined"),
    ("type T do a: int end type T do b: string end", "already-defined"), (_A + "let z = a.other", "field-not-found"), ("type T do n: string end let t = T { bad = 1 }", "field-not-found"),
    (_A + "let j = a |> join a on x = y", "field-not-found"), (_A + "let j = a |> join a on (x, x) = x", "arity-mismatch"), (_A + "let j = a +> join a on x = x", "syntax"), (_A + "let j = a |> each r -> 3", "evaluation"),
    (_A + 'let s = "${a}"', "evaluation"), ("type T(id: string) do n: string end let t = T { n = 1 }", "arity-mismatch"), ("let x = String.upper()", "arity-mismatch"), ('let x = String.extract(1, "(a)")', "type-mismatch"),
    ("let x = 1 let y = x.a", "not-a"), ("let x = 1 let y = x(2)", "not-a"), ("type S = string let s = S { }", "not-a"), ('let c = csv!("none.csv")', "file-not-found"), ('let c = csv!("x.txt")', "invalid-extension"),
    ('let c = shex!("x.shex", shape: "S")', "provider-kind-mismatch"), ("let c = csv!()", "missing-argument"), ("let c = csv!(1)", "invalid-argument-type"),
    ("type T do v: int end let t = Own.open() |> each r -> T { v = Own.same(r.x, Own.inner(r.x)) }", "infinite-type"), (_A + "let y = Own.two(a)", "record-size-mismatch"), ('let x = Own.same(1, "a")', "type-mismatch"), ("let n = Own.none() let a = Own.same(n, 1) let b = Own.same(n, true)", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{codes}')" for i, (_, codes) in enumerate(WRONG)) + ") t(id, codes)")
def program_errors(table, spark, sf_dir):
    """Every error of a program is kept; types with variables are unified with an occurs check."""
    a, none = Var("a"), lambda rt, types, *values: None
    r = standard()
    r.module("Own", {"same": Function([("x", a), ("y", a)], a, none), "none": Function([], a, none), "open": Function([], Rows((("x", a),)), none), "inner": Function([("x", a)], Rows((("of", a),)), none), "two": Function([("x", Rows((("x", INT), ("y", INT))))], INT, none)})
    found = []
    for i, (source, _) in enumerate(WRONG):
        try:
            compile_text(source, registry=r, base="/nowhere")
            codes = []
        except CompileErrors as e:
            codes = [x.code for x in e.errors]
        found.append((i, " ".join(codes)))
    return spark.createDataFrame(found, "id int, codes string")


TYPES_SHAPE = """
PREFIX ex: <http://example.com/>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
ex:All { ex:a xsd:string ; ex:b xsd:integer ? ; ex:c xsd:decimal ; ex:d xsd:double * ; ex:e xsd:float + ; ex:f xsd:boolean ; ex:g xsd:dateTime {2} ; ex:h @ex:Other {0,3} ; ex:i . ; ex:j xsd:long ; a [ex:T] }
ex:Other { ex:a . }
"""


@query(f"""SELECT * FROM (VALUES ('a', 'string', '{EX}a'), ('b', 'int?', '{EX}b'), ('c', 'float', '{EX}c'), ('d', 'float?', '{EX}d'), ('e', 'float', '{EX}e'), ('f', 'bool', '{EX}f'), ('g', 'string', '{EX}g'),
  ('h', 'Other?', '{EX}h'), ('i', 'string', '{EX}i'), ('j', 'int', '{EX}j')) t(name, type, predicate)""")
def shex_types(table, spark, sf_dir):
    """Types and predicates of a shape's fields: XSD datatypes, cardinalities, references; the type of the node is no field."""
    record = shex.record(TYPES_SHAPE, "All", "All")
    return spark.createDataFrame([(f.name, str(f.type), f.uri) for f in record.fields], "name string, type string, predicate string")


_CHECKED = [("s3://b/k.csv", "s3a://b/k.csv"), ("gcs://b/k.csv", "gs://b/k.csv"), ("azure://c/k.csv", "abfss://c/k.csv"), ("hdfs://n/k.csv", "hdfs://n/k.csv"), ("ftp://h/k.csv", "invalid-argument-type"), ("s3://b/k.txt", "invalid-extension"), ("none.csv", "file-not-found"), ("s3://b/K.CSV", "s3a://b/K.CSV")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{to}')" for p, to in _CHECKED) + ") t(path, outcome)")
def path_rules(table, spark, sf_dir):
    """Paths as they are read: stores by their connector, extensions checked, local files only if they are there."""
    found = []
    for path, _ in _CHECKED:
        try:
            found.append((path, paths.checked(path, "csv", "/nowhere")))
        except MappingError as e:
            found.append((path, e.code))
    return spark.createDataFrame(found, "path string, outcome string")


@query("SELECT n_nationkey AS id, n_name || '|' || n_regionkey AS name FROM nation")
def keywords_as_fields(table, spark, sf_dir):
    """Keywords of the language name fields; a record's fields are reached by paths; an alias names a type."""
    source = """let n = parquet!("{dir}/nation.parquet")
    type Text = string
    type K do type: int let: Text join: int end
    type R do id: int name: string end
    n |> each r -> K { type = r.n_nationkey, let = r.n_name, join = r.n_regionkey }
      |> each k -> R { id = k.type, name = "${k.let}|${k.join}" }"""
    return _program(spark, sf_dir, source).mapped()


#: Four tables, joined on one and on two keys, into seven kinds of records in one pass.
SEVEN = """
type O = parquet!("{dir}/orders.parquet")
type L = parquet!("{dir}/lineitem.parquet")
type P = parquet!("{dir}/part.parquet")
type S = parquet!("{dir}/supplier.parquet")

#[rdf(type = "http://example.com/Order", base = "http://example.com/order/")]
type Order(id: string) do
    #[rdf(uri = "http://example.com/state")] state: string
    #[rdf(uri = "http://example.com/by")] by: Buyer
end
#[rdf(type = "http://example.com/Buyer", base = "http://example.com/buyer/")]
type Buyer(id: string) do #[rdf(uri = "http://example.com/number")] number: int end
#[rdf(type = "http://example.com/Line", base = "http://example.com/line/")]
type Line(id: string) do
    #[rdf(uri = "http://example.com/quantity")] quantity: int
    #[rdf(uri = "http://example.com/price")] price: float
    #[rdf(uri = "http://example.com/part")] part: Part
end
#[rdf(type = "http://example.com/Part", base = "http://example.com/part/")]
type Part(id: string) do #[rdf(uri = "http://example.com/name")] name: string #[rdf(uri = "http://example.com/brand")] brand: Brand end
#[rdf(base = "http://example.com/brand/")]
type Brand(id: string) do #[rdf(uri = "http://example.com/code")] code: int? end
#[rdf(type = "http://example.com/Supplier", base = "http://example.com/supplier/")]
type Supplier(id: string) do #[rdf(uri = "http://example.com/name")] name: string end
#[rdf(base = "http://example.com/return/")]
type Returned(id: string) do #[rdf(uri = "http://example.com/flag")] flag: string #[rdf(uri = "http://example.com/open")] open: bool end

O.load() |> join L.load() on o_orderkey = l_orderkey
    |> join P.load() on l_partkey = p_partkey
    |> join S.load() on l_suppkey = s_suppkey suffix "_s"
    |> each r -> Order(r.o_orderkey) { state = r.o_orderstatus, by = ref Buyer(r.o_custkey) }
    +> each r -> Buyer(r.o_custkey) { number = r.o_custkey }
    +> each r -> Line("${r.l_orderkey}-${r.l_linenumber}") { quantity = r.l_quantity, price = r.l_extendedprice, part = ref Part(r.l_partkey) }
    +> each r -> Part(r.p_partkey) { name = r.p_name, brand = ref Brand(r.p_brand |> Iri.encode()) }
    +> each r -> Brand(r.p_brand |> Iri.encode()) { code = r.p_brand |> String.extract("#([0-9]+)") }
    +> each r -> Supplier(r.s_suppkey) { name = r.s_name }
    +> each r -> Returned("${r.l_orderkey}-${r.l_linenumber}") { flag = r.l_returnflag, open = r.l_linestatus |> String.replace("^O$", "true") }
"""
_4 = "orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
_o, _b, _l = "'http://example.com/order/' || o_orderkey", "'http://example.com/buyer/' || o_custkey", "l_orderkey || '-' || l_linenumber"
_ln, _rt, _br, _su = f"'http://example.com/line/' || {_l}", f"'http://example.com/return/' || {_l}", "'http://example.com/brand/' || replace(p_brand, '#', '%23')", "'http://example.com/supplier/' || s_suppkey"


def _count(sql: str) -> str:
    return f"SELECT predicate, object_kind, datatype, count(*) AS n, CAST(sum(length(subject)) AS BIGINT) AS subjects, CAST(sum(length(object)) AS BIGINT) AS objects, min(object) AS least, max(subject) AS greatest FROM ({sql}) GROUP BY predicate, object_kind, datatype"


@query(_count(quads_sql(
    (_o, TYPE, f"'{EX}Order'", "iri", "", _4), (_o, EX + "state", "o_orderstatus", "literal", "", _4), (_o, EX + "by", _b, "iri", "", _4), (_b, TYPE, f"'{EX}Buyer'", "iri", "", _4), (_b, EX + "number", "CAST(o_custkey AS VARCHAR)", "literal", XSD + "integer", _4),
    (_ln, TYPE, f"'{EX}Line'", "iri", "", _4), (_ln, EX + "quantity", "CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)", "literal", XSD + "integer", _4), (_ln, EX + "price", "CAST(l_extendedprice AS VARCHAR)", "literal", XSD + "double", _4), (_ln, EX + "part", _P, "iri", "", _4),
    (_P, TYPE, f"'{EX}Part'", "iri", "", _4), (_P, EX + "name", "p_name", "literal", "", _4), (_P, EX + "brand", _br, "iri", "", _4), (_br, EX + "code", "regexp_extract(p_brand, '#([0-9]+)', 1)", "literal", XSD + "integer", _4),
    (_su, TYPE, f"'{EX}Supplier'", "iri", "", _4), (_su, EX + "name", "s_name", "literal", "", _4), (_rt, EX + "flag", "l_returnflag", "literal", "", _4), (_rt, EX + "open", "CASE WHEN l_linestatus = 'O' THEN 'true' END", "literal", XSD + "boolean", _4),
)))
def program_seven(table, spark, sf_dir):
    """A four-way join to seven record types, told by predicate: how many quads, the lengths of subjects and objects, and the ends of their order."""
    q = _program(spark, sf_dir, SEVEN).to_quads()
    # For least and greatest texts alone Spark sorts all quads by predicate before it aggregates them, and spills.  Beside an aggregate
    # that holds an object (here a list that leaves out nulls, so always empty) it keeps a hash table of the groups, up to 128 of them.
    none = F.size(F.collect_list(F.lit(None).cast("string")))
    told = [(F.count("*") + none).alias("n"), F.sum(F.length("subject")).alias("subjects"), F.sum(F.length("object")).alias("objects"), F.min("object").alias("least"), F.max("subject").alias("greatest")]
    return q.groupBy("predicate", "object_kind", "datatype").agg(*told)
