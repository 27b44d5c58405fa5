"""Driver queries: one for each operator of the engine, with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap import functions as fn
from strandmap.lang import compile_text
from strandmap.operators.frame import Frame
from strandmap.plans import quads as quad_plan
from strandmap.plans import terms
from strandmap.sinks.report import csv_lines
from strandmap.sources import csv, ifc, shex
from strandmap.types import BOOL, FLOAT, INT, STRING, Constraints, Field, Named, Optional, Record

EX = "http://example.com/"
TYPE = terms.RDF_TYPE
XSD = "http://www.w3.org/2001/XMLSchema#"

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(lambda t: Frame(spark.read.parquet(f"{sf_dir}/{t}.parquet")), spark, sf_dir)
        if sql:
            _SQL[name] = sql
        return f

    return add


def quads_sql(*parts: tuple[str, str, str, str, str, str], graph: str = "CAST(NULL AS VARCHAR)") -> str:
    """Union of (subject, predicate, object, kind, datatype, from) in SQL."""
    rows = []
    for s, p, o, kind, datatype, source in parts:
        dt = f"'{datatype}'" if datatype else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT {s} AS subject, '{p}' AS predicate, {o} AS object, '{kind}' AS object_kind, {dt} AS datatype, CAST(NULL AS VARCHAR) AS lang, {graph} AS graph FROM {source} WHERE ({o}) IS NOT NULL AND ({s}) IS NOT NULL"
        )
    return "\nUNION ALL\n".join(rows)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share; on a single machine a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- sources ----------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_load(table, spark, sf_dir):
    return table("nation").source


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal > 0 AS positive FROM customer")
def csv_scan(table, spark, sf_dir):
    """A report written as CSV and read back by the CSV provider, types inferred from its first rows."""
    rows = table("customer").source.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("positive"))
    path = scratch(spark, "customers") + ".csv"
    Frame(rows).report(path)
    record = csv.record(path.removeprefix("file://"), "Customers", spark)
    return csv.load(path, record, spark)


@query("SELECT 'w' || n_nationkey AS GlobalId, n_name AS Name, CASE WHEN n_regionkey = 0 THEN NULL ELSE 'it''s (' || n_regionkey || ')' END AS Description, CAST(NULL AS VARCHAR) AS ObjectType, 'T' AS Tag, CAST(n_nationkey + 0.5 AS DOUBLE) AS OverallHeight, CAST(n_regionkey AS DOUBLE) AS OverallWidth, 'DOOR' AS PredefinedType, CAST(NULL AS VARCHAR) AS OperationType FROM nation")
def ifc_rows(table, spark, sf_dir):
    """Doors of a STEP file made of the nations."""
    quoted = F.concat(F.lit("'it''s ("), F.col("n_regionkey").cast("string"), F.lit(")'"))
    line = F.concat(
        F.lit("#"), (F.col("n_nationkey") + 1).cast("string"), F.lit("=IfcDoor('w"), F.col("n_nationkey").cast("string"), F.lit("',#9,IFCLABEL('"), F.col("n_name"), F.lit("'),"),
        F.when(F.col("n_regionkey") == 0, "$").otherwise(quoted), F.lit(",$,(#1,#2),*,'T',"), F.col("n_nationkey").cast("string"), F.lit(".5,"),
        F.col("n_regionkey").cast("string"), F.lit(",.DOOR.,$);#900"), F.col("n_nationkey").cast("string"), F.lit("=IFCWALL('x;#1=IFCDOOR(');"),
    )
    texts = table("nation").source.groupBy("n_regionkey").agg(F.concat_ws("\n", F.collect_list(line)).alias("value")).select("value")
    return ifc.from_texts(texts, "IfcDoor")


# --- projections ------------------------------------------------------------------------------------------------

ORDER = Record("Order", [Field("id", INT), Field("status"), Field("priority")])
PART = Record("Part", [Field("p_partkey", INT), Field("p_name"), Field("p_brand"), Field("p_size", INT)])
REGION = Record("Region", [Field("id", INT), Field("name")])


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def each_select(table, spark, sf_dir):
    return table("orders").each(lambda r: ORDER(id=r.o_orderkey, status=r.o_orderstatus, priority=r.o_orderpriority)).mapped()


@query("SELECT p_partkey, p_name, p_size, 'brand ' || p_brand AS p_brand FROM part")
def spread_override(table, spark, sf_dir):
    parts = table("part")
    return parts.spread(PART, p_brand=fn.interpolate("brand ", parts.row().p_brand)).mapped()


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def record_positional(table, spark, sf_dir):
    return table("region").each(lambda r: REGION.positional(r.r_regionkey, r.r_name)).mapped()


@query("SELECT id, upper(status) AS name FROM (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders)")
def each_twice(table, spark, sf_dir):
    """A second projection reads the mapped rows of the first."""
    first = table("orders").each(lambda r: ORDER(id=r.o_orderkey, status=r.o_orderstatus))
    return first.each(lambda r: REGION(id=r.id, name=fn.upper(r.status))).mapped()


@query("SELECT c_custkey AS id, concat_ws('', c_name, '/', nullif(c_mktsegment, 'BUILDING'), '/', c_nationkey) AS name FROM customer")
def interp_nulls(table, spark, sf_dir):
    rows = Frame(table("customer").source.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING"))))
    return rows.each(lambda r: REGION(id=r.c_custkey, name=fn.interpolate(r.c_name, "/", r.segment, "/", r.c_nationkey))).mapped()


@query("SELECT o_orderkey AS id, concat_ws('', 'http://example.com/customer/', nullif(o_custkey, 7)) AS name FROM orders")
def ref_base(table, spark, sf_dir):
    target = Record("Customer", [Field("name")], [("id", STRING)], base=EX + "customer/")
    rows = Frame(table("orders").source.withColumn("k", F.nullif("o_custkey", F.lit(7).cast("long"))))
    return rows.each(lambda r: REGION(id=r.o_orderkey, name=fn.ref(target, r.k))).mapped()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT s_nationkey, s_name, s_suppkey FROM supplier")
def concat_rows(table, spark, sf_dir):
    s = Frame(table("supplier").source.selectExpr("s_nationkey n_nationkey", "s_name n_name", "s_suppkey n_regionkey"))
    return table("nation").concat(s).source


# --- joins ------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_single(table, spark, sf_dir):
    return table("nation").join(table("region"), "n_regionkey", "r_regionkey").source


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, r.k1, r.k2, r.flag FROM lineitem l JOIN (SELECT l_orderkey AS k1, l_linenumber AS k2, l_returnflag AS flag FROM lineitem WHERE l_linestatus = 'O') r ON l.l_orderkey = r.k1 AND l.l_linenumber = r.k2")
def join_multi(table, spark, sf_dir):
    rows = table("lineitem").source
    left = Frame(rows.select("l_orderkey", "l_linenumber", "l_quantity"))
    right = Frame(rows.where("l_linestatus = 'O'").selectExpr("l_orderkey k1", "l_linenumber k2", "l_returnflag flag"))
    return left.join(right, ["l_orderkey", "l_linenumber"], ["k1", "k2"]).source


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_b, b.n_name AS n_name_b, b.n_regionkey AS n_regionkey_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey")
def join_suffix(table, spark, sf_dir):
    return table("nation").join(table("nation"), "n_regionkey", "n_nationkey", "_b").source


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain(table, spark, sf_dir):
    customers = Frame(table("customer").source.drop("c_acctbal"))
    return customers.join(table("nation"), "c_nationkey", "n_nationkey").join(table("region"), "n_regionkey", "r_regionkey").source


@query("SELECT o_orderkey, k, c_custkey, c_name FROM (SELECT o_orderkey, nullif(o_custkey % 5, 0) AS k FROM orders) JOIN (SELECT nullif(c_custkey, 3) AS c_custkey, c_name FROM customer) ON k = c_custkey")
def join_null_keys(table, spark, sf_dir):
    left = Frame(table("orders").source.selectExpr("o_orderkey", "nullif(o_custkey % 5, 0) k"))
    return left.join(Frame(table("customer").source.selectExpr("nullif(c_custkey, 3) c_custkey", "c_name")), "k", "c_custkey").source


# --- strings ----------------------------------------------------------------------------------------------------


def _strings(table, spark, make):
    return table("part").each(lambda r: REGION(id=r.p_partkey, name=make(r.p_name))).mapped()


@query(r"SELECT c_custkey AS id, CASE WHEN regexp_matches(c_name, '#0*([1-9])5') THEN regexp_extract(c_name, '#0*([1-9])5', 1) END AS name FROM customer")
def str_extract(table, spark, sf_dir):
    return table("customer").each(lambda r: REGION(id=r.c_custkey, name=fn.extract(r.c_name, r"#0*([1-9])5"))).mapped()


@query(r"SELECT doc_id AS id, regexp_replace(text, '(\w)(\w) ', '<\2\1>') AS name FROM documents")
def str_replace_first(table, spark, sf_dir):
    return table("documents").each(lambda r: REGION(id=r.doc_id, name=fn.replace(r.text, r"([A-Za-z0-9_])([A-Za-z0-9_]) ", "<$2${1}>"))).mapped()


@query(r"SELECT doc_id AS id, regexp_replace(text, '([aeiou])\.', '\1!', 'g') AS name FROM documents")
def str_replace_all(table, spark, sf_dir):
    return table("documents").each(lambda r: REGION(id=r.doc_id, name=fn.replace_all(r.text, r"([aeiou])\.", "$1!"))).mapped()


@query("SELECT p_partkey AS id, upper(p_name) || '|' || lower(p_type) || '|' || trim('  ' || p_brand || ' ') AS name FROM part")
def str_case(table, spark, sf_dir):
    return table("part").each(lambda r: REGION(id=r.p_partkey, name=fn.interpolate(fn.upper(r.p_name), "|", fn.lower(r.p_type), "|", fn.trim(fn.interpolate("  ", r.p_brand, " "))))).mapped()


# --- validation -------------------------------------------------------------------------------------------------


def checked(**limits) -> Record:
    return Record("Item", [Field("id", INT), Field("name", validate=Constraints(**limits)), Field("size", Optional(STRING), validate=Constraints(pattern="^[1-4]"))], [])


def _items(table):
    # Sizes of ten have no value: such rows are neither valid nor, for that alone, errors.
    return Frame(table("part").source.selectExpr("p_partkey", "p_name", "cast(nullif(p_size, 10) as string) s"))


def _validated(table, record):
    return _items(table).each(lambda r: record(id=r.p_partkey, name=r.p_name, size=r.s))


def _one(table, **limits):
    record = Record("Item", [Field("id", INT), Field("name", validate=Constraints(**limits))])
    return table("part").each(lambda r: record(id=r.p_partkey, name=r.p_name)).validate().mapped()


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE length(p_name) >= 12")
def validate_min(table, spark, sf_dir):
    return _one(table, min_length=12)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE length(p_name) <= 11")
def validate_max(table, spark, sf_dir):
    return _one(table, max_length=11)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(p_name, '[aeiou][rx]|izm')")
def validate_pattern(table, spark, sf_dir):
    return _one(table, pattern="[aeiou][rx]|izm")


_ITEMS_SQL = "(SELECT p_partkey, p_name, CAST(nullif(p_size, 10) AS VARCHAR) AS s FROM part)"


@query(f"SELECT p_partkey AS id, p_name AS name, s AS size FROM {_ITEMS_SQL} WHERE length(p_name) >= 6 AND length(p_name) <= 11 AND regexp_matches(p_name, '[a-l]$') AND regexp_matches(s, '^[1-4]')")
def validate_all(table, spark, sf_dir):
    return _validated(table, checked(min_length=6, max_length=11, pattern="[a-l]$")).validate().mapped()


@query(f"""SELECT 'Item' AS source_type,
  CASE WHEN NOT length(p_name) >= 6 OR NOT length(p_name) <= 11 OR NOT regexp_matches(p_name, '[a-l]$') THEN 'name' ELSE 'size' END AS field,
  CASE WHEN NOT length(p_name) >= 6 THEN 'min_length' WHEN NOT length(p_name) <= 11 THEN 'max_length' ELSE 'pattern' END AS "constraint",
  CASE WHEN NOT length(p_name) >= 6 THEN '6' WHEN NOT length(p_name) <= 11 THEN '11' WHEN NOT regexp_matches(p_name, '[a-l]$') THEN '[a-l]$' ELSE '^[1-4]' END AS expected,
  CASE WHEN NOT length(p_name) >= 6 OR NOT length(p_name) <= 11 OR NOT regexp_matches(p_name, '[a-l]$') THEN p_name ELSE s END AS actual
FROM {_ITEMS_SQL} WHERE NOT (length(p_name) >= 6 AND length(p_name) <= 11 AND regexp_matches(p_name, '[a-l]$') AND regexp_matches(s, '^[1-4]'))""")
def errors_first(table, spark, sf_dir):
    return _validated(table, checked(min_length=6, max_length=11, pattern="[a-l]$")).errors().source


# --- RDF --------------------------------------------------------------------------------------------------------

NATION = Record("Nation", [Field("name", STRING, EX + "name"), Field("key", INT, EX + "key"), Field("region", Named("RegionR"), EX + "in"), Field("note", STRING)], [("id", STRING)], EX + "Nation", EX + "nation/")
REGION_R = Record("RegionR", [Field("name", STRING, EX + "name")], [("id", STRING)], EX + "Region", EX + "region/")
CUSTOMER = Record("Customer", [Field("name", STRING, EX + "name"), Field("segment", STRING, EX + "segment"), Field("nation", Named("Nation"), EX + "nation")], [("id", STRING)], EX + "Customer", EX + "customer/")
_N, _R = "'http://example.com/nation/' || n_nationkey", "'http://example.com/region/' || r_regionkey"
_NR = "nation JOIN region ON n_regionkey = r_regionkey"


def _nation(r):
    return NATION(r.n_nationkey, name=r.n_name, key=r.n_nationkey, region=fn.ref(REGION_R, r.n_regionkey), note=r.n_name)


_NATION_SQL = [
    (_N, TYPE, f"'{EX}Nation'", "iri", ""),
    (_N, EX + "name", "n_name", "literal", ""),
    (_N, EX + "key", "CAST(n_nationkey AS VARCHAR)", "literal", XSD + "integer"),
    (_N, EX + "in", "'http://example.com/region/' || n_regionkey", "iri", ""),
]


@query(quads_sql(*[(*x, "nation") for x in _NATION_SQL]))
def quads_single(table, spark, sf_dir):
    return table("nation").each(_nation).to_quads()


@query(quads_sql(*[(*x, _NR) for x in _NATION_SQL], (_R, TYPE, f"'{EX}Region'", "iri", "", _NR), (_R, EX + "name", "r_name", "literal", "", _NR)))
def quads_multi(table, spark, sf_dir):
    rows = table("nation").join(table("region"), "n_regionkey", "r_regionkey")
    return rows.each(_nation).also(lambda r: REGION_R(r.r_regionkey, name=r.r_name)).to_quads()


@query("SELECT DISTINCT * FROM (" + quads_sql((_R, TYPE, f"'{EX}Region'", "iri", "", _NR), (_R, EX + "name", "r_name", "literal", "", _NR)) + ")")
def quads_distinct(table, spark, sf_dir):
    rows = table("nation").join(table("region"), "n_regionkey", "r_regionkey")
    return rows.each(lambda r: REGION_R(r.r_regionkey, name=r.r_name)).to_quads(distinct=True)


@query(quads_sql(("'http://example.com/nation/' || n_nationkey", EX + "name", "n_name", "literal", "", "nation"), graph="CASE WHEN n_regionkey = 1 THEN NULL WHEN n_regionkey = 2 THEN NULL ELSE 'http://example.com/graph/' || n_regionkey END"))
def quads_graph(table, spark, sf_dir):
    """Null and invalid graphs are the default graph."""
    record = Record("Nation", [Field("name", STRING, EX + "name")], [("id", STRING), ("graph", STRING)], base=EX + "nation/")
    graph = F.expr("case when n_regionkey = 1 then null when n_regionkey = 2 then 'no iri' else concat('http://example.com/graph/', n_regionkey) end")
    return Frame(table("nation").source.withColumn("g", graph)).each(lambda r: record(r.n_nationkey, r.g, name=r.n_name)).to_quads()


_C = "'http://example.com/customer/' || c_custkey"


@query(quads_sql((_C, TYPE, f"'{EX}Customer'", "iri", "", "customer"), (_C, EX + "name", "c_name", "literal", "", "customer"), (_C, EX + "segment", "nullif(c_mktsegment, 'BUILDING')", "literal", "", "customer")))
def quads_null_object(table, spark, sf_dir):
    rows = Frame(table("customer").source.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING"))))
    return rows.each(lambda r: CUSTOMER(r.c_custkey, name=r.c_name, segment=r.segment)).to_quads()


@query(quads_sql(("CASE WHEN c_nationkey = 1 THEN NULL WHEN c_nationkey = 2 THEN NULL WHEN c_nationkey = 3 THEN '_:c' || c_custkey ELSE 'http://example.com/' || c_custkey END", EX + "name", "c_name", "literal", "", "customer")))
def quads_null_subject(table, spark, sf_dir):
    """Without a base, rows of null and invalid subjects make no quads, and blank nodes are subjects as they are."""
    record = Record("Customer", [Field("name", STRING, EX + "name")], [("id", STRING)])
    s = F.expr("case when c_nationkey = 1 then null when c_nationkey = 2 then concat('no iri ', c_custkey) when c_nationkey = 3 then concat('_:c', c_custkey) else concat('http://example.com/', c_custkey) end")
    return Frame(table("customer").source.withColumn("s", s)).each(lambda r: record(r.s, name=r.c_name)).to_quads()


_L = "'http://example.com/line/' || l_orderkey || '-' || l_linenumber"


@query(quads_sql(
    (_L, EX + "quantity", "CAST(l_quantity AS VARCHAR)", "literal", XSD + "double", "lineitem"),
    (_L, EX + "price", "CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR)", "literal", XSD + "integer", "lineitem"),
    (_L, EX + "number", "CAST(CAST(l_linenumber AS DOUBLE) AS VARCHAR)", "literal", XSD + "double", "lineitem"),
    (_L, EX + "open", "CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END", "literal", XSD + "boolean", "lineitem"),
    (_L, EX + "flag", "l_returnflag", "literal", "", "lineitem"),
))
def quads_typed(table, spark, sf_dir):
    record = Record("Line", [Field("quantity", FLOAT, EX + "quantity"), Field("price", INT, EX + "price"), Field("number", FLOAT, EX + "number"), Field("open", BOOL, EX + "open"), Field("flag", STRING, EX + "flag"), Field("bad", INT, EX + "bad")], [("id", STRING)], base=EX + "line/")
    rows = Frame(table("lineitem").source.withColumn("open", F.col("l_linestatus") == "O"))
    return rows.each(lambda r: record(fn.interpolate(r.l_orderkey, "-", r.l_linenumber), quantity=r.l_quantity, price=r.l_extendedprice, number=r.l_linenumber, open=r.open, flag=r.l_returnflag, bad=r.l_returnflag)).to_quads()


@query("""SELECT page_id AS id, object, object_kind FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '<' || url || '>' WHEN 2 THEN '_:p' || page_id WHEN 3 THEN 'http in ' || page_id ELSE 'urn:page:' || page_id END AS raw,
    CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN '_:p' || page_id WHEN 3 THEN 'http in ' || page_id ELSE 'urn:page:' || page_id END AS object,
    CASE page_id % 5 WHEN 2 THEN 'bnode' WHEN 3 THEN 'literal' ELSE 'iri' END AS object_kind FROM pages)""")
def term_kind(table, spark, sf_dir):
    raw = F.expr("case page_id % 5 when 0 then url when 1 then concat('<', url, '>') when 2 then concat('_:p', page_id) when 3 then concat('http in ', page_id) else concat('urn:page:', page_id) end")
    rows = table("pages").source.select("page_id", raw.alias("raw"))
    return rows.select(F.col("page_id").alias("id"), terms.object_term(F.col("raw")).alias("t")).select("id", "t.object", "t.object_kind")


@query("""SELECT '<http://example.com/d/' || doc_id || '> <http://example.com/text> "' || replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '" <http://example.com/g/' || source || '> .' AS value FROM documents
UNION ALL SELECT '<http://example.com/d/' || doc_id || '> <http://example.com/n> "' || n_chars || '"^^<http://www.w3.org/2001/XMLSchema#integer> <http://example.com/g/' || source || '> .' FROM documents""".replace("\\\\", "\\"))
def nquads_text(table, spark, sf_dir):
    record = Record("Doc", [Field("text", STRING, EX + "text"), Field("n", INT, EX + "n")], [("id", STRING), ("graph", STRING)], base=EX + "d/")
    rows = table("documents").each(lambda r: record(r.doc_id, fn.interpolate(EX + "g/", r.source), text=r.text, n=r.n_chars))
    return quad_plan.lines(rows.to_quads())


@query("SELECT c_custkey || ',' || CASE WHEN c_nationkey = 3 THEN '\"a, \"\"b\"\"\"' ELSE c_name END || ',' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS value FROM customer")
def report_csv_rows(table, spark, sf_dir):
    rows = table("customer").source.selectExpr("c_custkey", "case when c_nationkey = 3 then 'a, \"b\"' else c_name end n", "nullif(c_mktsegment, 'BUILDING') s")
    return csv_lines(rows)


# --- programs ---------------------------------------------------------------------------------------------------

SHAPES = """
PREFIX ex: <http://example.com/>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
ex:Customer { a [ex:Customer] ; ex:name xsd:string MINLENGTH 6 // ex:note "n" ; ex:segment xsd:string /^[BF]/ ? ; ex:nation @ex:Nation }
ex:Nation { ex:name xsd:string }
"""


@query(quads_sql((_C, TYPE, f"'{EX}Customer'", "iri", "", "(SELECT * FROM customer WHERE c_mktsegment[1] IN ('B', 'F')) AS customer")))
def shex_validated(table, spark, sf_dir):
    """Constraints of a shape keep the rows; quads of its type."""
    record = shex.record(SHAPES, "Customer", "Customer", [("id", STRING)])
    record.base = EX + "customer/"
    rows = table("customer").each(lambda r: record(r.c_custkey, name=r.c_name, segment=r.c_mktsegment, nation=fn.ref(NATION, r.c_nationkey)))
    return rows.validate().to_quads().where(F.col("predicate") == TYPE)


PROGRAM = """
type Region = parquet!("{dir}/region.parquet")
let nations = parquet!("{dir}/nation.parquet")
let customers = parquet!("{dir}/customer.parquet")

#[rdf(type = "http://example.com/Nation", base = "http://example.com/nation/")]
type NationR(id: string) do
    #[rdf(uri = "http://example.com/name")] name: string
    #[rdf("http://example.com/in")] in_region: RegionR
end

#[rdf(type = "http://example.com/Region", base = "http://example.com/region/")]
type RegionR(id: string) do
    #[rdf(uri = "http://example.com/name")] name: string
end

#[rdf(type = "http://example.com/Customer", base = "http://example.com/customer/")]
type CustomerR(id: string) do
    #[rdf(uri = "http://example.com/number")]
    number: int?
    #[rdf(uri = "http://example.com/label")]
    #[validate(min_length = 3)]
    label: string
    #[rdf(uri = "http://example.com/nation")]
    of: NationR
end

let all = customers                       // one pass makes three kinds of records
    |> join nations on c_nationkey = n_nationkey
    |> join Region.load() on (n_regionkey) = (r_regionkey)
    |> each row -> NationR(row.n_nationkey) { name = row.n_name, in_region = ref RegionR(row.r_regionkey) }
    +> each row -> RegionR(row.r_regionkey) { name = row.r_name |> String.upper() }
    +> each row -> CustomerR(row.c_custkey) {
        number = row.c_name |> String.extract("([1-9][0-9]*)$"),
        label = "${row.c_name} of ${row.n_name}",
        of = ref NationR(row.n_nationkey),
    }
all |> CustomerR.validate()
"""

_CNR = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(quads_sql(
    (_N, TYPE, f"'{EX}Nation'", "iri", "", _CNR), (_N, EX + "name", "n_name", "literal", "", _CNR), (_N, EX + "in", _R, "iri", "", _CNR),
    (_R, TYPE, f"'{EX}Region'", "iri", "", _CNR), (_R, EX + "name", "upper(r_name)", "literal", "", _CNR),
    (_C, TYPE, f"'{EX}Customer'", "iri", "", _CNR), (_C, EX + "label", "c_name || ' of ' || n_name", "literal", "", _CNR), (_C, EX + "nation", _N, "iri", "", _CNR),
    (_C, EX + "number", "nullif(regexp_extract(c_name, '([1-9][0-9]*)$', 1), '')", "literal", XSD + "integer", _CNR),
))
def program_quads(table, spark, sf_dir):
    """A whole program in the mapping language: three tables, two joins, three record types, validation, quads."""
    values = compile_text(PROGRAM.replace("{dir}", sf_dir), spark=spark).run(spark)
    return values[-1].to_quads()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations and regions as quads, in one pass over their join."""
    return _QUERIES["program_quads"](spark, sf_dir)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
