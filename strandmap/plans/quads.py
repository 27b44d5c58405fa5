"""Record outputs to quads, in one pass over the source.

Every output of a projection names its predicates; all (output, predicate) pairs of a row become elements of one array of
structs, which is exploded.  The plan has one scan of each source and one Generate, however many record types there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.errors import EvaluationFault
from strandmap.functions.scalar import text, to_declared
from strandmap.operators.frame import Frame
from strandmap.plans import terms
from strandmap.types import DATATYPES, Output, strip

SCHEMA = "subject string, predicate string, object string, object_kind string, datatype string, lang string, graph string"
NAMES = ["subject", "predicate", "object", "object_kind", "datatype", "lang", "graph"]
#: Elements of one array; arrays of more are made of several, and exploded as one.
WIDEST = 400


def subject(out: Output) -> Column:
    """Base and first constructor argument; a null argument leaves the base alone."""
    own = text(out.args[0])
    return F.concat_ws("", F.lit(out.record.base), own) if out.record.base else own


def _types(frame: Frame) -> list[list[T.DataType]]:
    """Types of the values of each output, found by one analysis of them all."""
    flat = [c.alias(f"_{k}_{j}") for k, out in enumerate(frame.outputs) for j, (_, c) in enumerate(out.values)]
    kinds = iter(f.dataType for f in frame.source.select(*flat).schema.fields) if flat else iter(())
    return [[next(kinds) for _ in out.values] for out in frame.outputs]


def elements(out: Output, of: str, types: list[T.DataType]) -> tuple[dict[str, Column], list[Column]]:
    """What an output makes of a row: columns that its quads share (names begin with ``of``), and a struct for each quad.

    A struct has the value as text, and the kind of the object where the field's type tells it; the others are told
    after the structs have been exploded, by one expression for all fields.  Values are no columns of their own: hundreds of names
    for one column would be compared with each other by the optimizer.
    """
    if not out.args:
        raise EvaluationFault(f"records of {out.record.name} have no subject: its constructor has no argument")
    shared = {f"{of}s": terms.resource(subject(out))}
    graph = None
    if len(out.args) > 1:
        shared[f"{of}g"], graph = terms.resource(text(out.args[1])), F.col(f"{of}g")
    null = F.lit(None).cast("string")
    ends = F.col(f"{of}s").alias("subject"), (null if graph is None else graph).alias("graph")
    none = {n: null.alias(n) for n in ("kind", "datatype", "lang")}

    def part(p: str, value: Column, **known: str | None) -> Column:
        fixed = [none[n] if known.get(n) is None else F.lit(known[n]).alias(n) for n in none]
        return F.struct(*ends, F.lit(p).alias("predicate"), value.alias("value"), *fixed)

    found = []
    if out.record.rdf_type:
        found.append(part(terms.RDF_TYPE, F.lit(terms.predicate(out.record.rdf_type)), kind="iri"))
    for j, (name, value) in enumerate(out.values):
        f = out.record.field(name)
        if f.uri is None:
            continue
        lexical, xsd = to_declared(value, f.type, types[j]).cast("string"), DATATYPES.get(strip(f.type))
        if xsd:  # numbers and booleans never look like IRIs
            found.append(part(terms.predicate(f.uri), lexical, kind="literal", datatype=xsd))
        else:
            found.append(part(terms.predicate(f.uri), lexical, lang=terms.language(f.lang) if f.lang else None))
    return shared, found


def quads(frame: Frame, distinct: bool = False, strict: bool = False) -> DataFrame:
    """Quads of all outputs of a frame; those that null subjects, invalid subjects and null objects would make are left out.

    Repeated quads stay unless ``distinct``; an invalid or null graph is the default graph (null).
    """
    if not frame.outputs:
        raise EvaluationFault("RDF output needs rows made by a record constructor")
    source, types, prefix = frame.source, _types(frame), "_"
    while any(c.startswith(prefix) for c in source.columns):
        prefix += "_"
    made = [elements(out, f"{prefix}{k}", types[k]) for k, out in enumerate(frame.outputs)]
    parts = [q for _, found in made for q in found]
    if not parts:
        return source.sparkSession.createDataFrame([], SCHEMA)
    # Subjects and graphs, which all quads of an output share, are made and checked once for each row.
    rows = source.select("*", *[c.alias(n) for shared, _ in made for n, c in shared.items()])
    arrays = [F.array(*parts[lo : lo + WIDEST]) for lo in range(0, len(parts), WIDEST)]
    whole = arrays[0] if len(arrays) == 1 else F.flatten(F.array(*arrays))
    made = rows.select(F.explode(whole).alias("q")).select("q.*").where("subject IS NOT NULL AND value IS NOT NULL")
    told = F.when(F.col("kind").isNotNull(), F.struct(F.col("value").alias("object"), F.col("kind").alias("object_kind"))).otherwise(terms.object_term(F.col("value"), strict))
    made = made.withColumn("term", told)
    kind = F.col("term.object_kind")
    out = made.select("subject", "predicate", "term.object", kind.alias("object_kind"), "datatype", F.when(kind == "literal", F.col("lang")).alias("lang"), "graph")
    return out.dropDuplicates() if distinct else out


def lines(q: DataFrame, graphs: bool = True) -> DataFrame:
    """One N-Quads line per quad in column ``value``; without ``graphs``, N-Triples, and a named graph is an error."""
    end = F.when(F.col("graph").isNotNull(), F.concat(F.lit(" "), terms.resource_text(F.col("graph")))).otherwise(F.lit(""))
    if not graphs:
        end = F.when(F.col("graph").isNotNull(), F.raise_error(F.concat(F.lit("this format has no named graphs: "), F.col("graph"))).cast("string")).otherwise(F.lit(""))
    obj = terms.object_text(F.col("object"), F.col("object_kind"), F.col("datatype"), F.col("lang"))
    return q.select(F.concat(terms.resource_text(F.col("subject")), F.lit(" <"), F.col("predicate"), F.lit("> "), obj, end, F.lit(" .")).alias("value"))


def trig_lines(q: DataFrame) -> DataFrame:
    """One TriG statement per line."""
    obj = terms.object_text(F.col("object"), F.col("object_kind"), F.col("datatype"), F.col("lang"))
    body = F.concat(terms.resource_text(F.col("subject")), F.lit(" <"), F.col("predicate"), F.lit("> "), obj, F.lit(" ."))
    return q.select(F.when(F.col("graph").isNotNull(), F.concat(terms.resource_text(F.col("graph")), F.lit(" { "), body, F.lit(" }"))).otherwise(body).alias("value"))


#: Around the lines of formats that are one document: what a file starts and ends with.  The empty node of JSON-LD says nothing.
JSON_LD = ("[{}\n", "]\n")
RDF_XML = ('<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n', "</rdf:RDF>\n")


def json_lines(q: DataFrame) -> DataFrame:
    """One node object of expanded JSON-LD per quad, each after a comma."""

    def quoted(c: Column) -> Column:
        array = F.to_json(F.array(c))
        return F.substring(array, F.lit(2), F.char_length(array) - 2)

    o, literal = F.col("object"), F.col("object_kind") == "literal"
    extra = F.when(F.col("lang").isNotNull(), F.concat(F.lit(',"@language":'), quoted(F.col("lang")))).when(F.col("datatype").isNotNull(), F.concat(F.lit(',"@type":'), quoted(F.col("datatype")))).otherwise(F.lit(""))
    value = F.when(literal, F.concat(F.lit('{"@value":'), quoted(o), extra, F.lit("}"))).otherwise(F.concat(F.lit('{"@id":'), quoted(o), F.lit("}")))
    is_type = (F.col("predicate") == terms.RDF_TYPE) & ~literal
    own = F.when(is_type, F.concat(F.lit('"@type":['), quoted(o))).otherwise(F.concat(quoted(F.col("predicate")), F.lit(":["), value))
    node = F.concat(F.lit('{"@id":'), quoted(F.col("subject")), F.lit(","), own, F.lit("]}"))
    named = F.concat(F.lit('{"@id":'), quoted(F.col("graph")), F.lit(',"@graph":['), node, F.lit("]}"))
    return q.select(F.concat(F.lit(","), F.when(F.col("graph").isNotNull(), named).otherwise(node)).alias("value"))


def xml_lines(q: DataFrame) -> DataFrame:
    """One description of RDF/XML per quad; named graphs, and predicates and texts that XML can't write, are errors."""

    def escaped(c: Column) -> Column:
        for raw, out in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
            c = F.replace(c, F.lit(raw), F.lit(out))
        return c

    fail = lambda why, c: F.raise_error(F.concat(F.lit(why), c)).cast("string")
    p, o, s = F.col("predicate"), F.col("object"), F.col("subject")
    split = r"(?s)^(.*?)([A-Za-z_][A-Za-z0-9_.\-]*)$"
    name = F.regexp_extract(p, split, 2)
    resource = lambda c, attribute: F.when(c.startswith("_:"), F.concat(F.lit('rdf:nodeID="'), F.substring(c, F.lit(3), F.char_length(c)), F.lit('"'))).otherwise(F.concat(F.lit(f'rdf:{attribute}="'), escaped(c), F.lit('"')))
    about, target = resource(s, "about"), resource(o, "resource")
    extra = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("lang"), F.lit('"'))).when(F.col("datatype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), escaped(F.col("datatype")), F.lit('"'))).otherwise(F.lit(""))
    start = F.concat(F.lit("<p:"), name, F.lit(' xmlns:p="'), escaped(F.regexp_extract(p, split, 1)), F.lit('"'))
    end = F.concat(F.lit("</p:"), name, F.lit(">"))
    body = F.when(F.col("object_kind") == "literal", F.concat(start, extra, F.lit(">"), escaped(o), end)).otherwise(F.concat(start, F.lit(" "), target, F.lit("/>")))
    whole = F.concat(F.lit("<rdf:Description "), about, F.lit(">"), body, F.lit("</rdf:Description>"))
    bad = F.when(F.col("graph").isNotNull(), fail("this format has no named graphs: ", F.col("graph"))).when(name == "", fail("this format can't write the predicate ", p)).when(o.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"), fail("this format can't write a control character of ", s))
    return q.select(F.coalesce(bad, whole).alias("value"))


def with_language(q: DataFrame, lang: str) -> DataFrame:
    """Plain literals tagged with a language."""
    plain = (F.col("object_kind") == "literal") & F.col("datatype").isNull()
    return q.withColumn("lang", F.when(plain, F.lit(terms.language(lang))).otherwise(F.col("lang")))
