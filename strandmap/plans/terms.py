"""RDF terms as column expressions: classification, validity, and N-Quads text."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmap.errors import InvalidArgument

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
#: Absolute IRIs: a scheme, then anything but blanks, controls and the characters that IRIs exclude.
IRI = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|\\^`\x7f]*$"
BNODE = r"^_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-\x{B7}]*[\p{L}\p{N}_\-\x{B7}])?$"


def unwrapped(c: Column) -> Column:
    """Without the angle brackets around it, if it has both."""
    both = c.startswith("<") & c.endswith(">") & (F.char_length(c) >= 2)
    return F.when(both, F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(c)


def is_iri(c: Column) -> Column:
    return c.rlike(IRI)


def is_bnode(c: Column) -> Column:
    return c.rlike(BNODE)


def resource(c: Column) -> Column:
    """A subject or graph: a blank node or a valid IRI without brackets, else null."""
    plain = F.when(is_iri(c), c).when(c.startswith("<"), F.when(is_iri(unwrapped(c)), unwrapped(c)))
    return F.when(c.startswith("_:"), F.when(is_bnode(c), c)).otherwise(plain)


def object_term(c: Column, strict: bool = False) -> Column:
    """Struct (object, object_kind) of a string column: ``_:`` is a blank node, ``<>`` and IRIs by http or urn: are IRIs, the rest literals.

    What looks like an IRI or blank node but isn't a valid one is a literal; ``strict`` raises instead.
    """
    bare = unwrapped(c)
    wrapped = c.startswith("<") & c.endswith(">")
    looks = wrapped | ((F.char_length(c) > 4) & (c.startswith("http") | c.startswith("urn:")))
    term = lambda v, kind: F.struct(v.alias("object"), F.lit(kind).alias("object_kind"))
    bad = term(F.raise_error(F.concat(F.lit("not a valid IRI: "), c)).cast("string"), "iri") if strict else term(c, "literal")
    return F.when(c.startswith("_:"), F.when(is_bnode(c), term(c, "bnode")).otherwise(bad)).when(looks, F.when(is_iri(bare), term(bare, "iri")).otherwise(bad)).otherwise(term(c, "literal"))


def predicate(iri: str) -> str:
    """A predicate known when the plan is built; it must be a valid IRI."""
    bare = iri[1:-1] if iri.startswith("<") and iri.endswith(">") else iri
    if not re.match(IRI, bare):
        raise InvalidArgument(f"'{iri}' is not a valid predicate IRI")
    return bare


def language(tag: str) -> str:
    """A well-formed language tag."""
    if not re.fullmatch(r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*", tag):
        raise InvalidArgument(f"'{tag}' is not a language tag")
    return tag


def escaped(c: Column) -> Column:
    """The text between the quotes of an N-Quads literal."""
    # The short escapes of N-Triples; other controls are written by their number.
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    rare = c
    for n in [*range(0x00, 0x08), 0x0B, *range(0x0E, 0x20), 0x7F]:
        rare = F.replace(rare, F.lit(chr(n)), F.lit(f"\\u{n:04X}"))
    return F.when(c.rlike("[\\x00-\\x1f\\x7f]"), rare).otherwise(c)


def resource_text(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def object_text(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    literal = F.concat(F.lit('"'), escaped(value), F.lit('"'), F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise(F.lit("")))
    return F.when(kind == "literal", literal).otherwise(resource_text(value))


def encode_iri(c: Column) -> Column:
    """Percent-encoding of everything but unreserved characters, for use inside IRI templates."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


def resolve_iri(c: Column, base: str) -> Column:
    """An absolute IRI as it is, a relative one appended to the base."""
    if not urlsplit(base).scheme:
        raise InvalidArgument(f"'{base}' is not an absolute base")
    return F.when(is_iri(c), c).otherwise(F.concat(F.lit(base), c))
