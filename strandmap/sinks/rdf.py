"""RDF serialization of a frame's outputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.errors import InvalidArgument, InvalidExtension
from strandmap.operators.frame import Frame
from strandmap.plans import quads as plan
from strandmap.sinks.output import Outputs

#: Formats by extension.  Turtle and N3 are written as N-Triples, which they include; TriG by one statement a line.
FORMATS = {"nq": "nq", "nt": "nt", "ttl": "nt", "turtle": "nt", "n3": "nt", "trig": "trig", "jsonld": "json", "json": "json", "rdf": "xml", "xml": "xml", "owl": "xml"}


def format_of(path: str) -> str:
    extension = os.path.splitext(path)[1].lstrip(".").lower() or "ttl"
    if extension not in FORMATS:
        raise InvalidExtension(f"'{path}': RDF is written as {', '.join(sorted(FORMATS))}")
    return FORMATS[extension]


def lines(quads: DataFrame, format_: str) -> DataFrame:
    own = {"trig": plan.trig_lines, "json": plan.json_lines, "xml": plan.xml_lines}.get(format_)
    return own(quads) if own else plan.lines(quads, graphs=format_ == "nq")


def serialize(frame: Frame, path: str, outputs: Outputs | None = None, distinct: bool = False, strict: bool = False, layout: str = "auto") -> str:
    """Write the quads of all outputs in the format of the path's extension (Turtle without one); gives the path.

    JSON-LD and RDF/XML are one document and so one file; JSON-LD in a folder (``layout``) has a document on each line of its parts,
    RDF/XML can't be a folder.  With ``outputs`` the file appears when those are committed, else at once.
    """
    format_ = format_of(path)
    own = outputs or Outputs(frame.source.sparkSession)
    try:
        head, tail = {"json": plan.JSON_LD, "xml": plan.RDF_XML}.get(format_, ("", ""))
        made = lines(plan.quads(frame, distinct, strict), format_)
        if head and layout == "folder":
            if format_ == "xml":
                raise InvalidArgument("RDF/XML is one document and can't be a folder")
            made, head, tail = made.select(F.substr("value", F.lit(2)).alias("value")), "", ""  # without the comma
        own.write_lines(made, path, head, "file" if head else layout, tail)
        if outputs is None:
            own.commit()
    except BaseException:
        if outputs is None:
            own.abort()
        raise
    return path


def counts(frame: Frame) -> DataFrame:
    """Quads by predicate and kind of object, for a look at a mapping's output."""
    return plan.quads(frame).groupBy("predicate", "object_kind").agg(F.count("*").alias("n"))
