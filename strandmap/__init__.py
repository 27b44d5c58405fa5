"""Declarative data-to-graph mapping on Spark: typed records, one-pass multi-output projection, validation, RDF and CSV sinks."""

from strandmap.errors import CompileErrors, MappingError
from strandmap.functions import extract, interpolate, lower, ref, replace, replace_all, trim, upper
from strandmap.operators.frame import Frame, Row
from strandmap.types import BOOL, FLOAT, INT, STRING, Constraints, Field, Named, Optional, Output, Record

__all__ = [
    "BOOL", "FLOAT", "INT", "STRING", "CompileErrors", "Constraints", "Field", "Frame", "MappingError", "Named", "Optional", "Output", "Record", "Row",
    "extract", "interpolate", "lower", "ref", "replace", "replace_all", "trim", "upper",
]
