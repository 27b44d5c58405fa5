"""Scalar functions over columns; everything stays a Spark expression."""

from strandmap.functions.scalar import column, interpolate, ref, to_declared
from strandmap.functions.strings import extract, lower, replace, replace_all, trim, upper

__all__ = ["column", "extract", "interpolate", "lower", "ref", "replace", "replace_all", "to_declared", "trim", "upper"]
