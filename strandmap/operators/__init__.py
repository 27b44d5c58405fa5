"""Relational operators: frames with pending record outputs, joins, and validation."""

from strandmap.operators.frame import Frame
from strandmap.operators.validation import errors, validate

__all__ = ["Frame", "errors", "validate"]
