"""The standard providers and modules."""

from __future__ import annotations

import os

from strandmap.errors import EvaluationFault, InvalidArgument
from strandmap.functions import strings
from strandmap.functions.scalar import text as as_text
from strandmap.operators.frame import Frame
from strandmap.plans import terms
from strandmap.registry import ANY, Function, Provided, Provider, ProviderArg, ProviderContext, Registry
from strandmap.sinks.rdf import serialize
from strandmap.sinks.report import write_csv
from strandmap.sources import csv, ifc, parquet, paths, shex
from strandmap.types import STRING, UNIT, VALIDATION_ERROR, Named, Record


def _frame(value: object, what: str) -> Frame:
    if not isinstance(value, Frame):
        raise EvaluationFault(f"{what} needs rows")
    return value


def _file_name(value: object) -> str:
    if not isinstance(value, str):
        raise InvalidArgument("a file name must be a string literal")
    return value


# --- providers ---


def _csv(ctx: ProviderContext, args: dict) -> Provided:
    path = paths.checked(args["path"], "csv", ctx.base)
    options = {"delimiter": args["delimiter"], "has_header": args["has_header"]}
    record = csv.record(path, ctx.type_name, ctx.spark, **options)
    record.params = ctx.params
    # The sampled schema is kept: loading doesn't infer again.
    return Provided(record, lambda rt: Frame(csv.load(path, record, rt.spark, **options), record=record))


def _parquet(ctx: ProviderContext, args: dict) -> Provided:
    path = args["path"] if "://" in args["path"] else os.path.abspath(os.path.join(ctx.base or "", args["path"]))
    record = parquet.record(path, ctx.type_name, ctx.spark)
    record.params = ctx.params
    return Provided(record, lambda rt: Frame(parquet.load(path, record, rt.spark), record=record))


def _ifc(ctx: ProviderContext, args: dict) -> Provided:
    record = ifc.record(args["entity"], ctx.type_name)
    path = paths.checked(args["path"], "ifc", ctx.base)
    return Provided(record, lambda rt: Frame(ifc.load(path, args["entity"], rt.spark, args["strict"]), record=record))


def _shex(ctx: ProviderContext, args: dict) -> Provided:
    text = ctx.registry.read_file(paths.checked(args["path"], "shex", ctx.base))
    return Provided(shex.record(text, args["shape"], ctx.type_name, ctx.params, ctx.identities))


def _shex_identity(ctx: ProviderContext, args: dict) -> str:
    return shex.find(shex.parse(ctx.registry.read_file(paths.checked(args["path"], "shex", ctx.base))), args["shape"])


# --- modules ---


def _validation(record: Record) -> dict[str, Function]:
    if not record.constrained():
        return {}
    return {
        "validate": Function([("rows", ANY)], lambda types: types[0], lambda rt, types, rows: _frame(rows, f"{record.name}.validate").validate(record)),
        "errors": Function([("rows", ANY)], Named(VALIDATION_ERROR.name), lambda rt, types, rows: _frame(rows, f"{record.name}.errors").errors(record)),
    }


def _serialize(rt, types, rows, path):
    frame = _frame(rows, "Rdf.serialize")
    if not frame.outputs:
        raise EvaluationFault("Rdf.serialize needs rows made by a record constructor")
    serialize(frame, _at(rt, _file_name(path)), rt.outputs)


def _report(rt, types, rows, path):
    write_csv(_frame(rows, "Report.csv"), _at(rt, _file_name(path)), rt.outputs)


def _at(rt, path: str) -> str:
    return path if "://" in path else os.path.abspath(os.path.join(rt.base or "", path))


def _pure(f) -> object:
    return lambda rt, types, *values: f(*values)


def standard() -> Registry:
    """A registry with all providers and modules of the language."""
    r = Registry()
    r.provider("csv", Provider("both", [ProviderArg("path", str, required=True), ProviderArg("delimiter", str, ","), ProviderArg("has_header", bool, True)], _csv))
    r.provider("parquet", Provider("both", [ProviderArg("path", str, required=True)], _parquet))
    r.provider("ifc", Provider("data", [ProviderArg("path", str, required=True), ProviderArg("entity", str, required=True), ProviderArg("strict", bool, False)], _ifc))
    r.provider("shex", Provider("schema", [ProviderArg("path", str, required=True), ProviderArg("shape", str, required=True)], _shex, _shex_identity))
    text = ("text", STRING)
    r.module(
        "String",
        {
            "extract": Function([text, ("pattern", STRING)], STRING, _pure(strings.extract)),
            "replace": Function([text, ("pattern", STRING), ("replacement", STRING)], STRING, _pure(strings.replace)),
            "replace_all": Function([text, ("pattern", STRING), ("replacement", STRING)], STRING, _pure(strings.replace_all)),
            "upper": Function([text], STRING, _pure(strings.upper)),
            "lower": Function([text], STRING, _pure(strings.lower)),
            "trim": Function([text], STRING, _pure(strings.trim)),
        },
    )
    r.module(
        "Iri",
        {
            "encode": Function([text], STRING, _pure(lambda v: terms.encode_iri(as_text(v)))),
            "resolve": Function([text, ("base", STRING)], STRING, _pure(lambda v, base: terms.resolve_iri(as_text(v), base))),
        },
    )
    r.module("Rdf", {"serialize": Function([("rows", ANY), ("filename", STRING)], UNIT, _serialize)})
    r.module("Report", {"csv": Function([("rows", ANY), ("filename", STRING)], UNIT, _report)})
    r.generator(_validation)
    return r
