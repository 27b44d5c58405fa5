"""Building models: entities of one type of an IFC file as rows.  Files are parsed on executors, one task for each file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandmap.errors import Undefined
from strandmap.sources import step
from strandmap.types import FLOAT, SPARK_TYPES, STRING, Field, Optional, Record

# Attribute positions of the public IFC schema.
_ROOT = [("GlobalId", 0, STRING), ("Name", 2, STRING), ("Description", 3, STRING), ("ObjectType", 4, STRING)]
_ELEMENT = [*_ROOT, ("Tag", 7, STRING)]
_SPATIAL = [*_ROOT, ("LongName", 7, STRING)]
_KIND = [("PredefinedType", 8, STRING)]
_OPENING = [("OverallHeight", 8, FLOAT), ("OverallWidth", 9, FLOAT), ("PredefinedType", 10, STRING)]
ENTITIES = {
    "IfcWall": ("IFCWALL", _ELEMENT + _KIND),
    "IfcSlab": ("IFCSLAB", _ELEMENT + _KIND),
    "IfcRoof": ("IFCROOF", _ELEMENT + _KIND),
    "IfcDoor": ("IFCDOOR", _ELEMENT + _OPENING + [("OperationType", 11, STRING)]),
    "IfcWindow": ("IFCWINDOW", _ELEMENT + _OPENING),
    "IfcSpace": ("IFCSPACE", _SPATIAL + [("PredefinedType", 9, STRING), ("ElevationWithFlooring", 10, FLOAT)]),
    "IfcBuilding": ("IFCBUILDING", _SPATIAL + [("ElevationOfRefHeight", 9, FLOAT), ("ElevationOfTerrain", 10, FLOAT)]),
    "IfcStorey": ("IFCBUILDINGSTOREY", _SPATIAL + [("Elevation", 9, FLOAT)]),
}


def record(entity: str, name: str | None = None) -> Record:
    """The record type of an entity; only GlobalId is required."""
    if entity not in ENTITIES:
        raise Undefined("entity", entity)
    return Record(name or entity, [Field(n, t if n == "GlobalId" else Optional(t)) for n, _, t in ENTITIES[entity][1]])


def rows(text: str, entity: str, strict: bool = False) -> Iterator[tuple]:
    """Rows of one file's text.  Enumerations give their names; ``strict`` gives null for them."""
    kind, fields = ENTITIES[entity]
    for _, values in step.entities(text, kind):
        get = lambda i: values[i] if i < len(values) else None  # noqa: E731, B023
        yield tuple(step.as_float(get(i)) if t is FLOAT else step.as_string(get(i), not strict) for _, i, t in fields)


def load(path: str, entity: str, spark: SparkSession, strict: bool = False) -> DataFrame:
    """A lazy frame of an entity's rows; the path may name many files."""
    return from_texts(spark.read.text(path, wholetext=True), entity, strict)


def from_texts(texts: DataFrame, entity: str, strict: bool = False) -> DataFrame:
    """Rows of an entity in whole files, one in each row of column ``value``."""
    fields = ENTITIES[entity][1]
    schema = T.StructType([T.StructField(n, SPARK_TYPES[t]) for n, _, t in fields])
    kinds = [pa.float64() if t is FLOAT else pa.string() for _, _, t in fields]

    def work(batches):
        for x in batches:
            for text in x["value"].to_pylist():
                found: list[tuple] = []
                for r in rows(text, entity, strict):
                    found.append(r)
                    if len(found) >= 10_000:
                        yield made(found)
                        found = []
                yield made(found)

    def made(found):
        columns = zip(*found, strict=True) if found else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [n for n, _, _ in fields])

    return texts.mapInArrow(work, schema)
