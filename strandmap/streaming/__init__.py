"""Mappings over streams: projections, filters and joins with static frames have no state, so a frame's plan runs on ``readStream`` sources as it is."""

from __future__ import annotations

from pyspark.sql.streaming import DataStreamWriter

from strandmap.operators.frame import Frame
from strandmap.plans.quads import quads
from strandmap.sinks.rdf import format_of, lines


def quad_stream(frame: Frame, checkpoint: str) -> DataStreamWriter:
    """A writer of the frame's quads; choose its sink and start it."""
    return quads(frame).writeStream.outputMode("append").option("checkpointLocation", checkpoint)


def line_stream(frame: Frame, folder: str, checkpoint: str, format_: str = "nq") -> DataStreamWriter:
    """A writer of lines of RDF text into files of a folder; every file is complete when the sink's log names it."""
    out = lines(quads(frame), format_of(f"x.{format_}"))
    return out.writeStream.format("text").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
