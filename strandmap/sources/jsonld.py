"""JSON-LD documents as the sink writes them: an array with one node object on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.errors import DataFault
from strandmap.plans.quads import JSON_LD
from strandmap.sinks.output import target


def _check_ends(path: str, spark: SparkSession) -> None:
    """A document cut off at either end is none; only its first and last bytes are read."""
    head, tail = (end.encode() for end in JSON_LD)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    ends = []
    if size >= len(head) + len(tail):
        stream = fs.open(p)
        try:
            for at, n in ((0, len(head)), (size - len(tail), len(tail))):
                stream.seek(at)
                ends.append(bytes(stream.readNBytes(n)))
        finally:
            stream.close()
    if ends != [head, tail]:
        raise DataFault(f"'{path}' is not a whole JSON-LD document of one node a line")


def load(path: str, schema: str, spark: SparkSession) -> DataFrame:
    """Node objects of a document by a schema; a line that is no node object fails the scan.

    The document is read by its lines, so tasks share a file of any size: read as one JSON value, it would be held by one task.
    """
    path = target(path)
    _check_ends(path, spark)
    head, tail = (end.rstrip("\n") for end in JSON_LD)
    line = F.col("value")
    lines = spark.read.text(path, lineSep="\n").where(~line.isin(head, tail))
    fault = F.raise_error(F.concat(F.lit("no node object of JSON-LD: "), line)).cast("string")
    node = F.when(line.startswith(",{") & line.endswith("}"), F.substr(line, F.lit(2))).otherwise(fault)
    return lines.select(F.from_json(node, schema, {"mode": "FAILFAST"}).alias("node")).select("node.*")
