"""Casts of text, storage credentials, layouts of files."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import strandmap as sm
from strandmap import Frame
from strandmap.errors import InvalidArgument
from strandmap.functions.scalar import to_declared
from strandmap.sources import paths
from strandmap.types import FLOAT, INT

TEXTS = ["1", " 2 ", "-3", "+4", "1.5", ".5", "5.", "1e3", "1E-2", "", " ", "x", "1x", "0x10", "--1", "1e", "e1", "NaN", "Infinity", "-inf", "9223372036854775807", "9223372036854775808", "1_000", "١", "1\n", "1 2", None]


def test_text_is_cast_like_before_but_looked_at_first(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for kind, spark_type in ((INT, "bigint"), (FLOAT, "double")):
        rows = df.select("t", to_declared(F.col("t"), kind, T.StringType()).alias("got"), F.expr(f"try_cast(t as {spark_type})").alias("want")).collect()
        for r in rows:
            assert r["got"] == r["want"] or (r["got"] is not None and math.isnan(r["got"]) and math.isnan(r["want"])), r


def test_credentials_reach_the_connectors(spark):
    paths.configure(spark, {"spark.hadoop.fs.s3a.access.key": "k", "fs.s3a.endpoint": "http://e"})
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.access.key") == "k" and conf.get("fs.s3a.endpoint") == "http://e"
    assert paths.checked("s3://b/x.csv", "csv") == "s3a://b/x.csv" and paths.checked("az://c/x.csv") == "abfss://c/x.csv"
    with pytest.raises(InvalidArgument):
        paths.checked("ftp://h/x.csv", "csv")


def test_layouts(spark, tmp_path):
    record = sm.Record("R", [sm.Field("n", sm.STRING, "http://e/n")], [("id", sm.STRING)], base="http://e/")
    frame = Frame(spark.range(10).repartition(3)).each(lambda r: record(r.id, n=r.id))
    for name, layout, folder in (("a.nq", "file", False), ("b.nq", "folder", True), ("c.jsonld", "folder", True), ("d.jsonld", "auto", False)):
        frame.serialize(str(tmp_path / name), layout=layout)
        assert (tmp_path / name).is_dir() == folder
    assert spark.read.json(str(tmp_path / "c.jsonld")).count() == 10
    with pytest.raises(InvalidArgument):
        frame.serialize(str(tmp_path / "e.rdf"), layout="folder")
    assert not (tmp_path / "e.rdf").exists()
