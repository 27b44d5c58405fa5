"""JSON-LD documents are read by their lines: several tasks for one file, and no line passed over."""

import json

import pytest
from pyspark.sql import functions as F

from strandmap import queries
from strandmap.errors import DataFault
from strandmap.operators.frame import Frame
from strandmap.sources import jsonld
from strandmap.types import STRING, Field, Record

SCHEMA = "`@id` string, `http://e/name` array<struct<`@value`: string>>"
SMALL = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_query_reads_its_document_by_several_tasks(spark, small_splits):
    plan = queries.queries()["jsonld_file"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan()
    assert plan.collectLeaves().head().execute().getNumPartitions() > 4


def test_lines_equal_the_document(spark, tmp_path, small_splits):
    record = Record("T", [Field("name", STRING, "http://e/name")], [("id", STRING)], base="http://e/t/")
    odd = F.element_at(F.array(*map(F.lit, ["]", "[{}", ",{", 'a "b"\n\r\\', " é\u0001", ""])), (F.col("id") % 6 + 1).cast("int"))
    path = Frame(spark.range(500).withColumn("name", odd)).each(lambda r: record(r.id, name=r.name)).serialize(str(tmp_path / "o.jsonld"))
    document = json.loads(open(path, encoding="utf-8").read())
    rows = jsonld.load(path, SCHEMA, spark)
    assert rows.rdd.getNumPartitions() > 4
    assert sorted((r[0], r[1][0][0]) for r in rows.collect()) == sorted((n["@id"], n["http://e/name"][0]["@value"]) for n in document if n)
    assert rows.count() == 500


@pytest.mark.parametrize("text", ['[{}\n,{"@id":"a"}\n', ',{"@id":"a"}\n]\n', "]\n", ""])
def test_a_document_cut_off_is_refused(spark, tmp_path, text):
    (tmp_path / "x.jsonld").write_text(text)
    with pytest.raises(DataFault):
        jsonld.load(str(tmp_path / "x.jsonld"), SCHEMA, spark)


@pytest.mark.parametrize("line", ['{"@id":"a"}', ',{"@id":}', ',{"@id":"a"', ""])
def test_a_line_that_is_no_node_fails_the_scan(spark, tmp_path, line):
    (tmp_path / "x.jsonld").write_text('[{}\n,{"@id":"b"}\n' + line + "\n]\n")
    with pytest.raises(Exception, match="node object|MALFORMED|malformed"):
        jsonld.load(str(tmp_path / "x.jsonld"), SCHEMA, spark).collect()
