"""The driver contract: names, SQL, and independence from the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 36


def test_flagship(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["subject", "predicate", "object", "object_kind", "datatype", "lang", "graph"] and out.count() > 0


def test_queries_equal_their_sql(spark):
    import duckdb

    from strandmap import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    sql = queries.oracle_sql()
    for name in ("join_chain", "errors_first", "quads_multi", "quads_graph", "quads_null_subject", "term_kind", "nquads_text", "report_csv_rows", "ifc_rows", "program_quads"):
        got = queries.queries()[name](spark, sf)
        columns = sorted(got.columns)
        rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
        want = sorted(repr(r) for r in con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({sql[name]})").fetchall())
        assert rows == want, name


def test_works_without_the_training_data_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "strandmap"), tmp_path / "strandmap", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e, sys; q = e.queries(); assert 'quads_multi' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert not any('llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
