"""The registered queries of the training-data operators: SQL parity, and stable results on the small tables."""

import os

import pytest

from graphloom.llm import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
COLUMNS = {"p1_found": ["source_path"], "p2_found": ["id"], "p3_found": ["id_a", "id_b"], "p5_found": ["id", "line_no"], "p6_found": ["graph_commit", "id"], "p7_found": ["id_a", "id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "task_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = catalog.QUERIES[name](spark, DATA)
    r = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in r.description]
    cols = sorted(names)
    assert cols == sorted(df.columns)
    flat = lambda row: tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in row)
    assert sorted(flat(x) for x in df.select(*cols).collect()) == sorted(flat([x[names.index(c)] for c in cols]) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_queries_have_their_columns_and_each_case_once(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
