import glob
import os

import pytest

from bitloom.llm import queries as Q

NEEDS = {"p8_selection", "p8_shares"}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_sql(spark, data, name):
    got = Q.queries()[name](spark, data).toPandas()
    sql = Q.oracle_sql().get(name)
    if sql is None:
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


@pytest.mark.parametrize("name,columns", [
    ("p1_found", ["unit_key"]), ("p2_found", ["manifest_id", "chunk_no"]), ("p3_found", ["field", "term_id_a", "term_id_b"]), ("p4_found", ["unit_key", "defect"]),
    ("p5_found", ["file_id", "source_seg_no", "target_seg_no"]), ("p6_found", ["table_name", "first_id", "copy_id"]), ("p7_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id"]),
])
def test_columns(spark, data, name, columns):
    assert Q.queries()[name](spark, data).columns == columns
