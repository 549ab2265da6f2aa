"""Every pN_ query runs over the smallest tables, and its SQL agrees where there is one."""

import os

import duckdb
import pytest

from tessera.llm import queries as Q
from tests.test_entry import FOLDER, norm

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
COLUMNS = {
    "p1_found": {"doc_id": "bigint", "line_no": "int"}, "p2_found": {"chunk_id": "string"}, "p3_found": {"rec_table": "string", "rec_id": "bigint", "field_name": "string", "kind": "string", "start_pos": "int"},
    "p4_found": {"rec_table": "string", "rec_id": "bigint", "defect": "string"}, "p5_found": {"doc_id": "bigint", "line_no": "int"}, "p7_found": {"doc_id": "bigint", "item_id": "bigint"}, "p8_found": {"doc_id": "bigint"},
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", Q.queries())
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name] and len(set(map(tuple, rows))) == len(rows)
    sql = Q.oracle_sql().get(name)
    if sql is not None:
        cur = duck.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
        assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in rows) == want
